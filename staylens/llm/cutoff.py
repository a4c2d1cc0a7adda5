"""Problem 4: per source, the score cutoff that keeps a target share of its records.

Records are range-sorted by source and score, counted per partition and source, and a prefix sum over
the partitions finds the one that holds the target-th record; the exact row is read there.  A hot
source spans many range partitions, since ties of source and score are spread by a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def score_cutoffs(records: DataFrame, targets: DataFrame, source_col: str, score_col: str, id_col: str, keep_col: str, partitions: int | None = None) -> DataFrame:
    """(source, cutoff, n_kept, n_records) for each target with records.

    ``records`` has one row an id; rows with a null source or score take no part.  ``targets`` has
    (source, share in percent); a source named twice gets one row for each share, a null one none.
    The cutoff is the highest score for which the records at or above it are at least the share;
    shares of 0 or less keep the records of the highest score, shares above 100 give no row.
    Ties at the cutoff are all kept and counted.
    """
    part = records.select(F.col(source_col).alias("source"), F.col(score_col).alias("score"), F.col(id_col).alias("id")).where("source is not null and score is not null")
    part = part.join(targets.select(F.col(source_col).alias("source")).distinct(), "source", "left_semi")
    keys = [F.col("source"), F.col("score").desc(), F.xxhash64("id")]
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = part.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    # the range bounds come from a sample, so the sorted rows are kept: both reads see the same partitions
    sorted_rows = checkpointed(sorted_rows.select("source", "score", "part"))
    counts = sorted_rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    goals = targets.select(F.col(source_col).alias("source"), F.col(keep_col).cast("long").alias("keep")).distinct()
    goals = counts.join(goals, "source").withColumn("target", F.greatest(F.lit(1), F.expr("cast((keep * total + 99) div 100 as long)")))
    here = goals.where("target > before and target <= before + n").select("source", "keep", "part", "total", (F.col("target") - F.col("before")).alias("nth"))
    # inside the located partition the exact row is the nth: the score at which the running count reaches it
    by_score = sorted_rows.join(here.select("source", "part").distinct(), ["source", "part"], "left_semi").groupBy("source", "part", "score").agg(F.count("*").alias("m"))
    running = Window.partitionBy("source", "part").orderBy(F.col("score").desc())
    by_score = by_score.withColumn("upto", F.sum("m").over(running))
    row = by_score.join(here, ["source", "part"]).where("upto >= nth and upto - m < nth").select("source", "keep", "total", F.col("score").alias("cutoff"))
    kept = sorted_rows.groupBy("source", "score").agg(F.count("*").alias("m")).join(row.withColumnRenamed("source", "s"), F.expr("source = s and score >= cutoff"))
    return kept.groupBy("source", "keep", "cutoff", "total").agg(F.sum("m").alias("n_kept")).select("source", "keep", "cutoff", "n_kept", F.col("total").alias("n_records"))
