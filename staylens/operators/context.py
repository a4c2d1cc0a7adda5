"""Evidence context, summaries and output projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview


def _four(c: str) -> Column:
    """Four places, half up on the decimal digits."""
    return F.round(F.col(c).cast("decimal(18,6)"), 4).cast("double")


def first_summaries(hits: DataFrame) -> DataFrame:
    """One row a query and category: the first by sub-query and rank."""
    rest = [c for c in hits.columns if c not in ("query_id", "category")]
    first = hits.groupBy("query_id", "category").agg(F.min(F.struct("query_idx", "rank", F.struct(*rest).alias("row"))).alias("f"))
    return first.select("query_id", "category", *[F.col(f"f.row.{c}").alias(c) for c in rest])


def context(summaries: DataFrame, comments: DataFrame) -> DataFrame:
    """(query_id, context): the summary block, then the numbered comments, joined by blank lines.

    Either block is left out where a query has none.
    """
    s_text = F.concat(F.lit("- "), F.col("category"), F.lit(" ("), F.col("comment_count").cast("string"), F.lit(" comments): "), F.col("summary"))
    s = summaries.withColumn("t", s_text).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("query_idx", "rank", "t"))).alias("s"))
    c_text = F.concat(
        F.lit("["), F.col("final_rank").cast("string"), F.lit("] room: "), F.col("room_type"), F.lit(", score: "), F.format_string("%.1f", F.col("score_val")),
        F.lit(", date: "), F.col("publish_date"), F.lit("\n"), F.col("comment"),
    )
    c = comments.withColumn("t", c_text).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "t"))).alias("c"))
    both = s.join(c, "query_id", "full")
    head = lambda title, col: F.when(F.col(col).isNotNull(), F.concat_ws("\n\n", F.lit(title), F.concat_ws("\n\n", F.transform(col, lambda x: x["t"]))))
    return both.select("query_id", F.concat_ws("\n\n", head("# Category summaries", "s"), head("# Guest comments", "c")).alias("context"))


def result_rows(final: DataFrame) -> DataFrame:
    """What is shown of the final comments: rounded scores and a 300-character preview."""
    return final.select(
        "query_id", F.col("final_rank").alias("rank"), _four("final_score").alias("score"), _four("rerank_score").alias("rerank_score"), "doc_id", "room_type", "score_val", "publish_date", "quality_score",
        preview(F.col("comment"), 300).alias("comment"), "routes",
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select("category", preview(F.col("summary"), 200, always=True).alias("summary"), "comment_count")
