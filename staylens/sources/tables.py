"""Readers and writers: comments, reverse queries, summaries, stop words, stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEFAULTS, REVERSE_QUERIES, SUMMARIES


class StoreMissing(RuntimeError):
    """A store that must exist does not."""


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as strings, named by its heading, whatever their order."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_comments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comments from CSV whose first column is the row id; a missing file gives an empty table."""
    if not exists(spark, path):
        return typed(spark.createDataFrame([], "doc_id string, " + ", ".join(f"{c} string" for c in DEFAULTS)))
    table = _csv(spark, path)
    return typed(table.withColumnRenamed(table.columns[0], "doc_id"))


def typed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every known column cast with its default where missing or unreadable; the key as a string.

    A whole number written as ``4.0``, as columns with gaps come out of other tools, is read as 4.
    """
    kinds = {str: "string", float: "double", int: "int"}
    cols = [F.col(key).cast("string").alias(key)]
    for name, default in DEFAULTS.items():
        kind = kinds[type(default)]
        value = F.col(name) if name in df.columns else F.lit(None)
        value = value.try_cast("double").try_cast("int") if kind == "int" else value.try_cast(kind)
        cols.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return df.select(*cols)


def one_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order`` (nulls lowest); a map-side combinable maximum, no window."""
    rest = [c for c in df.columns if c != key]
    best = F.max(F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))
    return df.groupBy(key).agg(best.alias("_best")).select(key, *[F.col(f"_best.row.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, to: str) -> DataFrame:
    """``df`` with ``to`` = the dense position of each row in the order of its partitions, from 0."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", 33)
    # one row a partition: the rows before each are a running total over these few counts
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = rows.withColumn("_part", part).join(starts, "_part")
    return out.withColumn(to, F.col("_start") + F.col("_at") - F.shiftleft(F.col("_part"), 33)).select(*df.columns, to)


def read_reverse_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generated questions from CSV; the id is ``query_<row position>``, dense and in file order."""
    if not exists(spark, path):
        return spark.createDataFrame([], "query_id string, " + REVERSE_QUERIES)
    table = _csv(spark, path)
    names = [c.split()[0] for c in REVERSE_QUERIES.split(", ")]
    table = table.select(*[(F.col(c) if c in table.columns else F.lit(None)).cast("string").alias(c) for c in names])
    return numbered(table, "_no").select(F.concat(F.lit("query_"), F.col("_no").cast("string")).alias("query_id"), *names)


def read_summaries_json(spark: SparkSession, path: str) -> DataFrame:
    """Category summaries from a JSON array of objects; a missing file gives an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], SUMMARIES)
    return spark.read.schema(SUMMARIES).option("multiLine", True).json(path)


def read_stop_words(spark: SparkSession, path: str, english: bool = True) -> DataFrame:
    """Distinct stop words: one a line, trimmed, blanks dropped; with the library's English list where wanted."""
    from pyspark.ml.feature import StopWordsRemover

    words = spark.createDataFrame([], "word string")
    if exists(spark, path):
        words = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("word")).where("word <> ''")
    if english:
        words = words.union(spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], "word string"))
    return words.distinct()


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A store that must exist (``StoreMissing`` otherwise)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise StoreMissing(path) from e


def get_or_create(spark: SparkSession, path: str, schema: str, partition: str | None = None) -> tuple[DataFrame, int]:
    """The store at ``path``, made empty where missing, and its row count; ``partition`` is the column of its folders.

    A folder without any table in it, as a creation that was cut off leaves it, is made anew.
    """
    try:
        spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    reader = spark.read.schema(schema) if partition else spark.read
    df = reader.parquet(path)
    return df, df.count()


def stringified(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns renamed and stored as strings, as a vector store's fields."""
    return df.select(*[F.col(v).cast("string").alias(k) for k, v in fields.items()])


def with_fallback(hits: DataFrame, comments: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Hits joined to comments: the stored field where present, else the comment's, else an empty string."""
    meta = comments.select(F.col("doc_id").alias("_k"), *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = hits.join(meta, F.col(key) == F.col("_k"), "left")
    stored = [F.coalesce(*([F.col(c)] if c in hits.columns else []), F.col(f"_m_{c}"), F.lit("")).alias(c) for c in columns]
    return joined.select(*[c for c in hits.columns if c not in columns], *stored)
