"""Building the stores: embedding in batches, idempotent upserts, the lexical index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Embedder, HashEmbedder
from ..operators.bm25 import Bm25Index
from ..session import checkpointed
from ..sources import tables as S

COMMENT_STORE = "doc_id string, room_type string, fuzzy_room_type string, embedding array<float>"
QUESTION_STORE = "question_id string, comment_id string, room_type string, fuzzy_room_type string, embedding array<float>"


@dataclass
class Stores:
    """The built tables under one path."""

    spark: SparkSession
    path: str

    def comments(self) -> DataFrame:
        return S.open_store(self.spark, f"{self.path}/comments")

    def comment_vectors(self) -> DataFrame:
        return S.open_store(self.spark, f"{self.path}/comment_vectors")

    def question_vectors(self) -> DataFrame:
        return S.open_store(self.spark, f"{self.path}/question_vectors")

    def category_vectors(self) -> DataFrame:
        return S.open_store(self.spark, f"{self.path}/category_vectors")


def embedded(df: DataFrame, text: str, embedder: Embedder, batch: int = 64, keep: bool = False) -> DataFrame:
    """``df`` with its ``text`` replaced by ``embedding`` (or, with ``keep``, beside it); rows whose batch fails are left out, so a later run retries them."""
    rest = [f for f in df.schema.fields if keep or f.name != text]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", embedding array<float>"
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    vectors = embedder.embed(part[text].fillna("").tolist())
                except Exception:  # noqa: BLE001 - counted by what is missing afterwards
                    continue
                yield part[names].assign(embedding=vectors)

    return df.mapInPandas(run, out)


#: What orders the repeated rows of a comment: the newest counts win.
NEWEST = ["useful_count", "review_count", "score", "publish_date", "comment_len", "images"]
BUCKETS = 64  #: folders of a store by the hash of its key; an update rewrites those it touches


def one_row_each(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row a key, the greatest in ``order`` (all other columns where not given), so the choice is the same in every run."""
    return S.one_per_key(rows, key, order or sorted(c for c in rows.columns if c != key))


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str, text: str, schema: str, embedder: Embedder) -> tuple[int, int]:
    """Embeds the rows that are missing in the store or differ from what is stored; returns (written, failed).

    Running it again, or after a part was lost, completes the store; nothing that is unchanged is
    embedded twice.  Changed rows replace the old ones: the folders they lie in are rewritten, and a row
    whose embedding fails keeps its old form until the next run.
    """
    have, _ = S.get_or_create(spark, path, f"{schema}, content long, bucket int", "bucket")
    fields = [f.name for f in have.schema.fields if f.name not in ("content", "bucket")]
    content = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in [text, *[f for f in fields if f not in (key, "embedding")]]])
    rows = one_row_each(new, key).select(*dict.fromkeys([key, text, *[f for f in fields if f != "embedding"]]), content.alias("content"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"))
    todo = checkpointed(rows.join(have.select(key, "content"), [key, "content"], "left_anti"))
    made = checkpointed(embedded(todo, text, embedder, keep=text in fields))
    replaced = have.join(made.select(key, "bucket"), [key, "bucket"], "left_semi")
    columns = [*fields, "content", "bucket"]
    if replaced.isEmpty():
        made.select(*columns).write.mode("append").partitionBy("bucket").parquet(path)
    else:
        touched = [r[0] for r in made.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        kept = checkpointed(have.where(F.col("bucket").isin(touched)).join(made.select(key), key, "left_anti").select(*columns))
        both = kept.unionByName(made.select(*columns))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    written = made.count()
    return written, todo.count() - written


def store_comments(spark: SparkSession, path: str, comments: DataFrame) -> DataFrame:
    """The comments' records put into their store, one typed row each, changed ones replaced; returns those that are new or changed."""
    rows = S.typed(one_row_each(comments.where("doc_id is not null"), "doc_id", [c for c in NEWEST if c in comments.columns])).withColumnRenamed("score", "score_val")
    rows = checkpointed(rows)
    if not S.exists(spark, f"{path}/comments"):
        rows.write.parquet(f"{path}/comments")
        return rows
    have = spark.read.parquet(f"{path}/comments")
    changed = checkpointed(rows.exceptAll(have.select(*rows.columns)))
    if not changed.isEmpty():
        checkpointed(have.select(*rows.columns).join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)).write.mode("overwrite").parquet(f"{path}/comments")
    return changed


def build(spark: SparkSession, path: str, comments: DataFrame, questions: DataFrame, summaries: DataFrame, stop_words: DataFrame | None = None, embedder: Embedder | None = None) -> dict[str, tuple[int, int]]:
    """All stores in order: comments, their vectors, questions, summaries, index; counts of written and failed rows.

    A comment that comes in several rows is stored once, with its newest counts.
    """
    embedder = embedder or HashEmbedder()
    changed = store_comments(spark, path, comments)
    stored = spark.read.parquet(f"{path}/comments")
    counts = {"comments": upsert(spark, stored.select("doc_id", "comment", "room_type", "fuzzy_room_type"), f"{path}/comment_vectors", "doc_id", "comment", COMMENT_STORE, embedder)}
    q = questions.where("query is not null and comment_id is not null").select(F.col("query_id").alias("question_id"), "query", "comment_id", "room_type", "fuzzy_room_type")
    counts["questions"] = upsert(spark, q, f"{path}/question_vectors", "question_id", "query", QUESTION_STORE, embedder)
    expected = summaries.count()
    if not S.exists(spark, f"{path}/category_vectors") or spark.read.parquet(f"{path}/category_vectors").count() < expected:
        keyed = summaries.withColumn("text", F.coalesce("keywords", F.lit("")))
        embedded(keyed, "text", embedder).write.mode("overwrite").parquet(f"{path}/category_vectors")
    counts["summaries"] = (expected, 0)
    index(spark, path, stored, changed, stop_words)
    return counts


def index(spark: SparkSession, path: str, stored: DataFrame, changed: DataFrame, stop_words: DataFrame | None = None) -> Bm25Index:
    """The lexical index of the stored comments: built where there is none, else with the changed ones put in."""
    if not S.exists(spark, f"{path}/index/stats"):
        return Bm25Index.load_or_build(spark, f"{path}/index", stored, stop_words=stop_words)
    old = Bm25Index.load(spark, f"{path}/index")
    return old if changed.isEmpty() else old.add(f"{path}/index", changed)


def ingest_comments(spark: SparkSession, path: str, comments: DataFrame, embedder: Embedder | None = None, stop_words: DataFrame | None = None) -> tuple[int, int]:
    """New and changed comments into all stores of comments: records, vectors and index; (written, failed) vectors."""
    changed = store_comments(spark, path, comments)
    done = upsert(spark, changed.select("doc_id", "comment", "room_type", "fuzzy_room_type"), f"{path}/comment_vectors", "doc_id", "comment", COMMENT_STORE, embedder or HashEmbedder())
    index(spark, path, spark.read.parquet(f"{path}/comments"), changed, stop_words)
    return done
