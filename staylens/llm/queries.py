"""Queries of the subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutoff, diverse, mixing, neardup, normalize, packing, pii, sentences, textstats

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalize.same_look_pairs(_read(spark, d, "comments"))


def p1_normal_form(spark: SparkSession, d: str) -> DataFrame:
    one = _read(spark, d, "comments").select("doc_id", "comment").where("doc_id is not null").groupBy("doc_id").agg(F.min("comment").alias("comment"))
    return normalize.with_normal_form(one, "comment", "normal_form").select("doc_id", "normal_form")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(_read(spark, d, "comments")).select("doc_id", "kind", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_read(spark, d, "comments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return textstats.classified(_read(spark, d, "comments")).where("kind <> 'prose'").select("doc_id")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return textstats.classified(_read(spark, d, "comments"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "comments").select("doc_id", "fuzzy_room_type", "quality_score").where("quality_score between 0 and 10 and fuzzy_room_type is not null and doc_id is not null")
    return rows.distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = cutoff.score_cutoffs(_scored(spark, d), _read(spark, d, "cutoff_targets"), "fuzzy_room_type", "quality_score", "doc_id", "keep_pct")
    return found.select(F.col("source").alias("fuzzy_room_type"), F.col("cutoff").cast("int").alias("cutoff"), F.col("n_kept").cast("int").alias("n_kept"))


def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    return diverse.varied_subsets(_read(spark, d, "comments"), _read(spark, d, "comment_categories"), _read(spark, d, "subset_requests"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_read(spark, d, "comments"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(_read(spark, d, "comments"))


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    # a fixed table of a few kinds
    return [(r["container_kind"], r["capacity_tokens"]) for r in _read(spark, d, "container_sizes").collect()]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_read(spark, d, "documents"), _containers(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), _read(spark, d, "container_sizes"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_read(spark, d, "documents")).select("doc_id", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    spans = sentences.sentences(docs)
    return spans.join(docs, "doc_id").select("doc_id", "sentence_no", F.substring("text", F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1).alias("sentence"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (p1_found, p1_normal_form, p2_found, p2_redacted, p3_found, p3_statistics, p4_found, p5_subset, p6_found, p6_groups, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_sentences)
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it in whole; the other operators are tested against brute force and round trips in ``tests/llm``."""
    return {
        "p4_found": """
            with r as (select distinct doc_id, fuzzy_room_type, quality_score from comments where quality_score between 0 and 10 and fuzzy_room_type is not null),
            n as (select fuzzy_room_type, count(*) as total from r group by 1),
            k as (select a.fuzzy_room_type, a.s, count(*) as n_kept from (select distinct fuzzy_room_type, quality_score as s from r) a
                  join r on r.fuzzy_room_type = a.fuzzy_room_type and r.quality_score >= a.s group by 1, 2)
            select k.fuzzy_room_type, cast(max(k.s) as integer) as cutoff, cast(arg_max(k.n_kept, k.s) as integer) as n_kept
            from k join n using (fuzzy_room_type) join cutoff_targets t using (fuzzy_room_type)
            where k.n_kept * 100 >= t.keep_pct * n.total group by k.fuzzy_room_type""",
    }
