"""Reranking and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import or_one, timeliness
from ..schema import SearchConfig


def rerank(candidates: DataFrame, relevance: Column, topk: int, digits: int = 6) -> DataFrame:
    """The best ``topk`` of each query by relevance, ties in fused order; missing relevance counts as 0."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "fused_rank")
    out = candidates.withColumn("rerank_score", F.round(F.coalesce(relevance, F.lit(0.0)), digits))
    return out.withColumn("rerank_rank", F.row_number().over(w).cast("long")).where(F.col("rerank_rank") <= topk)


def attach_by_position(candidates: DataFrame, result: DataFrame) -> DataFrame:
    """Rerank results (query_id, index from 0, relevance) joined to the candidate at that place of the fused order."""
    at = candidates.withColumn("index", F.col("fused_rank") - 1)
    return at.join(result, ["query_id", "index"]).drop("index")


def composite(ranked: DataFrame, sensitive: Column, cfg: SearchConfig, topk: int | None = None, digits: int = 6) -> DataFrame:
    """Weighted features normalised by the maxima of the query's own set, and the final rank."""
    per, w = Window.partitionBy("query_id"), cfg.weights
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / or_one(F.max(F.coalesce(F.col(c), F.lit(0))).over(per))
    out = ranked.withColumn("timeliness", timeliness(F.col("publish_date"), sensitive, cfg))
    score = (
        F.lit(w.relevance) * F.col("rerank_score")
        + F.lit(w.quality) * F.coalesce(F.col("quality_score"), F.lit(0)) / 10.0
        + F.lit(w.length) * part("comment_len")
        + F.lit(w.reviews) * part("review_count")
        + F.lit(w.likes) * part("useful_count")
        + F.lit(w.timeliness) * F.col("timeliness")
    )
    out = out.withColumn("final_score", F.round(score, digits))
    last = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "rerank_rank")
    out = out.withColumn("final_rank", F.row_number().over(last).cast("long"))
    return out.where(F.col("final_rank") <= topk) if topk else out
