"""Recall lists: union, ranks and reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rrf_term
from ..schema import HYDE_LIST, ROUTES

LIST = ["query_id", "list_no"]


def list_number(source: Column, query_idx: Column) -> Column:
    """The place of a list: sub-query by sub-query in route order, the hypothetical answer last."""
    route = reduce(lambda c, kv: c.when(source == kv[0], F.lit(kv[1])), ROUTES.items(), F.when(source == "hyde", F.lit(None).cast("int")))
    return F.when(source == "hyde", F.lit(HYDE_LIST)).otherwise(query_idx * len(ROUTES) + route).cast("long")


def union_lists(*lists: DataFrame) -> DataFrame:
    """Bag union of recall lists (query_id, query_idx, source, hit_rank, doc_id, score) with their list numbers."""
    rows = reduce(lambda a, b: a.unionByName(b), lists)
    return rows.withColumn("list_no", list_number(F.col("source"), F.col("query_idx")))


def rank_lists(rows: DataFrame, topk: int | None = None) -> DataFrame:
    """1-based ranks inside each list by score; equal scores keep arrival order, missing scores come last."""
    w = Window.partitionBy(*LIST).orderBy(F.col("score").desc_nulls_last(), "hit_rank", "doc_id")
    out = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= topk) if topk else out


def fuse(ranked: DataFrame, k: int = 60, digits: int = 10, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, rrf, first_list, first_rank, source, query_idx, hits, routes, fused_rank).

    A document that is twice in a list adds twice.  What is carried along is the first appearance in
    list order; routes are told in that order.  Equal scores go to the earlier first appearance.
    """
    place = F.struct("list_no", "rank")
    route = F.concat(F.col("source"), F.lit(": #"), F.col("rank").cast("string"), F.lit(" (Q"), F.col("query_idx").cast("string"), F.lit(")"))
    grouped = ranked.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(rrf_term(F.col("rank"), k)), digits).alias("rrf"),
        F.min(F.struct("list_no", "rank", "source", "query_idx")).alias("first"),
        F.count("*").alias("hits"),
        F.array_sort(F.collect_list(F.struct(place.alias("at"), route.alias("route")))).alias("told"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "first.list_no", "first.rank")
    out = grouped.withColumn("fused_rank", F.row_number().over(w).cast("long"))
    if limit:
        out = out.where(F.col("fused_rank") <= limit)
    return out.select(
        "query_id", "doc_id", "rrf", F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank"), F.col("first.source").alias("source"), F.col("first.query_idx").alias("query_idx"), "hits",
        F.array_distinct(F.transform("told", lambda x: x["route"])).alias("routes"), "fused_rank",
    )
