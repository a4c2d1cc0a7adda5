"""Scoring expressions of the retrieval and ranking formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SearchConfig


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: float, b: float) -> Column:
    return weight * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))))


def rrf_term(rank: Column, k: int) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def parsed_date(c: Column) -> Column:
    """A date from year-month-day with dashes and nothing else; null for all other spellings."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "y-M-d"))


def timeliness(publish_date: Column, sensitive: Column, cfg: SearchConfig) -> Column:
    """1 at the reference date, falling to 0 over the horizon; 0.5 where time does not matter or the date cannot be read."""
    days = F.datediff(F.lit(cfg.reference_date), parsed_date(publish_date))
    return F.when(sensitive & days.isNotNull(), F.greatest(F.lit(0.0), 1.0 - days / F.lit(float(cfg.horizon_days)))).otherwise(F.lit(0.5))


def or_one(c: Column) -> Column:
    """The value, or 1 where it is zero or missing."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
