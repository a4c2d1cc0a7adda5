"""Problem 8: a mixture of sources with target shares of the total size.

Poisson replication: a uniform number hashed from the document's id is put through the inverse of a
Poisson distribution whose mean is the source's target repetition rate, cut at the source's most
repeats; documents are exploded by their counts and shuffled globally.  The mean is calibrated on the
hashed numbers themselves, so shares are met to within about one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokens import count_tokens, default_partitions, vocabulary

MOST_SOURCES = 100_000  #: more targets than this are refused: they are held on the driver
MOST_BYTES = 64 << 20  #: larger tables of thresholds are refused: they are broadcast
FILL = 0.9  #: share of the largest reachable total that is drawn by default


@dataclass(frozen=True)
class Plan:
    """What one source contributes; ``cdf`` holds P(count <= k) for k below the most repeats."""

    source: str
    target_weight: float
    max_repeats: int
    n_docs: int
    source_tokens: int
    goal: float
    mean: float
    cdf: tuple[float, ...]


def poisson_cdf(mean: float, most: int) -> tuple[float, ...]:
    """P(X <= k) for k = 0 … most - 1; terms are taken from their logarithms, so any mean will do."""
    if most <= 0:
        return ()
    if mean <= 0:
        return (1.0,) * most
    k = np.arange(most)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])
    return tuple(np.minimum(np.cumsum(np.exp(k * math.log(mean) - mean - log_factorial)), 1.0).tolist())


def capped_mean(mean: float, most: int) -> float:
    """E[min(X, most)] of a Poisson variable."""
    return most - math.fsum(poisson_cdf(mean, most))


def mean_for(rate: float, most: int) -> float:
    """The Poisson mean whose capped expectation is ``rate``; of a rate of ``most`` or more, one that reaches the cap to one in a million."""
    rate = min(rate, most * (1 - 1e-6))
    lo, hi = 0.0, 1.0
    while capped_mean(hi, most) < rate:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, most) < rate else (lo, mid)
    return (lo + hi) / 2


def _sized(documents: DataFrame, targets: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, path: str) -> DataFrame:
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    # Spark broadcasts the targets if it finds them small; documents of other sources are not tokenized
    docs = docs.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi").select("doc_id", "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count_tokens(b.column(2).to_pylist(), path), pa.int64())], names=["doc_id", "source", "n_tokens"])

    sized = docs.mapInArrow(run, f"doc_id {kind}, source string, n_tokens long")
    return sized.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53)))


def plan_mixture(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, fill: float = FILL, rounds: int = 4, steps: int = 8) -> list[Plan]:
    """The repetition means of the sources, one plan a target.

    Sources without tokens cannot contribute; the others keep their relative weights.  Without
    ``total_tokens`` the total is ``fill`` of the largest one that no cap forbids; a larger wish is cut
    to what the caps allow.  ValueError for more than ``MOST_SOURCES`` sources, and for thresholds that
    would take more than ``MOST_BYTES``: both are held on the driver and broadcast.
    """
    spark = sized.sparkSession
    wish = targets.where("source is not null and target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).limit(MOST_SOURCES + 1).collect()
    if len(wish) > MOST_SOURCES:
        raise ValueError("too many sources")
    if 8 * (steps + 1) * sum(r["r"] for r in wish) > MOST_BYTES:
        raise ValueError("too many repeats of too many sources")
    have = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    able = {r["source"]: r for r in wish if have.get(r["source"], (0, 0))[1] > 0}
    weight = math.fsum(r["w"] for r in able.values())
    most = min((r["r"] * have[s][1] * weight / r["w"] for s, r in able.items()), default=0.0)
    total = min(total_tokens, 0.999 * most) if total_tokens else fill * most
    goals = {s: r["w"] / weight * total for s, r in able.items()}
    centre = {s: mean_for(goals[s] / have[s][1], r["r"]) for s, r in able.items()}
    low, high = {s: 0.0 for s in able}, {s: 4 * m + 1e-6 for s, m in centre.items()}
    if able:
        low, high = {s: 0.7 * m for s, m in centre.items()}, {s: 1.4 * m for s, m in centre.items()}
    best = dict(centre)
    gap = {s: math.inf for s in able}
    for _ in range(rounds if able else 0):
        grid = [(s, g, low[s] + (high[s] - low[s]) * g / steps) for s in able for g in range(steps + 1)]
        table = spark.createDataFrame([(s, g, list(poisson_cdf(m, able[s]["r"]))) for s, g, m in grid], "source string, g int, cdf array<double>")
        # a few rows for each target, refused above MOST_BYTES
        drawn = sized.join(F.broadcast(table), "source").groupBy("source", "g").agg(F.sum(F.col("n_tokens") * F.expr("size(filter(cdf, c -> c < u))")).alias("t")).collect()
        got = {(r["source"], r["g"]): r["t"] for r in drawn}
        for s in able:
            under = [g for g in range(steps + 1) if got[s, g] <= goals[s]]
            means = {g: m for t, g, m in grid if t == s}
            for g in means:
                if abs(got[s, g] - goals[s]) < gap[s]:
                    gap[s], best[s] = abs(got[s, g] - goals[s]), means[g]
            k = max(under, default=0)
            low[s], high[s] = means[k], means[min(k + 1, steps)]
    return [
        Plan(r["source"], r["w"], r["r"], *have.get(r["source"], (0, 0)), goals.get(r["source"], 0.0), best.get(r["source"], 0.0), poisson_cdf(best.get(r["source"], 0.0), r["r"]))
        for r in sorted(wish, key=lambda r: r["source"])
    ]


def _drawn(sized: DataFrame, plans: list[Plan]) -> DataFrame:
    table = sized.sparkSession.createDataFrame([(p.source, list(p.cdf)) for p in plans], "source string, cdf array<double>")
    return sized.join(F.broadcast(table), "source").withColumn("copies", F.expr("size(filter(cdf, c -> c < u))")).drop("cdf")


def mixture(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: float | None = None, fill: float = FILL, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens, position_key): the mixture, globally shuffled.

    Rows are spread by a hash over all partitions and ordered by it inside each.  Documents of null or
    unlisted sources take no part; empty and null texts have no tokens but may be drawn.
    """
    sized = checkpointed(_sized(documents, targets, id_col, source_col, text_col, seed, tokenizer or vocabulary()))
    plans = plan_mixture(sized, targets, total_tokens, fill)
    rows = _drawn(sized, plans).where("copies > 0").select("source", "doc_id", F.explode(F.expr("sequence(1, copies)")).alias("copy_no"), "n_tokens")
    rows = rows.withColumn("position_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
    return rows.repartition(default_partitions(documents.sparkSession), "position_key").sortWithinPartitions("position_key")


def mixture_shares(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: float | None = None, fill: float = FILL, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """One row a target: its weight, repetition mean, what was drawn and the actual share of all tokens."""
    sized = checkpointed(_sized(documents, targets, id_col, source_col, text_col, seed, tokenizer or vocabulary()))
    plans = plan_mixture(sized, targets, total_tokens, fill)
    known = documents.sparkSession.createDataFrame([(p.source, p.target_weight, p.max_repeats, p.n_docs, p.source_tokens, p.mean) for p in plans], "source string, target_weight double, max_repeats int, n_docs long, source_tokens long, mean_repeats double")
    drawn = _drawn(sized, plans).groupBy("source").agg(F.sum("copies").cast("long").alias("n_rows"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_repeats"))
    # one row a target: the total is taken over this table of bounded size
    out = known.join(drawn, "source", "left").withColumn("total", F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
    zero = F.lit(0)
    return out.select("source", "target_weight", "max_repeats", "n_docs", "source_tokens", "mean_repeats", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("most_repeats", zero).alias("most_repeats"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
