"""Problem 5: subsets that show the variety of the texts.

Equal texts count once.  Hashed character features of all texts are clustered by distributed mini-batch k-means; each request
shares its places over the clusters by the square root of their sizes, places a cluster cannot fill go
to the others, and members are drawn by a hash within their quotas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrowtext import codepoints, row_ids, slices
from .neardup import _mix
from .normalize import normalize_codepoints, real_text

DIM, CLUSTERS = 128, 64
NEAR = 0.9  #: squared distance of unit vectors: a cosine of 0.55
SEED_ROUNDS, ROUNDS = 3, 5  #: passes over all texts that propose more seeds, and batches they are cut into that move the centres
SALTS = 32  #: parts of a cluster that are ranked on their own
GRID = 32767  #: vectors are kept as 16-bit integers, so sums are exact and do not depend on their order


def features(cps: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Unit vectors (n, dim) of signed hashed character pairs and triples of each row, counts damped by a square root."""
    n, rows = len(offsets) - 1, row_ids(offsets)
    out = np.zeros(n * dim)
    for k in (2, 3):
        if len(cps) < k:
            continue
        h = np.full(len(cps) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h << np.uint64(21)) ^ cps[i : len(cps) - k + 1 + i].astype(np.uint64)
        inside = rows[: len(h)] == rows[k - 1 :]
        h, r = _mix(h[inside]), rows[: len(inside)][inside]
        sign = np.where(h & np.uint64(1 << 40), 1.0, -1.0)
        out += np.bincount(r * dim + (h % np.uint64(dim)).astype(np.int64), weights=sign, minlength=n * dim)
    out = out.reshape(n, dim)
    out = np.sign(out) * np.sqrt(np.abs(out))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def text_keys(cps: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    out = np.zeros(len(offsets), np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(cps)) - np.repeat(offsets[:-1], np.diff(offsets))
        out[1:] = np.cumsum(_mix(_mix(cps.astype(np.uint64) + np.uint64(seed << 32)) + place.astype(np.uint64)))[offsets[1:] - 1] if len(cps) else 0
        out[np.append(False, offsets[1:] == 0)] = 0
        return _mix(np.diff(out) + np.diff(offsets).astype(np.uint64) + np.uint64(seed)).view(np.int64)


def moved(c: np.ndarray, seen: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A mini-batch step: every centre goes towards the mean of its points of the batch, by their share of all it has ``seen``, which is updated."""
    seen += n
    step = n / np.maximum(seen, 1)
    return c + step[:, None] * (total / np.maximum(n, 1)[:, None] - c) * (n > 0)[:, None]


def far_points(x: np.ndarray, k: int, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` of the points, the first and then each by its weight and its squared distance from those taken; none within ``NEAR`` of another."""
    taken = [x[0]]
    far = ((x - taken[0]) ** 2).sum(1)
    while len(taken) < min(k, len(x)) and far.max() > NEAR:
        far[far <= NEAR] = 0
        p = far * weight
        taken.append(x[rng.choice(len(x), p=p / p.sum())])
        far = np.minimum(far, ((x - taken[-1]) ** 2).sum(1))
    return np.array(taken)


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors (n, DIM) of a column of 16-bit integers, times ``GRID``."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, DIM).astype(np.float64)


def fit_centres(points: DataFrame, k: int, seed: int = 5) -> np.ndarray:
    """Centres (<= k, DIM) of all points (k1, k2, v): k-means|| seeds, then mini-batch k-means; only centres and their sums reach the driver.

    Seeding draws 2k points of all, and then in each round 2k more by their squared distance from those
    proposed so far, without points within ``NEAR`` of one; the proposals, weighted by the points nearest to them, are thinned to k.
    The points are then cut by their keys into ``ROUNDS`` batches that hold all of them, and each batch
    moves the centres once.
    """

    def draw(proposed: np.ndarray, number: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                x = _vectors(b.column(2)) / GRID
                far = np.maximum(((x**2).sum(1)[:, None] - 2 * x @ proposed.T + (proposed**2).sum(1)).min(1), 0) if len(proposed) else np.ones(len(x))
                keys = [np.asarray(b.column(i)).astype(np.int64).view(np.uint64) for i in (0, 1)]
                u = ((_mix(_mix(keys[0] + np.uint64(seed * 1000 + number)) ^ keys[1]) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                ok = np.flatnonzero(far > NEAR)  # the smallest of these waiting times are a draw without replacement by weight
                wait = -np.log(u[ok]) / far[ok]
                first = ok[np.argsort(wait, kind="stable")[: 2 * k]]
                part = pa.table({"wait": -np.log(u[first]) / far[first], "k2": b.column(1).take(pa.array(first)), "k1": b.column(0).take(pa.array(first)), "v": b.column(2).take(pa.array(first))})
                best = (part if best is None else pa.concat_tables([best, part])).sort_by([("wait", "ascending"), ("k2", "ascending"), ("k1", "ascending")]).slice(0, 2 * k)
            if best is not None:
                yield from best.combine_chunks().to_batches()

        got = points.mapInArrow(run, "wait double, k2 long, k1 long, v binary").orderBy("wait", "k2", "k1").limit(2 * k).toArrow()
        return _vectors(got["v"]) / GRID if got.num_rows else np.zeros((0, DIM))

    def sums(c: np.ndarray, points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """How many of the points are nearest to each centre, and their sums."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(c), np.int64), np.zeros((len(c), DIM))
            for b in batches:
                if not b.num_rows:
                    continue
                x = _vectors(b.column(2))
                near = nearest(x / GRID, c)
                order = np.argsort(near, kind="stable")
                at, start = np.unique(near[order], return_index=True)
                total[at] += np.add.reduceat(x[order], start, axis=0)
                n += np.bincount(near, minlength=len(c))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array([r.tobytes() for r in total[at]], pa.binary())], names=["j", "n", "total"])

        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), DIM))
        for r in points.mapInArrow(run, "j int, n long, total binary").toLocalIterator():
            n[r["j"]] += r["n"]
            total[r["j"]] += np.frombuffer(bytes(r["total"]))
        return n, total

    proposed = draw(np.zeros((0, DIM)), 0)  # without proposals every point weighs the same
    if not len(proposed):
        return np.zeros((1, DIM))
    for number in range(1, SEED_ROUNDS + 1):
        more = draw(proposed, number)
        if not len(more):
            break
        proposed = np.concatenate([proposed, more])
    c = far_points(proposed, k, np.maximum(sums(proposed, points)[0], 1).astype(float), np.random.default_rng(seed))
    seen = np.zeros(len(c))
    for number in range(ROUNDS):
        n, total = sums(c, points.where(F.pmod("k2", F.lit(ROUNDS)) == number))
        c = moved(c, seen, n, total / GRID)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def quotas(sizes: np.ndarray, places: int) -> np.ndarray:
    """Places of each cluster: one each while they last, the rest by square root, none above its size, unused ones redistributed.

    Where there are fewer places than clusters the largest get one; ties go to the earlier cluster.
    """
    places = int(min(places, sizes.sum()))
    weight, got = np.sqrt(sizes.astype(float)), np.zeros(len(sizes), np.int64)
    got[np.lexsort((np.arange(len(sizes)), -sizes))[:places]] = 1
    left = places - int(got.sum())
    while left > 0:
        room = sizes - got
        w = np.where(room > 0, weight, 0.0)
        share = np.minimum(np.floor(left * w / w.sum()).astype(np.int64), room)
        if share.sum() == 0:  # less than one place for any: the largest claims that are served least come first
            for j in np.lexsort((np.arange(len(sizes)), -np.where(room > 0, weight / (got + 1), -1)))[:left]:
                share[j] = 1 if room[j] > 0 else 0
        got += share
        left = places - int(got.sum())
    return got


def varied_subsets(texts: DataFrame, categories: DataFrame, requests: DataFrame, id_col: str = "doc_id", text_col: str = "comment", clusters: int = CLUSTERS, seed: int = 5) -> DataFrame:
    """(request_id, category, subset_size, doc_id, cluster, cluster_texts): the subset of every request.

    A request with a null category draws on all texts.  Texts equal in their consistent form count once,
    represented by their smallest id in the category; where fewer exist than asked for, all of them are
    the subset.  Null, empty and ``nan`` texts are never drawn; a request of size null or <= 0 has no
    rows; repeated category rows count once.
    """
    one = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(real_text(F.col("t")) & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.min("t").alias("t"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [1]):
                cps, offsets = normalize_codepoints(*codepoints(part.column(1))[:2])
                v = np.round(features(cps, offsets) * GRID).astype("<i2")
                keys = [pa.array(text_keys(cps, offsets, seed + i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *keys, pa.array([r.tobytes() for r in v], pa.binary())], names=["doc_id", "k1", "k2", "v"])

    # no text travels beyond this: equal texts have equal keys and equal vectors
    docs = checkpointed(one.mapInArrow(vectors, f"doc_id {texts.schema[id_col].dataType.simpleString()}, k1 long, k2 long, v binary"))
    points = checkpointed(docs.select("k1", "k2", "v").dropDuplicates(["k1", "k2"]))
    centres = fit_centres(points, clusters, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(_vectors(b.column(2)) / GRID, centres), pa.int32())], names=["k1", "k2", "cluster"])

    placed = points.mapInArrow(assign, "k1 long, k2 long, cluster int")
    ask = requests.select("request_id", F.col("category"), F.col("subset_size").cast("int").alias("subset_size")).where("subset_size > 0").distinct()
    most = ask.agg(F.max("subset_size")).first()[0] or 0
    keyed = docs.select("doc_id", "k1", "k2")
    in_category = keyed.join(categories.select(F.col(id_col).alias("doc_id"), "category").where("category is not null").distinct(), "doc_id")
    # each category (and "all") is prepared once, however many requests name it
    pools = in_category.join(ask.where("category is not null").select("category").distinct(), "category", "left_semi").select("category", "doc_id", "k1", "k2")
    if not ask.where("category is null").isEmpty():
        pools = pools.union(keyed.select(F.lit(None).cast("string").alias("category"), "doc_id", "k1", "k2"))
    pool = pools.groupBy("category", "k1", "k2").agg(F.min("doc_id").alias("doc_id")).join(placed, ["k1", "k2"])
    # no cluster can give more than the largest request: the first of each of SALTS parts are ranked, and of those the first,
    # so a hot cluster is never sorted in one task, however large the requests are
    place = [F.col("k2"), F.col("k1")]
    sizes = pool.groupBy("category", "cluster").agg(F.count("*").alias("n"))
    part = pool.withColumn("part", F.pmod("k1", F.lit(SALTS)))
    part = part.withColumn("rn", F.row_number().over(Window.partitionBy("category", "cluster", "part").orderBy(*place))).where(F.col("rn") <= most)
    head = part.withColumn("rn", F.row_number().over(Window.partitionBy("category", "cluster").orderBy(*place))).where(F.col("rn") <= most)
    same = F.col("p.category").eqNullSafe(F.col("q.category"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        pdf["quota"] = quotas(pdf["n"].to_numpy(), int(pdf["subset_size"].iloc[0]))
        return pdf[["request_id", "category", "subset_size", "cluster", "n", "quota"]]

    asked = sizes.alias("p").join(ask.alias("q"), same).select("q.request_id", "q.category", "q.subset_size", "p.cluster", "p.n")
    kind = requests.schema["request_id"].dataType.simpleString()
    quota = asked.groupBy("request_id", "subset_size").applyInPandas(share, f"request_id {kind}, category string, subset_size int, cluster int, n long, quota int")
    met = head.alias("p").join(quota.where("quota > 0").alias("q"), same & (F.col("p.cluster") == F.col("q.cluster")))
    return met.where("p.rn <= q.quota").select("q.request_id", "q.category", "q.subset_size", "p.doc_id", "p.cluster", F.col("q.n").alias("cluster_texts"))
