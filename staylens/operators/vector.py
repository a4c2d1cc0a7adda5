"""Vector search: exact in blocks, and an inverted-file option."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpointed

BLOCK = 8192  #: queries that share one pass over the collection
AT_A_TIME = 512  #: of them multiplied at a time


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of a list column, unit length; null, zero and odd-sized vectors are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    if not len(lengths) or lengths.max() == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = int(np.bincount(lengths[lengths > 0]).argmax())
    rows = np.flatnonzero(lengths == dim)
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.asarray(flat).reshape(len(rows), dim)
    size = np.linalg.norm(x, axis=1)
    ok = np.isfinite(size) & (size > 0)
    return rows[ok], x[ok]


def _blocks(queries: DataFrame, filters: list[str]) -> Iterator[tuple[list, np.ndarray, list[list]]]:
    """The stated query set in blocks of at most ``BLOCK``: in one read where it fits one, else partition by partition."""
    rows = queries.select("query_id", "embedding", *filters).where("embedding is not null")
    few = rows.limit(BLOCK + 1).collect()
    source = iter(few) if len(few) <= BLOCK else rows.toLocalIterator()
    while block := list(islice(source, BLOCK)):
        yield [r["query_id"] for r in block], np.array([r["embedding"] for r in block], float), [[r[f] for f in filters] for r in block]


def _trim(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best ``k`` (scores, keys) of the parts as one part; ties go to the smaller key."""
    s, who = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if len(s) <= k:
        return [(s, who)]
    edge = np.partition(s, len(s) - k)[len(s) - k]
    sure, tie = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
    tie = tie[np.argsort(who[tie], kind="stable")][: k - len(sure)]
    keep = np.concatenate([sure, tie])
    return [(s[keep], who[keep])]


def cosine_topk(collection: DataFrame, queries: DataFrame, key: str, k: int, filters: dict[str, str] | None = None, digits: int = 6, unit: bool = False) -> DataFrame:
    """(query_id, key, score, rank): for each query the ``k`` nearest rows of the collection.

    ``filters`` maps collection columns to query columns; a query value that is not null or empty must be
    equal, and rows are filtered **before** the top k.  ``unit`` skips the division by lengths for unit
    vectors.  ``BLOCK`` queries share one pass over the collection; a task passes on at most ``k`` rows a
    query, and rows that no filter of a query lets through are not multiplied.  Ties go to the smaller key.
    """
    filters = filters or {}
    names = list(filters)
    cols = collection.select(key, "embedding", *names)
    kind, qkind = collection.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    arrow_key, arrow_query = to_arrow_type(collection.schema[key].dataType), to_arrow_type(queries.schema["query_id"].dataType)
    out = None
    for ids, q, wanted in _blocks(queries, list(filters.values())):
        scale = np.ones(len(q)) if unit else 1 / np.maximum(np.linalg.norm(q, axis=1), 1e-300)

        # queries with the same filters share its rows
        groups: dict[tuple, list[int]] = {}
        for j, values in enumerate(wanted):
            groups.setdefault(tuple(v or None for v in values), []).append(j)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, groups=groups, scale=scale) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
            for b in batches:
                rows, x = matrix(b.column(1))
                if not len(rows):
                    continue
                if not unit:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                keys = np.asarray(b.column(0).to_numpy(zero_copy_only=False))[rows]
                equal: dict[tuple, np.ndarray] = {}
                for values, members in groups.items():
                    ok = np.ones(len(rows), bool)
                    for i, value in enumerate(values):
                        if value is not None:
                            if (i, value) not in equal:
                                equal[i, value] = np.asarray(pc.equal(b.column(2 + i), value).fill_null(False))[rows]
                            ok &= equal[i, value]
                    if not ok.any():
                        continue
                    some, who = (x, keys) if ok.all() else (x[ok], keys[ok])
                    for at in range(0, len(members), AT_A_TIME):
                        part = members[at : at + AT_A_TIME]
                        scores = np.round(some @ q[part].T * scale[part], digits)
                        for n, j in enumerate(part):
                            best[j] = _trim([*best[j], (scores[:, n], who)], k)
            got = [(i, *p) for i, parts in zip(ids, best) for p in parts]
            if got:
                n = [len(s) for _, s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([i for i, _, _ in got], n).tolist(), arrow_query), pa.array(np.concatenate([w for _, _, w in got]).tolist(), arrow_key), pa.array(np.concatenate([s for _, s, _ in got]))],
                    names=["query_id", key, "score"],
                )

        part = cols.mapInArrow(run, f"query_id {qkind}, {key} {kind}, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = collection.sparkSession.createDataFrame([], f"query_id {qkind}, {key} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def pairwise_best(collection: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, best): how many rows of the collection each query was multiplied with, and the greatest dot product.

    Each task multiplies its batches with a block of queries and passes on one row a query; null and
    odd-sized vectors have no product.
    """
    qkind = queries.schema["query_id"].dataType.simpleString()
    arrow_query = to_arrow_type(queries.schema["query_id"].dataType)
    out = None
    for ids, q, _ in _blocks(queries, []):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            n, best = 0, np.full(len(ids), -np.inf)
            for b in batches:
                lists = b.column(0)
                rows = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == q.shape[1])
                if len(rows):
                    x = np.asarray(lists.take(pa.array(rows)).flatten().cast(pa.float64())).reshape(len(rows), -1)
                    n += len(rows)
                    best = np.maximum(best, (x @ q.T).max(0))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_query), pa.array([n] * len(ids), pa.int64()), pa.array(best)], names=["query_id", "n", "best"])

        part = collection.select("embedding").mapInArrow(run, f"query_id {qkind}, n long, best double")
        out = part if out is None else out.union(part)
    if out is None:
        out = collection.sparkSession.createDataFrame([], f"query_id {qkind}, n long, best double")
    return out.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


@dataclass
class IvfIndex:
    """Inverted file: rows by their nearest coarse centre.  Centres are fitted on a bounded sample, every row is indexed."""

    rows: DataFrame
    centres: np.ndarray
    key: str
    sample: np.ndarray  #: the unit vectors the centres are fitted on

    @classmethod
    def build(cls, collection: DataFrame, key: str, cells: int = 32, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> IvfIndex:
        """``sample`` bounds the vectors the centres are fitted on."""
        some = collection.select("embedding").where("embedding is not null").orderBy(F.xxhash64(key, F.lit(seed))).limit(sample).toArrow()
        _, x = matrix(some.column(0)) if some.num_rows else (None, np.zeros((0, 1)))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else x
        c = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
        for _ in range(rounds if len(x) else 0):
            near = (x @ c.T).argmax(1)
            c = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        kind = collection.schema[key].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, y = matrix(b.column(1))
                if len(rows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((y @ c.T).argmax(1).astype(np.int32))], names=[key, "embedding", "cell"])

        placed = collection.select(key, F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(assign, f"{key} {kind}, embedding array<float>, cell int")
        return cls(checkpointed(placed), c, key, x)

    def probes_for(self, q: np.ndarray, k: int, recall: float) -> int:
        """The fewest probes that find ``recall`` of the true ``k`` nearest rows of the sample for the unit queries ``q``.

        In a sample of a larger collection the ``k`` nearest reach farther out than in all rows, so the
        figure errs to more probes.
        """
        x, c = self.sample, self.centres
        if not len(x) or not len(q):
            return len(c)
        cell, depth, met = (x @ c.T).argmax(1), min(k, len(x)), np.zeros(len(c), np.int64)
        for one in q:
            place = np.argsort(np.argsort(-(c @ one)))
            met += np.bincount(place[cell[np.argpartition(-(x @ one), depth - 1)[:depth]]], minlength=len(c))
        return int(np.searchsorted(np.cumsum(met), recall * met.sum()) + 1)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6, recall: float = 0.95) -> DataFrame:
        """As ``cosine_topk`` over the ``probes`` nearest cells of each query; a hot cell stays spread over tasks.

        Where ``probes`` is not given, each block of queries takes as many as measure ``recall`` on the sample.
        """
        key, c = self.key, self.centres
        kind, qkind = self.rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        arrow_key, arrow_query = to_arrow_type(self.rows.schema[key].dataType), to_arrow_type(queries.schema["query_id"].dataType)
        out = None
        for ids, q, _ in _blocks(queries, []):
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            many = self.probes_for(q, k, recall) if probes is None else probes
            order = np.argsort(-(q @ c.T), axis=1)[:, :many] if len(c) else np.zeros((len(q), 0), int)
            asked = np.zeros((len(c), len(q)), bool)
            asked[order, np.arange(len(q))[:, None]] = True

            def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, asked=asked) -> Iterator[pa.RecordBatch]:
                best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
                for b in batches:
                    rows, x = matrix(b.column(1))
                    if not len(rows):
                        continue
                    cell = np.asarray(b.column(2))[rows]
                    scores = np.round(x @ q.T / np.linalg.norm(x, axis=1, keepdims=True), digits)
                    keys = np.asarray(b.column(0).to_numpy(zero_copy_only=False))[rows]
                    for j in range(len(ids)):
                        ok = asked[cell, j]
                        if ok.any():
                            best[j] = _trim([*best[j], (scores[ok, j], keys[ok])], k)
                got = [(i, *p) for i, parts in zip(ids, best) for p in parts]
                if got:
                    n = [len(s) for _, s, _ in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([i for i, _, _ in got], n).tolist(), arrow_query), pa.array(np.concatenate([w for _, _, w in got]).tolist(), arrow_key), pa.array(np.concatenate([s for _, s, _ in got]))],
                        names=["query_id", key, "score"],
                    )

            part = self.rows.select(key, "embedding", "cell").mapInArrow(run, f"query_id {qkind}, {key} {kind}, score double")
            out = part if out is None else out.union(part)
        if out is None:
            out = self.rows.sparkSession.createDataFrame([], f"query_id {qkind}, {key} {kind}, score double")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
        return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
