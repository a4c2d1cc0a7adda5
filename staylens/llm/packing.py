"""Problem 7: documents packed into containers of fixed capacity.

Large-item matching: items above a third of the capacity go at most two to a container, matched
greedily from the largest on with the largest partner that fits; smaller items then fill the remaining
gaps best-fit, largest first.  Which documents share a container is free, so each input partition is
packed on its own as it is tokenized: no shuffle, and at most a few containers of a kind are left
unfilled in a partition.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import count_tokens, vocabulary

SCHEMA = "container_kind string, container_id string, doc_id {}, piece_no int, start_token int, n_tokens int"


def pack_items(sizes: Sequence[int], capacity: int) -> list[int]:
    """The container number of each item; sizes are from 0 to ``capacity`` (ValueError above it).

    Ties go to the item that comes first.  Items of size 0 are put where there is room.
    """
    if any(s > capacity or s < 0 for s in sizes):
        raise ValueError("an item does not fit")
    where = [-1] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))
    split = bisect_right([sizes[i] for i in order], capacity // 3)
    large, small = order[split:], order[:split]
    large_sizes = [sizes[i] for i in large]
    # the greatest large item at or below a place that is still free: places taken point on to the one before
    free = list(range(len(large)))
    gaps: list[int] = []  # distinct free sizes, sorted
    open_at: dict[int, list[int]] = {}

    def leave(container: int, gap: int) -> None:
        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append(container)

    def last_free(k: int) -> int:
        seen = []
        while k >= 0 and free[k] != k:
            seen.append(k)
            k = free[k]
        for j in seen:
            free[j] = k
        return k

    used = 0
    top = last_free(len(large) - 1)
    while top >= 0:
        where[large[top]] = used
        free[top] = top - 1
        gap = capacity - large_sizes[top]
        k = last_free(min(top - 1, bisect_right(large_sizes, gap) - 1))
        if k >= 0:
            where[large[k]] = used
            free[k] = k - 1
            gap -= large_sizes[k]
        leave(used, gap)
        used += 1
        top = last_free(top - 1)
    for i in reversed(small):
        size = sizes[i]
        k = bisect_left(gaps, size)
        if k == len(gaps):
            container, gap = used, capacity
            used += 1
        else:
            gap = gaps[k]
            container = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[k]
        where[i] = container
        leave(container, gap - size)
    return where


def pack_documents(df: DataFrame, containers: Sequence[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, partitions: int | None = None) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, start_token, n_tokens) for every kind of container.

    A document above the capacity is cut into full pieces, each alone in a container, and a rest that is
    packed like any item; no other document is split.  Empty and null texts are items of size 0; rows of
    a repeated id are items of their own.  Kinds with a null or non-positive capacity are left out.
    ``partitions`` spreads the input anew where it comes in many tiny partitions.
    """
    path = tokenizer or vocabulary()
    kinds = [(k, int(c)) for k, c in containers if c is not None and c > 0]
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if partitions:
        docs = docs.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes = [], []
        for b in batches:
            ids.append(b.column(0))
            sizes += count_tokens(b.column(1).to_pylist(), path)
        if not sizes:
            return
        every = pa.chunked_array(ids).combine_chunks()
        part = TaskContext.get().partitionId()
        for name, capacity in kinds:
            rows, starts, lengths = [], [], []
            alone: list[int] = []
            for row, n in enumerate(sizes):
                at = 0
                while n - at > capacity:
                    alone.append(len(rows))
                    rows.append(row)
                    starts.append(at)
                    lengths.append(capacity)
                    at += capacity
                rows.append(row)
                starts.append(at)
                lengths.append(n - at)
            cut = set(alone)
            items = [i for i in range(len(rows)) if i not in cut] if cut else range(len(rows))
            where = pack_items([lengths[i] for i in items], capacity)
            used = max(where, default=-1) + 1
            home = [0] * len(rows)
            for i, w in zip(items, where):
                home[i] = w
            for n, i in enumerate(alone):
                home[i] = used + n
            ordinal = [s // capacity + 1 for s in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array([f"{name}-{part}-{h}" for h in home]), every.take(pa.array(rows)), pa.array(ordinal, pa.int32()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())],
                names=["container_kind", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"],
            )

    return docs.mapInArrow(run, SCHEMA.format(kind))


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_pieces, n_tokens, fill): how full each kind came out."""
    # containers are counted per kind in two steps, so that no kind is gathered in one task
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    total = per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    return total.join(containers, "container_kind").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).select("container_kind", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", "fill")
