"""Problem 6: near-duplicate texts by SuperMinHash, banding, exact verification and union-find.

Texts are taken in their consistent form without white space; equal ones form a class and only classes
are compared.  Signatures come from correlated permutation ranks with early stopping; classes that
share a band are verified on their exact shingle sets.  The members of a bucket of more than
``max_bucket`` classes, counted over all data, are not paired off: they go through an exact
prefix-filtered join on their rarest shingles, so no pair is lost to the bound.  Batches are worked on
in slices of bounded numbers of characters, so memory depends neither on the partition nor, but for the
text itself, on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrowtext import codepoints, row_ids, slices, to_arrow
from .normalize import normalize_codepoints, real_text

BANDS, ROWS = 36, 5  #: a pair at exactly 0.7 shares a band with probability 1 - (1 - 0.7**5)**36 = 0.9987, at 0.75 with 0.99994
SLICE_ROWS, SLICE_BYTES = 1000, 300_000  #: texts worked on at a time; a longer text is a slice of its own
CHUNK = 20_000  #: classes among which a task looks for crowded buckets at a time
_KEY_BITS = 51  #: of a shingle's hash inside a slice: two of a pair's shingles fall together about once in 10**11 pairs
_BLANKS = np.array([0x20, 0x0A], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_keys(cps: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the runs of ``k <= 3`` code points of each row: the key holds the code points themselves."""
    rows = row_ids(offsets)
    if len(cps) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = cps[: len(cps) - k + 1].astype(np.uint64)
    for i in range(1, k):
        h = (h << np.uint64(21)) ^ cps[i : len(cps) - k + 1 + i].astype(np.uint64)
    inside = rows[: len(cps) - k + 1] == rows[k - 1 :]
    return rows[: len(inside)][inside], h[inside]


def shingle_sets(cps: np.ndarray, offsets: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``k`` code points of each row, sorted; at most 4096 rows."""
    rows, h = _shingle_keys(cps, offsets, k)
    if not len(h):
        return rows, h
    # the row and a hash in one number: one plain sort instead of an indirect one over two columns
    key = np.sort(rows.astype(np.uint64) << np.uint64(52) | _mix(h) >> np.uint64(12))
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64(2**52 - 1)


def superminhash(rows: np.ndarray, items: np.ndarray, n: int, m: int, replayed: int = 24) -> np.ndarray:
    """SuperMinHash signatures (n, m) of the item sets given as (row, item) pairs.

    Each item draws a random permutation of the ``m`` positions, one step a round, and offers
    ``round + fraction`` at the position drawn.  An offer of a round is above all of the rounds before,
    so only positions still empty take one, and a row stops, with all work on its items, once none is
    empty.  The permutation of an item is replayed from its swaps in the first ``replayed`` rounds, which
    end all but the smallest sets; only the items left then get one laid out.  Rows without items stay
    infinite.
    """
    sig = np.full(n * m, np.inf)
    base, swaps, laid = rows * m, [], None
    for j in range(m):
        if not len(items):
            break
        with np.errstate(over="ignore"):
            u = _mix(items + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (j + ((u >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int16)
        if laid is None and j >= replayed:
            laid = np.tile(np.arange(m, dtype=np.int16), (len(items), 1))
            every = np.arange(len(items))
            for i, before in enumerate(swaps):
                laid[every, before], laid[every, i] = laid[every, i], laid[every, before]
        if laid is None:
            place = at
            for i in range(j - 1, -1, -1):  # what stands at a place was put there by the last swap with it
                place = np.where(place == swaps[i], np.int16(i), place)
            swaps.append(at)
        else:
            every = np.arange(len(items))
            place = laid[every, at]
            laid[every, at] = laid[:, j]
            laid[:, j] = place
        slot = base + place
        taken = np.flatnonzero(np.isinf(sig[slot]))
        if len(taken):
            np.minimum.at(sig, slot[taken], j + (u[taken] & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32)
        stay = np.isinf(sig.reshape(n, m)).any(1)[rows]
        if 4 * np.count_nonzero(stay) < 3 * len(stay):
            rows, items, base, swaps = rows[stay], items[stay], base[stay], [x[stay] for x in swaps]
            laid = None if laid is None else laid[stay]
    return sig.reshape(n, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash (n, bands) of each band of the signatures."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.tile(_mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x51ED270B)), (len(sig), 1))
    for i in range(rows):
        out = _mix(out * np.uint64(31) + bits[:, :, i])
    return out.view(np.int64)


def text_classes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id) and (classes: class_id, form, n_docs) of texts long enough.

    The class id is the smallest doc_id of the class; each id counts once.
    """
    one = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(real_text(F.col("t")) & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [1]):
                cps, offsets = normalize_codepoints(*codepoints(part.column(1))[:2])
                rows = row_ids(offsets)
                stay = ~np.isin(cps, _BLANKS)
                cps, offsets = cps[stay], np.searchsorted(rows[stay], np.arange(len(offsets)))
                keep = pa.array(np.diff(offsets) >= min_chars)
                yield pa.RecordBatch.from_arrays([part.column(0), to_arrow(cps, offsets)], names=["doc_id", "form"]).filter(keep)

    kind = df.schema[id_col].dataType.simpleString()
    forms = one.mapInArrow(run, f"doc_id {kind}, form string")
    # the text itself travels once; classes are keyed by two independent hashes of it
    keyed = forms.select("doc_id", "form", F.xxhash64("form").alias("h1"), F.xxhash64("form", F.lit(1)).alias("h2"), F.length("form").alias("len"))
    keyed = checkpointed(keyed)
    classes = keyed.groupBy("h1", "h2", "len").agg(F.min("doc_id").alias("class_id"), F.min("form").alias("form"), F.count("*").alias("n_docs"))
    members = keyed.select("doc_id", "h1", "h2", "len").join(classes.select("h1", "h2", "len", "class_id"), ["h1", "h2", "len"]).select("doc_id", "class_id")
    return members, classes.select("class_id", "form", "n_docs")


def _signed(classes: DataFrame, bands: int, rows: int, k: int, max_bucket: int) -> DataFrame:
    """(ids, sizes, keys, hot): one row for each ``CHUNK`` classes of a task, with the band hashes of each; the band is part of its hash.

    ``hot`` holds the buckets with more than ``max_bucket`` of those classes, so that no hot bucket need
    be gathered to be found: one that is hot nowhere has at most ``max_bucket`` rows for each chunk.
    """
    kind = classes.schema["class_id"].dataType.simpleString()

    def packed(ids: list, keys: list, sizes: list) -> pa.RecordBatch:
        who, key = pa.concat_arrays(ids), np.concatenate(keys)
        found, count = np.unique(key, return_counts=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (who, pa.array(found[count > max_bucket]))]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(sizes), key)]
        return pa.RecordBatch.from_arrays([lists[0], *blobs, lists[1]], names=["ids", "sizes", "keys", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes, held = [], [], [], 0
        for b in batches:
            for part in slices(b, [1], SLICE_ROWS, SLICE_BYTES):
                cps, offsets, _ = codepoints(part.column(1))
                r, h = shingle_sets(cps, offsets, k)
                ids.append(part.column(0))
                sizes.append(np.bincount(r, minlength=len(part)).astype(np.int32))
                keys.append(bands_of(superminhash(r, h, len(part), bands * rows), bands, rows))
                held += len(part)
                if held >= CHUNK:
                    yield packed(ids, keys, sizes)
                    ids, keys, sizes, held = [], [], [], 0
        if ids:
            yield packed(ids, keys, sizes)

    return classes.select("class_id", "form").mapInArrow(run, f"ids array<{kind}>, sizes binary, keys binary, hot array<bigint>")


def _band_rows(signed: DataFrame, bands: int) -> DataFrame:
    """(class_id, bucket, size): one row a band of the packed classes."""
    kind = signed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                who = b.column(0).slice(i, 1).flatten()
                size, key = np.frombuffer(b.column(1)[i].as_py(), np.int32), np.frombuffer(b.column(2)[i].as_py(), np.int64)
                for at in range(0, len(who), SLICE_ROWS):
                    take = np.repeat(np.arange(at, min(at + SLICE_ROWS, len(who))), bands)
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(take)), pa.array(key[at * bands : at * bands + len(take)]), pa.array(size[take])], names=["class_id", "bucket", "size"])

    return signed.select("ids", "sizes", "keys").mapInArrow(run, f"class_id {kind}, bucket long, size int")


def candidate_pairs(classes: DataFrame, threshold: float, bands: int, rows: int, k: int, max_bucket: int) -> DataFrame:
    """Distinct (a < b) class pairs that share a bucket, with sizes compatible with the threshold.

    Buckets up to ``max_bucket`` members are paired inside; members of larger ones are joined on the
    rarest shingles of their prefixes, which is exact for the threshold.  What counts is the size of the
    bucket over all data, however it is spread: a bucket hot in some chunk has more than
    ``max_bucket`` members, and the others are counted whole.
    """
    packed = checkpointed(_signed(classes, bands, rows, k, max_bucket))  # few wide rows: a checkpoint serialises each row by itself
    crowded = packed.select(F.explode("hot").alias("bucket")).distinct()
    calm, signed = crowded.isEmpty(), _band_rows(packed, bands)
    # one exchange by bucket serves the count and the lists; what stands alone in its bucket goes no further
    cold = (signed if calm else signed.join(crowded, "bucket", "left_anti")).select("class_id", "bucket", "size").repartition("bucket")
    shared = checkpointed(cold.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"))
    small = shared.where(F.col("n") <= max_bucket).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("size", "class_id"))).alias("g"))
    # members come ordered by set size: a partner is at most 1/threshold times as large
    pairs = small.select(F.posexplode("g").alias("i", "x"), "g").select("x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y"))
    pairs = pairs.where(F.expr(f"x.size >= {threshold} * y.size")).select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b"))
    hot = shared.where(F.col("n") > max_bucket).select("class_id")
    if not calm:
        hot = hot.union(signed.join(crowded, "bucket", "left_semi").select("class_id"))
    hot = hot.distinct()
    if not hot.isEmpty():
        pairs = pairs.union(_prefix_pairs(classes.join(hot, "class_id", "left_semi"), threshold, k))
    return pairs.distinct()


def _tokens(classes: DataFrame, k: int) -> DataFrame:
    """(class_id, s, size): one row a distinct shingle, whose number holds its characters."""
    kind = classes.schema["class_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [1], SLICE_ROWS, SLICE_BYTES):
                cps, offsets, _ = codepoints(part.column(1))
                r, h = _shingle_keys(cps, offsets, k)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
                r, h = r[new], h[new]
                size = np.bincount(r, minlength=len(part)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(h.view(np.int64)), pa.array(size[r])], names=["class_id", "s", "size"])

    return classes.select("class_id", "form").mapInArrow(run, f"class_id {kind}, s long, size int")


def _prefix_pairs(classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Candidate pairs of an exact similarity join: two sets at the threshold share one of their rarest shingles.

    A shingle's frequency orders it, and the prefixes hold the rarest ones, so no shingle that many
    texts share is joined on unless those texts have nothing rarer.
    """
    tokens = checkpointed(_tokens(classes, k))
    freq = tokens.groupBy("s").agg(F.count("*").alias("df"))
    per = Window.partitionBy("class_id").orderBy("df", "s")
    ranked = tokens.join(freq, "s").withColumn("pos", F.row_number().over(per))
    prefix = checkpointed(ranked.where(F.expr(f"pos <= size - ceil({threshold} * size) + 1 and df > 1")).select("class_id", "s", "size", "pos"))
    a, b = prefix.alias("a"), prefix.alias("b")
    # positional filter: what is left after the match must still be able to reach the threshold; a quotient would be rounded
    met = a.join(b, F.expr(f"""a.s = b.s and a.class_id < b.class_id and least(a.size, b.size) >= {threshold} * greatest(a.size, b.size)
        and (1 + {threshold}) * (least(a.size - a.pos, b.size - b.pos) + least(a.pos, b.pos)) >= {threshold} * (a.size + b.size)"""))
    return met.select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b")).distinct()


def jaccard(fa: pa.Array, fb: pa.Array, k: int = 3) -> np.ndarray:
    """The similarity of the shingle sets of two columns of texts, row by row; at most 4096 rows, two texts without shingles have 0."""
    n, keys = len(fa), []
    for side, column in enumerate((fa, fb)):
        cps, offsets, _ = codepoints(column)
        rows, h = _shingle_keys(cps, offsets, k)
        keys.append(rows.astype(np.uint64) << np.uint64(_KEY_BITS + 1) | _mix(h) >> np.uint64(64 - _KEY_BITS) << np.uint64(1) | np.uint64(side))
    # pair, shingle and side in one number: after one sort equal shingles of a pair stand together
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.zeros(n)
    key = key[np.append(True, key[1:] != key[:-1])]
    pair = (key >> np.uint64(_KEY_BITS + 1)).astype(np.int64)
    both = np.bincount(pair[1:][(key[1:] ^ key[:-1]) == 1], minlength=n)
    return both / np.maximum(np.bincount(pair, minlength=n) - both, 1)


def similar_classes(classes: DataFrame, threshold: float = 0.7, bands: int = BANDS, rows: int = ROWS, k: int = 3, max_bucket: int = 60) -> DataFrame:
    """Verified (a, b, similarity) class pairs, a < b, similarity the exact Jaccard of their shingle sets."""
    found = candidate_pairs(classes, threshold, bands, rows, k, max_bucket)
    forms = classes.select("class_id", "form")
    both = found.join(forms.select(F.col("class_id").alias("a"), F.col("form").alias("fa")), "a").join(forms.select(F.col("class_id").alias("b"), F.col("form").alias("fb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, [2, 3], 4000, 4 * SLICE_BYTES):
                sim = jaccard(part.column(2), part.column(3), k)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], names=["a", "b", "similarity"]).filter(pa.array(sim >= threshold - 1e-12))

    kind = classes.schema["class_id"].dataType.simpleString()
    return both.select("a", "b", "fa", "fb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _print_of(edges: DataFrame) -> tuple:
    """Number and checksums of a set of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps.

    Union-find as joins: each round halves path lengths, and lineage is cut by a checkpoint.  Rounds go on
    to the fixed point, so groups are never left half joined.  Only nodes with a link appear.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, now = None, _print_of(edges)
    while now != before:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpointed(small)
        before, now = now, _print_of(edges)
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    return root.select(F.col("u").alias("node"), "root").union(root.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment", threshold: float = 0.7, min_chars: int = 40, k: int = 3, bands: int = BANDS, rows: int = ROWS, max_bucket: int = 60) -> DataFrame:
    """(doc_id_a < doc_id_b) of all similar documents, equal ones included.

    Classes are compared; members are attached last.  Null, empty, ``nan`` and short texts have no pair.
    """
    members, classes = text_classes(df, id_col, text_col, min_chars)
    members, classes = checkpointed(members), checkpointed(classes)
    links = similar_classes(classes, threshold, bands, rows, k, max_bucket).select("a", "b")
    own = classes.where("n_docs > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    left, right = members.select(F.col("doc_id").alias("x"), F.col("class_id").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("class_id").alias("b"))
    met = links.union(own).join(left, "a").join(right, "b").where("a <> b or x < y")
    return met.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment", threshold: float = 0.7, min_chars: int = 40, k: int = 3, bands: int = BANDS, rows: int = ROWS, max_bucket: int = 60) -> DataFrame:
    """(doc_id, class_id, group_id, n_links): one row a document that takes part.

    ``class_id`` is shared by equal texts; ``group_id`` is the smallest class of the connected group;
    ``n_links`` counts the similar classes of the document's class.
    """
    members, classes = text_classes(df, id_col, text_col, min_chars)
    classes = checkpointed(classes)
    links = checkpointed(similar_classes(classes, threshold, bands, rows, k, max_bucket).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    root = components(links).select(F.col("node").alias("class_id"), "root")
    out = members.join(root, "class_id", "left").join(degree, "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
