import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from staylens.llm.arrowtext import codepoints, slices
from staylens.llm.neardup import _prefix_pairs, components, jaccard, near_duplicate_groups, near_duplicate_pairs, shingle_sets, similar_classes, superminhash
from staylens.llm.normalize import normalize_arrow


def grams(t):
    t = normalize_arrow(pa.array([t])).to_pylist()[0].replace(" ", "").replace("\n", "")
    return (t, {t[i : i + 3] for i in range(len(t) - 2)})


def brute(rows, threshold=0.7, least=40):
    sets = {d: grams(t) for d, t in dict(rows).items() if d and t and t != "nan"}
    sets = {d: s for d, (t, s) in sets.items() if len(t) >= least}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("春江花月夜海上明共潮生滟随波千万里何处") for _ in range(6))
    out = []
    for g in range(40):
        words = [word() for _ in range(12)]
        for k in range(rnd.randint(1, 4)):
            mine = [word() if rnd.random() < 0.04 * k else w for w in words]
            out.append(("".join(mine)))
    out += [out[0], out[3], "ａ" + out[5], " ".join(out[7]), "短", "", "nan", None]
    rnd.shuffle(out)
    return [(f"{i:03d}", t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([*rows, rows[0]] if rows else [], "doc_id string, comment string").selectExpr("*", "1 as class_id", "'x' as form")


def test_pairs_against_brute_force(spark, rows):
    got = sorted(map(tuple, near_duplicate_pairs(frame(spark, rows)).collect()))
    assert got == brute(rows) and len(got) > 30


def test_hot_buckets_take_the_exact_way(spark, rows):
    for most in (0, 1, 2):
        assert sorted(map(tuple, near_duplicate_pairs(frame(spark, rows), max_bucket=most).collect())) == brute(rows)


def test_prefix_join_loses_nothing(spark):
    rnd = random.Random(1)
    base = "".join(chr(0x4E00 + rnd.randrange(90)) for _ in range(60))
    texts = [base[:i] + chr(0x6000 + i) + base[i + 1 :] for i in range(0, 60, 2)] + [base[::-1]]
    c = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "class_id string, form string")
    want = {(a, b) for (a, ta), (b, tb) in combinations([(f"{i:02d}", t) for i, t in enumerate(texts)], 2) if len(grams(ta)[1] & grams(tb)[1]) >= 0.7 * len(grams(ta)[1] | grams(tb)[1])}
    assert want <= {tuple(r) for r in _prefix_pairs(c, 0.7, 3).collect()}
    assert {(r["a"], r["b"]) for r in similar_classes(c, max_bucket=3).collect()} == want


def test_groups(spark, rows):
    out = {r["doc_id"]: r for r in near_duplicate_groups(frame(spark, rows)).collect()}
    pairs = brute(rows)
    parent = {d: d for d in out}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {d: r["group_id"] for d, r in out.items()} == {d: find(d) for d in out}
    assert near_duplicate_groups(frame(spark, [])).count() == 0 == near_duplicate_pairs(frame(spark, [])).count()


def test_components_of_a_chain_and_a_star(spark):
    n = 120
    links = [(i, i + 1) for i in range(n)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (901, 900), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {500 + i: 500 for i in range(60)} | {900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_superminhash_estimates_jaccard():
    rnd = random.Random(2)
    a = [chr(0x4E00 + rnd.randrange(3000)) for _ in range(300)]
    texts = ["".join(a), "".join(a[:240] + [chr(0x5E00 + i) for i in range(60)])]
    cps, off, _ = codepoints(pa.array(texts))
    r, h = shingle_sets(cps, off)
    sig = superminhash(r, h, 2, 256)
    s = [set(h[r == i].tolist()) for i in (0, 1)]
    true = len(s[0] & s[1]) / len(s[0] | s[1])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1
    slow = superminhash(r[r == 0], h[r == 0], 1, 256)
    assert np.array_equal(slow[0], sig[0])
    assert np.isinf(superminhash(np.zeros(0, int), np.zeros(0, np.uint64), 1, 8)).all()


def test_a_contained_set_at_exactly_the_threshold(spark):
    whole = "".join(chr(0x4E00 + i) for i in range(52))
    forms = [whole, *[whole[i : i + 37] for i in range(16)]]  # 50 shingles, and 35 of them
    c = spark.createDataFrame(list(enumerate(forms)), "class_id long, form string")
    assert {(0, i) for i in range(1, 17)} <= {(r["a"], r["b"]) for r in _prefix_pairs(c, 0.7, 3).collect()}


def test_permutations_are_the_same_however_they_are_kept():
    rnd = np.random.default_rng(4)
    rows, items = np.sort(rnd.integers(0, 9, 60)), rnd.integers(0, 2**52, 60).astype(np.uint64)
    sig = superminhash(rows, items, 9, 64)
    assert np.array_equal(sig, superminhash(rows, items, 9, 64, replayed=0)) and np.array_equal(sig, superminhash(rows, items, 9, 64, replayed=64))
    one = superminhash(np.zeros(1, int), items[:1], 1, 64)[0]  # one item offers every position in its own round
    assert sorted(np.floor(one).tolist()) == list(range(64))


def test_jaccard():
    rnd = random.Random(8)
    a = ["".join(rnd.choice("abc海") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    b = [x[: rnd.randint(0, 40)] + "".join(rnd.choice("abc海") for _ in range(rnd.randint(0, 9))) for x in a]
    cut = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = [len(cut(x) & cut(y)) / max(1, len(cut(x) | cut(y))) for x, y in zip(a, b)]
    assert np.allclose(jaccard(pa.array(a), pa.array(b)), want)


def test_very_long_texts_are_worked_on_one_at_a_time():
    rnd = random.Random(3)
    texts = ["".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(30_000)) for _ in range(12)] + ["短"] * 9
    parts = list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), [0], 1000, 300_000))
    assert [len(p) for p in parts] == [3, 3, 3, 12] and sum(map(len, parts)) == 21
    tracemalloc.start()
    for p in parts:
        r, h = shingle_sets(*codepoints(p.column(0))[:2])
        superminhash(r, h, len(p), 180)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
