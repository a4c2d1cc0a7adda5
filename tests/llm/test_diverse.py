import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm.arrowtext import codepoints
from staylens.llm.diverse import far_points, features, moved, nearest, quotas, text_keys, varied_subsets

ASK = "request_id int, category string, subset_size int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=20), st.integers(0, 900))
def test_quotas(sizes, places):
    got = quotas(np.array(sizes), places)
    assert got.sum() == min(places, sum(sizes)) and (got <= sizes).all() and (got >= 0).all()


def test_quotas_hold_back_large_groups():
    assert quotas(np.array([10_000, 100, 100]), 30).tolist()[0] <= 26
    assert quotas(np.array([10_000, 1, 1]), 12).tolist() == [10, 1, 1]


def test_batches_find_groups():
    rng = np.random.default_rng(0)
    x = 2 * np.concatenate([rng.normal(c, 0.05, (200, 2)) for c in ((0, 0), (1, 1), (0, 1))])
    c, mixed = far_points(x, 3, np.ones(600), rng), x[rng.permutation(600)]
    seen = np.zeros(len(c))
    for i in range(0, 600, 100):
        near = nearest(mixed[i : i + 100], c)
        c = moved(c, seen, np.bincount(near, minlength=3), np.stack([mixed[i : i + 100][near == j].sum(0) for j in range(3)]))
    assert len({tuple(np.bincount(nearest(x[i : i + 200], c), minlength=3) > 190) for i in (0, 200, 400)}) == 3 and seen.sum() == 600
    assert np.allclose(c[nearest(np.array([[0.0, 0], [2, 2], [0, 2]]), c)], [[0, 0], [2, 2], [0, 2]], atol=0.1)


def test_keys_and_features():
    texts = ["早餐很好", "ab", "", "ab", "ba", "", "早餐很好"]
    k = text_keys(*codepoints(pa.array(texts))[:2], 5)
    assert len(set(k.tolist())) == 4 and k[1] == k[3] and k[2] == k[5] and k[0] == k[6] and k[0] != text_keys(*codepoints(pa.array(texts))[:2], 6)[0]
    assert k[1] == text_keys(*codepoints(pa.array(["ab"]))[:2], 5)[0]
    assert np.allclose(np.linalg.norm(features(*codepoints(pa.array(["早餐很好", "ab", ""]))[:2]), axis=1), [1, 1, 0])


def test_subsets(spark):
    rnd = random.Random(2)
    rows = [(f"{i:04d}", f"早餐的味道很好第{i}次", "f") for i in range(700)] + [(f"{i:04d}", rnd.choice(["电梯", "泳池", "停车", "前台"]) + "x" * rnd.randint(1, 9), "f") for i in range(700, 780)]
    rows += [("0800", "满意", "f"), ("0801", "满 意"[::2], "f"), ("0802", "满意", "f"), ("0803", None, "f"), ("0804", "", "f"), ("0805", "nan", "f"), ("0000", rows[0][1], "f")]
    texts = spark.createDataFrame(rows, "doc_id string, comment string, cluster string")
    cats = spark.createDataFrame([("0800", "p"), ("0801", "p"), ("0802", "p"), ("0803", "p"), ("0001", "p"), ("0001", "p"), ("gone", "p"), ("0001", None)], "doc_id string, category string")
    ask = spark.createDataFrame([(1, None, 40), (2, "p", 5), (3, "none", 3), (4, "p", None), (5, "p", 0), (6, "p", 1), (1, None, 40)], ASK)
    out = varied_subsets(texts, cats, ask).collect()
    n = Counter(r["request_id"] for r in out)
    assert n == {1: 40, 2: 2, 6: 1}
    assert sorted(r["doc_id"] for r in out if r["request_id"] == 2) == ["0001", "0800"]
    mine = [r["doc_id"] for r in out if r["request_id"] == 1]
    assert len(set(mine)) == 40 and sum(d >= "0700" for d in mine) >= 8
    assert sorted(map(tuple, varied_subsets(texts, cats, ask).collect())) == sorted(map(tuple, out))
    assert varied_subsets(texts.where("false"), cats, ask).count() == 0 == varied_subsets(texts, cats, ask.where("false")).count()


def test_a_theme_of_few_texts_has_its_own_centre(spark):
    # themes that fall outside the first texts by hash order, which alone gave seeds
    common = [(f"a{i:05d}", f"早餐的味道很好第{i}次") for i in range(3000)]
    rare = [(f"b{i:05d}", f"The swimming pool is closed {i}") for i in range(60)]
    late = spark.createDataFrame(rare, "doc_id string, comment string").where("xxhash64(comment, 5) > 0")
    texts = spark.createDataFrame(common, "doc_id string, comment string").union(late)
    cats = spark.createDataFrame([], "doc_id string, category string")
    out = varied_subsets(texts, cats, spark.createDataFrame([(1, None, 3060)], ASK)).collect()
    of = {k: {r["cluster"] for r in out if r["doc_id"][0] == k} for k in "ab"}
    assert of["a"] and of["b"] and not of["a"] & of["b"]


def test_requests_above_a_thousand_and_a_hot_category(spark):
    rnd = random.Random(6)
    rows = [(f"{i:05d}", "".join(rnd.choice("春江花月夜海上明共潮生") for _ in range(12))) for i in range(4000)]
    texts = spark.createDataFrame(rows, "doc_id string, comment string")
    cats = spark.createDataFrame([(d, "hot") for d, _ in rows], "doc_id string, category string")
    ask = spark.createDataFrame([(1, "hot", 1500), (2, None, 1200), (3, "hot", 1500), (4, "hot", 9000)], ASK)
    out = varied_subsets(texts, cats, ask, clusters=8).collect()
    got = {k: [r["doc_id"] for r in out if r["request_id"] == k] for k in (1, 2, 3, 4)}
    distinct = len({t for _, t in rows})
    assert [len(v) for v in got.values()] == [1500, 1200, 1500, distinct] and all(len(set(v)) == len(v) for v in got.values())
    assert sorted(got[1]) == sorted(got[3])
