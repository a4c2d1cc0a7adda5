import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm.mixing import capped_mean, mean_for, mixture, mixture_shares, poisson_cdf
from staylens.llm.packing import fill_report, pack_documents, pack_items
from staylens.llm.tokens import count_tokens, encoding, vocabulary


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.lists(st.floats(0, 1), max_size=60))
def test_items_fit_and_large_ones_pair(capacity, parts):
    sizes = [int(p * capacity) for p in parts]
    where = pack_items(sizes, capacity)
    load, large = Counter(), Counter()
    for s, w in zip(sizes, where):
        load[w] += s
        large[w] += s > capacity // 3
    assert all(v <= capacity for v in load.values()) and all(v <= 2 for v in large.values())
    assert set(where) == set(range(len(set(where))))
    if sum(sizes):
        assert len(set(where)) <= math.ceil(sum(sizes) / capacity) * 1.7 + 1


def test_items_fill_well_and_errors():
    rnd = random.Random(0)
    sizes = [min(1000, int(rnd.paretovariate(1.1) * 20)) for _ in range(5000)]
    where = pack_items(sizes, 1000)
    assert sum(sizes) / ((max(where) + 1) * 1000) > 0.99
    with pytest.raises(ValueError):
        pack_items([5], 4)
    assert pack_items([], 4) == [] and pack_items([0, 0], 4) == [0, 0]


DOCS = "doc_id long, text string, source string, n_tokens int, container_kind string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["room", "bed", "好吃", "noisy"]) for _ in range(rnd.choice([0, 3, 9, 40, 300]))), rnd.choice(["a"] * 6 + ["b", "b", "c"]), 1, "x") for i in range(600)]
    return spark.createDataFrame([*rows, (600, None, "a", 1, "x"), (601, "x", None, 1, "x"), (600, None, "a", 1, "x")], DOCS).repartition(3)


def test_documents(spark, docs):
    kinds = [("small", 64), ("big", 512), ("none", None), ("zero", 0)]
    out = pack_documents(docs, kinds).collect()
    true = dict(zip([r["doc_id"] for r in docs.collect()], count_tokens([r["text"] for r in docs.collect()], vocabulary())))
    load, got, pieces = Counter(), Counter(), defaultdict(list)
    for r in out:
        load[r["container_id"]] += r["n_tokens"]
        got[r["container_kind"], r["doc_id"]] += r["n_tokens"]
        pieces[r["container_kind"], r["doc_id"]].append((r["start_token"], r["n_tokens"]))
    caps = dict(kinds)
    assert {k for k, _ in got} == {"small", "big"} and all(v <= caps[k.split("-")[0]] for k, v in load.items())
    for (k, d), parts in pieces.items():
        assert got[k, d] == true[d]
        assert len(parts) == 1 or true[d] > caps[k] or d == 600
        if true[d] > caps[k]:
            assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert len(pieces) == 2 * 602
    sizes = spark.createDataFrame([("small", 64), ("big", 512)], "container_kind string, capacity_tokens int")
    assert all(0.5 < r["fill"] <= 1 for r in fill_report(pack_documents(docs, kinds), sizes).collect())
    assert pack_documents(docs.where("false"), kinds).count() == 0 and pack_documents(docs, kinds, partitions=2).count() == len(out)


def test_tokens_round_trip():
    enc = encoding(vocabulary())
    for t in ("早餐 good!", "naïve\n\n", "กขค", "<|endoftext|>"):
        assert enc.decode(enc.encode_ordinary(t)) == t
    assert count_tokens(["", None, "a"], vocabulary()) == [0, 0, 1]


def test_poisson():
    assert poisson_cdf(2.0, 3) == pytest.approx((math.exp(-2), 3 * math.exp(-2), 5 * math.exp(-2)))
    for most, rate in ((1, 0.3), (3, 1.7), (6, 5.5)):
        assert capped_mean(mean_for(rate, most), most) == pytest.approx(rate)


def test_mixture(spark, docs):
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.2, 4), ("gone", 0.1, 3), (None, 0.5, 1)], "source string, target_weight double, max_repeats int")
    shares = {r["source"]: r for r in mixture_shares(docs, targets).collect()}
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"]["n_tokens"] == 0
    for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(w / 0.9, abs=0.02)
        assert shares[s]["most_repeats"] <= shares[s]["max_repeats"]
    rows = mixture(docs, targets).collect()
    assert Counter(r["source"] for r in rows) == {s: r["n_rows"] for s, r in shares.items() if r["n_rows"]}
    assert sorted(map(tuple, mixture(docs, targets).collect())) == sorted(map(tuple, rows))
    per = Counter((r["doc_id"], r["copy_no"]) for r in rows if r["doc_id"] < 600)
    assert max(per.values()) == 1
    assert mixture(docs.where("false"), targets).count() == 0 == mixture(docs, targets.where("false")).count()
    assert len(mixture_shares(docs.where("false"), targets).collect()) == 4


def test_means_beyond_five_hundred():
    for rate, most in ((600, 700), (900, 1000), (0.001, 5), (999, 1000)):
        assert capped_mean(mean_for(rate, most), most) == pytest.approx(rate, rel=1e-6)
    assert capped_mean(mean_for(1000, 1000), 1000) == pytest.approx(1000, rel=1e-5)
    assert poisson_cdf(0, 2) == (1.0, 1.0) and poisson_cdf(3, 0) == ()
    assert poisson_cdf(2.0, 3) == pytest.approx((math.exp(-2), 3 * math.exp(-2), 5 * math.exp(-2)))


def test_a_source_repeated_a_thousand_times(spark):
    docs = spark.createDataFrame([(i, "room bed", "small") for i in range(40)] + [(i, "room bed noisy", "big") for i in range(40, 20_000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("small", 0.5, 1000), ("big", 0.5, 1)], "source string, target_weight double, max_repeats int")
    out = {r["source"]: r for r in mixture_shares(docs, targets).collect()}
    assert out["small"]["mean_repeats"] > 512 and out["small"]["most_repeats"] <= 1000
    assert out["small"]["actual_share"] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError):
        mixture_shares(docs, spark.createDataFrame([("small", 1.0, 2_000_000)], targets.schema)).count()


def test_the_share_that_is_filled_is_an_argument(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_weight double, max_repeats int")
    some, all_ = (sum(r["n_tokens"] for r in mixture_shares(docs, targets, fill=f).collect()) for f in (0.4, 0.8))
    assert all_ / some == pytest.approx(2, rel=0.1)
