"""Hand-computed cases of the retrieval and ranking operators."""

import math
import os
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens import queries
from staylens.functions import text as T
from staylens.operators import context as X
from staylens.operators import fusion, ranking
from staylens.operators.bm25 import Bm25Index
from staylens.operators.vector import IvfIndex, cosine_topk
from staylens.schema import SearchConfig
from staylens.sources.tables import one_per_key, typed

CFG = SearchConfig()
SF = "/root/testdata/sf0.1"
LISTS = "query_id int, query_idx int, source string, hit_rank int, doc_id string, score double"


@pytest.fixture(scope="module")
def index(spark):
    docs = [("a", "red house red"), ("b", "red boat"), ("c", "blue sea wind"), ("d", "12 34"), ("e", None)]
    return Bm25Index.build(spark.createDataFrame(docs, "doc_id string, text string"), "doc_id", "text")


def expected(docs, query):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for t in query:
        df = sum(t in d for d in docs.values())
        for k, d in docs.items():
            if t in d:
                tf = d.count(t)
                out[k] = out.get(k, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("query", ["red", "red red boat", "sea", "nothing here", "", "99"])
def test_bm25(spark, index, query):
    docs = {"a": ["red", "house", "red"], "b": ["red", "boat"], "c": ["blue", "sea", "wind"], "d": [], "e": []}
    q = spark.createDataFrame([(1, query)], "query_id int, q string")
    got = {r["doc_id"]: r["score"] for r in index.search(q, ["query_id"], "q").collect()}
    assert got == pytest.approx(expected(docs, query.split()))


def test_bm25_figures_and_round_trip(spark, index, tmp_path):
    assert index.stats.first().asDict() == {"n": 5, "avgdl": 8 / 5}
    index.save(str(tmp_path / "i"))
    again = Bm25Index.load_or_build(spark, str(tmp_path / "i"), None)
    q = spark.createDataFrame([(1, "red boat")], "query_id int, q string")
    assert sorted(again.search(q, ["query_id"], "q").collect()) == sorted(index.search(q, ["query_id"], "q").collect())
    with pytest.raises(FileNotFoundError):
        Bm25Index.load_or_build(spark, str(tmp_path / "none"), None)


def test_bm25_empty(spark):
    i = Bm25Index.build(spark.createDataFrame([], "doc_id string, text string"), "doc_id", "text")
    assert i.search(spark.createDataFrame([(1, "a")], "query_id int, q string"), ["query_id"], "q").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("房间很好 Wi-Fi ok 1",), ("好",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.mixed_tokens(F.col("t"))).collect()]
    assert got == [["wi", "fi", "ok", "房间", "间很", "很好"], ["好"], [], []]
    assert df.select(T.cjk_tokens(F.col("t"))).first()[0] == ["wi", "fiok", "房间", "间很", "很好"]
    assert df.select(T.strip_fences(F.lit("```json\n[1]\n``` "))).first()[0] == "[1]"


def test_fusion_duplicate_tie_and_first_seen(spark):
    rows = [
        (1, 0, "reverse", 1, "x", 0.9), (1, 0, "reverse", 2, "y", 0.8), (1, 0, "reverse", 3, "x", 0.7),
        (1, 0, "text", 1, "y", 5.0), (1, 0, "text", 2, "z", 4.0), (1, 1, "text", 1, "z", 3.0), (1, 1, "text", 2, "y", None),
        (2, 0, "hyde", 1, "x", 0.5),
    ]
    ranked = fusion.rank_lists(fusion.union_lists(spark.createDataFrame(rows, LISTS)))
    got = {(r["query_id"], r["doc_id"]): r for r in fusion.fuse(ranked).collect()}
    assert got[1, "x"]["rrf"] == round(1 / 61 + 1 / 63, 10) and got[1, "x"]["hits"] == 2
    assert got[1, "y"]["source"] == "text" and got[1, "y"]["routes"][0] == "text: #1 (Q0)"
    assert got[2, "x"]["first_list"] == 1_000_000
    tie = spark.createDataFrame([(1, 0, "text", 1, "p", 2.0), (1, 0, "text", 2, "q", 1.0), (1, 1, "text", 1, "q", 2.0), (1, 1, "text", 2, "p", 1.0)], LISTS)
    order = fusion.fuse(fusion.rank_lists(fusion.union_lists(tie))).orderBy("fused_rank").collect()
    assert [r["doc_id"] for r in order] == ["p", "q"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abcdef"), st.floats(0, 1)), min_size=1, max_size=25))
def test_fusion_is_the_sum(spark, hits):
    rows = [(1, i, "text", n, d, s) for n, (i, d, s) in enumerate(hits)]
    ranked = fusion.rank_lists(fusion.union_lists(spark.createDataFrame(rows, LISTS)))
    want = {}
    for i in range(3):
        for rank, (_, _, _, _, d, _) in enumerate(sorted((r for r in rows if r[1] == i), key=lambda r: (-r[5], r[3])), 1):
            want[d] = want.get(d, 0) + 1 / (60 + rank)
    got = {r["doc_id"]: r["rrf"] for r in fusion.fuse(ranked).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def features(spark, rows):
    cols = "query_id int, doc_id string, rerank_score double, rerank_rank int, quality_score int, comment_len int, review_count int, useful_count int, publish_date string"
    return spark.createDataFrame(rows, cols)


def test_composite(spark):
    day = lambda n: (CFG.reference_date - timedelta(days=n)).isoformat()
    rows = [
        (1, "a", 0.8, 1, 10, 100, 0, 0, day(0)), (1, "b", 0.8, 2, 5, 50, 0, 0, day(730)), (1, "c", 0.5, 3, None, None, None, None, "nan"),
        (1, "d", 0.0, 4, 0, 0, 0, 0, day(-365)), (1, "e", 0.0, 5, 0, 0, 0, 0, "2025-04-16 10:00"), (1, "f", 0.0, 6, 0, 0, 0, 0, "2024-4-16"),
    ]
    on = {r["doc_id"]: r for r in ranking.composite(features(spark, rows), F.lit(True), CFG).collect()}
    assert on["a"]["final_score"] == pytest.approx(0.4 * 0.8 + 0.25 + 0.05 + 0.2)
    assert on["b"]["final_score"] == pytest.approx(0.4 * 0.8 + 0.125 + 0.025)
    assert on["c"]["timeliness"] == 0.5 == on["e"]["timeliness"]
    assert on["d"]["timeliness"] == pytest.approx(1.5)
    assert on["f"]["timeliness"] == pytest.approx(1 - (date(2025, 4, 16) - date(2024, 4, 16)).days / 730)
    off = ranking.composite(features(spark, rows), F.lit(False), CFG, 2).collect()
    assert {r["timeliness"] for r in off} == {0.5} and [r["final_rank"] for r in off] == [1, 2]
    assert ranking.composite(features(spark, []), F.lit(True), CFG).count() == 0


def test_rerank_missing_and_positions(spark):
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, fused_rank long")
    got = ranking.rerank(c, F.when(F.col("doc_id") == "c", 0.9), 2).orderBy("rerank_rank").collect()
    assert [r["doc_id"] for r in got] == ["c", "a"]
    r = spark.createDataFrame([(1, 2, 0.7)], "query_id int, index long, relevance double")
    assert [x["doc_id"] for x in ranking.attach_by_position(c, r).collect()] == ["c"]


def test_cosine_filters_before_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    rows = [(f"{i:03d}", x[i].tolist(), "r1" if i % 50 == 0 else "r2") for i in range(200)] + [("bad", None, "r1"), ("zero", [0.0] * 8, "r1"), ("odd", [1.0], "r1")]
    c = spark.createDataFrame(rows, "doc_id string, embedding array<double>, room_type string")
    q = spark.createDataFrame([(1, x[7].tolist(), "r1"), (2, x[9].tolist(), None), (3, x[9].tolist(), "")], "query_id int, embedding array<double>, want string")
    got = cosine_topk(c, q, "doc_id", 5, {"room_type": "want"}).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for qid, v, keep in ((1, 7, lambda i: i % 50 == 0), (2, 9, lambda i: True), (3, 9, lambda i: True)):
        s = np.round(n @ n[v], 6)
        want = sorted((i for i in range(200) if keep(i)), key=lambda i: (-s[i], i))[:5]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])] == [f"{i:03d}" for i in want]


def test_cosine_ties_and_empty(spark):
    c = spark.createDataFrame([(f"{i:02d}", [1.0, 0.0]) for i in range(30)], "doc_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<double>")
    assert sorted(r["doc_id"] for r in cosine_topk(c, q, "doc_id", 4).collect()) == ["00", "01", "02", "03"]
    assert cosine_topk(c, q.where("query_id > 5"), "doc_id", 4).count() == 0
    assert cosine_topk(c.where("doc_id = 'none'"), q, "doc_id", 4).count() == 0


def test_ivf_recall(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    c = spark.createDataFrame([(i, x[i].tolist()) for i in range(3000)], "doc_id long, embedding array<double>")
    q = c.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in cosine_topk(c, q, "doc_id", 20).collect()}
    ivf = IvfIndex.build(c, "doc_id")
    assert ivf.rows.count() == 3000
    found = {(r["query_id"], r["doc_id"]) for r in ivf.search(q, 20).collect()}
    assert len(found & exact) / len(exact) >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ivf_recall_on_the_tables(spark):
    exact, found = ({(r["query_id"], r["doc_id"]) for r in queries.queries()[name](spark, SF).collect()} for name in ("cosine_topk", "ivf_topk"))
    assert len(found & exact) / len(exact) >= 0.9


def test_context_and_summaries(spark):
    s = spark.createDataFrame([(1, 0, 2, "p", "s1", 3), (1, 1, 1, "p", "s1", 3), (1, 0, 1, "q", "s2", 4)], "query_id int, query_idx int, rank int, category string, summary string, comment_count int")
    first = X.first_summaries(s)
    assert {(r["category"], r["query_idx"]) for r in first.collect()} == {("p", 0), ("q", 0)}
    c = spark.createDataFrame([(1, 2, "r", 4.5, "d", "two"), (1, 1, "r", 4.0, "d", "one"), (2, 1, "r", 4.0, "d", "other")], "query_id int, final_rank int, room_type string, score_val double, publish_date string, comment string")
    got = {r["query_id"]: r["context"] for r in X.context(first, c).collect()}
    assert got[1].index("q (4") < got[1].index("p (3") < got[1].index("[1]") < got[1].index("[2]")
    assert got[2].startswith("# Guest comments")


def test_typed_and_one_per_key(spark):
    rows = [("1", "x", "7", None), ("1", "x", "9", "a"), ("2", None, "bad", "b")]
    df = spark.createDataFrame(rows, "doc_id string, comment string, useful_count string, extra string")
    got = {r["doc_id"]: r for r in typed(one_per_key(df, "doc_id", ["useful_count"])).collect()}
    assert got["1"]["useful_count"] == 9 and got["2"]["useful_count"] == 0 and got["2"]["comment"] == ""
