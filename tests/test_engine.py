"""Build, search, events, ingestion."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from staylens.models import HashEmbedder, OfflineModel, parse_intent, parse_json, parse_sub_queries
from staylens.plans.build import COMMENT_STORE, Stores, build, ingest_comments, upsert
from staylens.operators.bm25 import Bm25Index
from staylens.plans.engine import HybridSearch, formatted, server_sent
from staylens.serve import server
from staylens.sources import tables as S
from staylens.streaming.ingest import ingest

COMMENTS = [(f"{i:09d}", t, "海景大床房" if i % 2 else "城景双床房", "大床房" if i % 2 else "双床房", 4.0, "2025-03-01", 8, len(t), i, i, "") for i, t in enumerate(["早餐很好吃", "房间安静干净", "电梯太慢了", "泳池水温合适", "停车场很小", "前台服务热情", "早餐种类不多", "地铁站很近"])]
STAGES = ["query_process", "recall", "fusion", "rerank", "sort", "generate"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stores"))
    comments = spark.createDataFrame(COMMENTS, "doc_id string, comment string, room_type string, fuzzy_room_type string, score double, publish_date string, quality_score int, comment_len int, useful_count int, review_count int, images string")
    questions = spark.createDataFrame([("query_0", "早餐怎么样？", "000000000", "", "", "双床房"), ("query_1", None, "000000001", "", "", "")], "query_id string, query string, comment_id string, comment string, room_type string, fuzzy_room_type string")
    summaries = spark.createDataFrame([("早餐", "早餐 好吃", "大家说早餐好", 3), ("交通", "地铁 停车", "近地铁", 2)], "category string, keywords string, summary string, comment_count int")
    counts = build(spark, path, comments, questions, summaries)
    assert counts["comments"] == (8, 0) and counts["questions"] == (1, 0)
    assert build(spark, path, comments, questions, summaries)["comments"] == (0, 0)
    return HybridSearch(spark, Stores(spark, path))


def test_search(engine):
    r = engine.query("早餐好吃吗", enable_hyde=True)
    assert r.top_comments[0]["rank"] == 1 and len(r.top_comments) == 8
    assert {"早餐很好吃", "早餐种类不多"} & {c["comment"] for c in r.top_comments[:3]}
    assert r.query_info.hyde_answer and r.summaries
    assert set(r.latency) == set("query_process intent_detect expand hyde text_recall vector_recall reverse_recall summary_recall hyde_recall rrf_fusion retrieve rerank composite_score generate total".split())
    assert "早餐" in formatted(r)


def test_filter(engine):
    r = engine.query("大床房安静吗")
    assert r.query_info.intent["fuzzy_room_type"] == "大床房" and r.top_comments


def test_events(engine):
    found = list(engine.events("泳池"))
    assert [(e["stage"], e.get("status")) for e in found[:-1]] == [(s, x) for s in STAGES for x in ("running", "done")]
    assert found[-1]["stage"] == "result"
    lines = list(server_sent(iter(found)))
    assert lines[-1] == "data: [DONE]\n\n" and json.loads(lines[0][6:])["stage"] == "query_process"
    assert [e["stage"] for e in engine.events("  ")] == ["error"]


def test_http(engine):
    web = server(engine, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{web.server_address[1]}/api/"
    post = lambda body, path="query": urllib.request.urlopen(urllib.request.Request(url + path, body.encode(), {"Content-Type": "application/json"}))
    try:
        assert json.load(urllib.request.urlopen(url + "health")) == {"status": "ok"}
        with post(json.dumps({"query": "泳池", "hyde": True})) as r:
            assert r.headers["Content-Type"].startswith("text/event-stream")
            lines = [x for x in r.read().decode().split("\n\n") if x]
        assert lines[-1] == "data: [DONE]" and json.loads(lines[-2][6:])["top_comments"]
        for body, path, code in (("{\"query\": \" \"}", "query", 400), ("[1]", "query", 400), ("{", "query", 400), ("{}", "other", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(body, path)
            assert e.value.code == code
    finally:
        web.shutdown()
        web.server_close()


def test_failing_models(engine, spark):
    class Broken:
        def complete(self, *a):
            raise OSError("down")

        def rerank(self, *a):
            raise OSError("down")

    broken = HybridSearch(spark, engine.stores, llm=Broken(), reranker=Broken())
    r = broken.query("早餐")
    assert broken.failures == {"intent": 1, "expand": 1, "rerank": 1, "answer": 1}
    assert r.top_comments and r.query_info.sub_queries == [("早餐", 1.0)]


def test_parsing():
    assert parse_json("```json\n[1]\n```", None) == [1]
    assert parse_intent('{"time_sensitivity": false, "room_type": null}') == {"room_type": None, "fuzzy_room_type": None, "time_sensitivity": "false"}
    assert parse_intent("oops")["room_type"] is None
    assert parse_sub_queries("[]", "q") == [("q", 1.0)] == parse_sub_queries('[{"text": 1}]', "q")
    assert parse_sub_queries('{"query": "a", "weight": 0.5}', "q") == [("a", 0.5)]
    assert "room_type" in OfflineModel(room_types=["海景房"]).complete("intent", "海景房", 9)


def test_upsert_after_loss(spark, tmp_path):
    df = spark.createDataFrame([(f"{i}", f"t{i}", "", "") for i in range(6)], "doc_id string, comment string, room_type string, fuzzy_room_type string")
    path = str(tmp_path / "s")

    class Flaky(HashEmbedder):
        def embed(self, texts, mode="document", instruct=""):
            if "t3" in texts:
                raise OSError("down")
            return super().embed(texts, mode, instruct)

    assert upsert(spark, df.repartition(6, "doc_id"), path, "doc_id", "comment", COMMENT_STORE, Flaky())[1] >= 1
    upsert(spark, df, path, "doc_id", "comment", COMMENT_STORE, HashEmbedder())
    assert sorted(r[0] for r in spark.read.parquet(path).select("doc_id").collect()) == [str(i) for i in range(6)]


def test_streaming_ingest(spark, tmp_path):
    schema = "doc_id string, comment string, room_type string, fuzzy_room_type string, score double, publish_date string, quality_score int, comment_len int, useful_count int, review_count int, images string"
    df = spark.createDataFrame(COMMENTS, schema)
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    stores = Stores(spark, str(tmp_path / "store"))
    assert stores.comments().count() == 8 == stores.comment_vectors().count()
    # a changed row replaces the old one in all stores, a new one is added
    changed = spark.createDataFrame([("000000000", "游泳池换了新水", "海景大床房", "大床房", 4.0, "2025-04-01", 8, 7, 99, 1, ""), ("000000099", "屋顶花园", "", "", 4.0, "", 8, 4, 0, 0, "")], schema)
    before = {r["doc_id"]: r["embedding"] for r in stores.comment_vectors().collect()}
    assert ingest_comments(spark, str(tmp_path / "store"), changed) == (2, 0)
    assert ingest_comments(spark, str(tmp_path / "store"), changed) == (0, 0)
    rows = {r["doc_id"]: r for r in stores.comments().collect()}
    after = {r["doc_id"]: r["embedding"] for r in stores.comment_vectors().collect()}
    assert len(rows) == 9 == len(after) and rows["000000000"]["useful_count"] == 99
    assert [k for k in before if before[k] != after[k]] == ["000000000"]
    index = Bm25Index.load(spark, str(tmp_path / "store" / "index"))
    assert index.stats.first()["n"] == 9 and index.bucketed
    hits = lambda q: [r["doc_id"] for r in index.search(spark.createDataFrame([(1, q)], "query_id int, q string"), ["query_id"], "q").collect()]
    assert hits("早餐很好吃") == ["000000006"] and hits("游泳池") == ["000000000", "000000003"] or hits("游泳池")[0] == "000000000"


def test_repeated_comments_are_stored_once(spark, tmp_path):
    schema = "doc_id string, comment string, room_type string, fuzzy_room_type string, score double, publish_date string, quality_score int, comment_len int, useful_count int, review_count int, images string"
    rows = [("1", "好", "a", "b", 4.0, "2025-01-01", 8, 1, n, 0, "") for n in (1, 7, 3)] + [(None, "x", "a", "b", 4.0, "", 8, 1, 1, 0, "")]
    empty = spark.createDataFrame([], "query_id string, query string, comment_id string, comment string, room_type string, fuzzy_room_type string")
    summaries = spark.createDataFrame([("c", "k", "s", 1)], "category string, keywords string, summary string, comment_count int")
    path = str(tmp_path / "s")
    assert build(spark, path, spark.createDataFrame(rows, schema), empty, summaries)["comments"] == (1, 0)
    assert [r["useful_count"] for r in Stores(spark, path).comments().collect()] == [7]
    found = HybridSearch(spark, Stores(spark, path)).query("好")
    assert [c["doc_id"] for c in found.top_comments] == ["1"]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,comment,score,useful_count\n1,"two\nlines",4.5,3\n2,,x,\n')
    got = {r["doc_id"]: r for r in S.read_comments_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got["1"]["comment"] == "two\nlines" and got["2"]["score"] == 0.0 and got["2"]["useful_count"] == 0
    (tmp_path / "n.csv").write_text("id,comment_len,useful_count,comment\n1,4.0,7,x\n2,4.9,1e3,y\n")  # another order of columns, counts with a point
    assert [(r["comment"], r["comment_len"], r["useful_count"]) for r in S.read_comments_csv(spark, str(tmp_path / "n.csv")).orderBy("doc_id").collect()] == [("x", 4, 7), ("y", 4, 1000)]
    (tmp_path / "q.csv").write_text("comment_id,extra,query\n1,e,a\n2,f,b\n")
    assert [(r["query_id"], r["query"], r["comment_id"], r["room_type"]) for r in S.read_reverse_csv(spark, str(tmp_path / "q.csv")).orderBy("query_id").collect()] == [("query_0", "a", "1", None), ("query_1", "b", "2", None)]
    assert [r["n"] for r in S.numbered(spark.range(1000, numPartitions=7), "n").orderBy("id").collect()] == list(range(1000))
    (tmp_path / "r.csv").write_text("query,comment_id,comment,room_type,fuzzy_room_type\na,1,,,\nb,2,,,\n")
    assert [r["query_id"] for r in S.read_reverse_csv(spark, str(tmp_path / "r.csv")).orderBy("query_id").collect()] == ["query_0", "query_1"]
    (tmp_path / "s.json").write_text('[{"category": "c", "keywords": "k", "summary": "s", "comment_count": 2}]')
    assert S.read_summaries_json(spark, str(tmp_path / "s.json")).first()["comment_count"] == 2
    (tmp_path / "w.txt").write_text(" 的 \n\n了\n的\n")
    assert {r[0] for r in S.read_stop_words(spark, str(tmp_path / "w.txt"), english=False).collect()} == {"的", "了"}
    assert S.read_comments_csv(spark, str(tmp_path / "none")).count() == 0 == S.read_summaries_json(spark, str(tmp_path / "none")).count()
    with pytest.raises(S.StoreMissing):
        S.open_store(spark, str(tmp_path / "none"))
    assert S.get_or_create(spark, str(tmp_path / "new"), "a int")[1] == 0
    (tmp_path / "cut" / "_temporary").mkdir(parents=True)  # a creation that was cut off
    assert S.get_or_create(spark, str(tmp_path / "cut"), "a int")[1] == 0
    spark.range(3).write.parquet(str(tmp_path / "old"))
    assert S.get_or_create(spark, str(tmp_path / "old"), "id long")[1] == 3
