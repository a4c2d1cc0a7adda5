"""The search engine: one plan for all recall routes of a question, small results on the driver."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Embedder, HashEmbedder, LanguageModel, OfflineModel, OverlapReranker, Reranker, parse_intent, parse_sub_queries
from ..operators import context as X
from ..operators import fusion, ranking
from ..operators.bm25 import Bm25Index
from ..operators.vector import cosine_topk
from ..schema import SearchConfig
from .build import Stores

LOG = logging.getLogger(__name__)
#: What a question's vector is asked for; embedders that take instructions get it.
INSTRUCTION = "Given a guest's question, retrieve reviews that answer it"
APOLOGY = "The answer could not be written just now; please see the comments below."


@dataclass
class QueryInfo:
    original: str
    intent: dict[str, str | None]
    sub_queries: list[tuple[str, float]]
    hyde_answer: str = ""


@dataclass
class SearchResult:
    answer: str
    query_info: QueryInfo
    summaries: list[dict[str, Any]]
    top_comments: list[dict[str, Any]]
    latency: dict[str, float] = field(default_factory=dict)


class HybridSearch:
    """Answers questions over built stores.  Model calls are injected; the offline stand-ins are the default."""

    def __init__(self, spark: SparkSession, stores: Stores, config: SearchConfig | None = None, llm: LanguageModel | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None) -> None:
        self.spark, self.stores, self.cfg = spark, stores, config or SearchConfig()
        self.llm, self.embedder, self.reranker = llm or OfflineModel(), embedder or HashEmbedder(), reranker or OverlapReranker()
        self.index = Bm25Index.load(spark, f"{stores.path}/index")
        self.failures: dict[str, int] = {}  #: calls of each kind that failed and were made up for

    # --- stage 1: query processing ---
    def process(self, query: str, enable_hyde: bool = False, timings: dict[str, float] | None = None) -> QueryInfo:
        timings = {} if timings is None else timings
        timed = lambda name, f: _timed(timings, name, f)
        intent = parse_intent(timed("intent_detect", lambda: self._ask("intent", query, 256)))
        subs = parse_sub_queries(timed("expand", lambda: self._ask("expand", query, 512)), query)
        hyde = timed("hyde", lambda: self._ask("hyde", query, 512)).strip() if enable_hyde else ""
        return QueryInfo(query, intent, subs, hyde)

    def _ask(self, task: str, prompt: str, most: int) -> str:
        try:
            return self.llm.complete(task, prompt, most)
        except Exception:  # noqa: BLE001 - a failing model must not end the search
            LOG.warning("the model failed at %s", task, exc_info=True)
            self.failures[task] = self.failures.get(task, 0) + 1
            return ""

    # --- stage 2: recall, every route for all sub-queries at once ---
    def routes(self, info: QueryInfo) -> dict[str, DataFrame]:
        """The recall list of each route and the summaries; each distinct text is embedded once."""
        texts = [q for q, _ in info.sub_queries]
        vec = dict(zip(texts, self.embedder.embed(texts, "query", INSTRUCTION)))
        rows = [(i, q, vec[q], info.intent["room_type"], info.intent["fuzzy_room_type"]) for i, q in enumerate(texts)]
        asked = self.spark.createDataFrame(rows, "query_id int, query string, embedding array<double>, intent_room_type string, intent_fuzzy_room_type string")
        filters = {"room_type": "intent_room_type", "fuzzy_room_type": "intent_fuzzy_room_type"}
        k = self.cfg.topk_recall
        to_list = lambda df, source: df.select(F.lit(0).alias("query_id"), F.col("query_id").alias("query_idx"), F.lit(source).alias("source"), F.col("rank").cast("int").alias("hit_rank"), "doc_id", "score")
        questions = self.stores.question_vectors()
        near = cosine_topk(questions, asked, "question_id", k, filters).join(questions.select("question_id", F.col("comment_id").alias("doc_id")), "question_id")
        categories = self.stores.category_vectors()
        hits = cosine_topk(categories, asked, "category", self.cfg.topk_summary).join(categories.select("category", "keywords", "summary", "comment_count"), "category")
        out = {
            "text_recall": to_list(self.index.search(asked, ["query_id"], "query", k), "text"),
            "vector_recall": to_list(cosine_topk(self.stores.comment_vectors(), asked, "doc_id", k, filters), "vector"),
            "reverse_recall": to_list(near, "reverse"),
            "summary_recall": hits.select(F.lit(0).alias("query_id"), F.col("query_id").alias("query_idx"), "category", "rank", "score", "keywords", "summary", "comment_count"),
        }
        if info.hyde_answer:
            hyde = self.spark.createDataFrame([(0, self.embedder.embed([info.hyde_answer])[0], info.intent["room_type"], info.intent["fuzzy_room_type"])], "query_id int, embedding array<double>, intent_room_type string, intent_fuzzy_room_type string")
            out["hyde_recall"] = to_list(cosine_topk(self.stores.comment_vectors(), hyde, "doc_id", k, filters), "hyde")
        return out

    def recall(self, info: QueryInfo, timings: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
        """(lists, summaries) of the question.  The routes run side by side; their seconds go into ``timings``, their few rows are kept."""
        timings = {} if timings is None else timings
        found = {name: df.persist() for name, df in self.routes(info).items()}
        with ThreadPoolExecutor(len(found)) as pool:
            list(pool.map(lambda name: _timed(timings, name, found[name].count), found))
        summaries = X.first_summaries(found.pop("summary_recall"))
        return fusion.union_lists(*found.values()), summaries

    def fuse(self, lists: DataFrame) -> DataFrame:
        return fusion.fuse(fusion.rank_lists(lists), self.cfg.rrf_k, limit=self.cfg.candidates).join(self.stores.comments(), "doc_id", "left")

    def rerank(self, query: str, fused: DataFrame) -> DataFrame:
        """The candidates (at most ``2 * topk_rerank``) go to the model; on failure the fused order stays."""
        rows = fused.orderBy("fused_rank").select("fused_rank", "comment").collect()
        if not rows:
            return ranking.rerank(fused, F.lit(0.0), self.cfg.topk_rerank)
        try:
            result = self.reranker.rerank(query, [r["comment"] or "" for r in rows], min(self.cfg.topk_rerank, len(rows)))
        except Exception:  # noqa: BLE001
            LOG.warning("the reranker failed, the fused order stays", exc_info=True)
            self.failures["rerank"] = self.failures.get("rerank", 0) + 1
            result = [(i, 1.0 / (i + 1)) for i in range(min(self.cfg.topk_rerank, len(rows)))]
        table = self.spark.createDataFrame([(0, int(rows[i]["fused_rank"]) - 1, float(s)) for i, s in result], "query_id int, index long, relevance double")
        return ranking.rerank(ranking.attach_by_position(fused, table), F.col("relevance"), self.cfg.topk_rerank)

    def rank(self, reranked: DataFrame, info: QueryInfo) -> DataFrame:
        return ranking.composite(reranked, F.lit(info.intent["time_sensitivity"] is not None), self.cfg, self.cfg.topk_final)

    def answer(self, query: str, summaries: DataFrame, final: DataFrame) -> str:
        row = X.context(summaries, final).first()
        prompt = f"Question: {query}\n\n{row['context'] if row else ''}\n\nAnswer from this evidence only, name opposing views, cite comment numbers, and close with advice."
        return self._ask("answer", prompt, 2048) or APOLOGY

    # --- whole runs ---
    def events(self, query: str, enable_hyde: bool = False) -> Iterator[dict[str, Any]]:
        """Progress events of a run, each stage ``running`` then ``done``; ``result`` or ``error`` at the end."""
        try:
            if not query or not query.strip():
                raise ValueError("the question is blank")
            t: dict[str, float] = {}
            begun = time.perf_counter()
            yield {"stage": "query_process", "status": "running", "detail": "understanding the question"}
            info = _timed(t, "query_process", lambda: self.process(query.strip(), enable_hyde, t))
            preview = info.hyde_answer[:100] + "..." if info.hyde_answer else None
            yield {"stage": "query_process", "status": "done", "duration": round(t["query_process"], 2), "intent": info.intent, "sub_queries": [{"query": q, "weight": w} for q, w in info.sub_queries], "hyde": preview}
            yield {"stage": "recall", "status": "running", "detail": f"{len(info.sub_queries)} sub-queries"}
            lists, summaries = _timed(t, "retrieve", lambda: self.recall(info, t))
            summaries = summaries.persist()
            found = summaries.orderBy("query_idx", "rank").collect()
            yield {"stage": "recall", "status": "done", "duration": round(t["retrieve"], 2), "summary_categories": [r["category"] for r in found]}
            yield {"stage": "fusion", "status": "running", "detail": "reciprocal ranks"}
            fused = self.fuse(lists).persist()
            count = _timed(t, "rrf_fusion", fused.count)
            t["retrieve"] += t["rrf_fusion"]
            yield {"stage": "fusion", "status": "done", "duration": round(t["rrf_fusion"], 2), "fused_count": count}
            yield {"stage": "rerank", "status": "running", "detail": f"{count} candidates"}
            reranked = _timed(t, "rerank", lambda: self.rerank(info.original, fused).persist())
            yield {"stage": "rerank", "status": "done", "duration": round(t["rerank"], 2), "reranked_count": reranked.count()}
            yield {"stage": "sort", "status": "running", "detail": "weighted features"}
            final = self.rank(reranked, info).persist()
            shown = _timed(t, "composite_score", lambda: X.result_rows(final).orderBy("rank").collect())
            yield {"stage": "sort", "status": "done", "duration": round(t["composite_score"], 2)}
            yield {"stage": "generate", "status": "running", "detail": "writing the answer"}
            answer = _timed(t, "generate", lambda: self.answer(info.original, summaries, final))
            yield {"stage": "generate", "status": "done", "duration": round(t["generate"], 2)}
            t["total"] = time.perf_counter() - begun
            tops = [{k: v for k, v in r.asDict().items() if k != "query_id"} for r in shown]
            heads = [{"category": r["category"], "summary": r["summary"][:200] + "...", "comment_count": r["comment_count"]} for r in found]
            for df in (summaries, fused, reranked, final):
                df.unpersist()
            yield {"stage": "result", "status": "done", "answer": answer, "summaries": heads, "top_comments": tops, "latency": t, "info": info}
        except Exception as e:  # noqa: BLE001 - told to the listener
            yield {"stage": "error", "status": "error", "message": str(e)}

    def query(self, user_query: str, enable_hyde: bool = False) -> SearchResult:
        """The whole run; errors are raised."""
        for e in self.events(user_query, enable_hyde):
            if e["stage"] == "error":
                raise RuntimeError(e["message"])
            if e["stage"] == "result":
                return SearchResult(e["answer"], e["info"], e["summaries"], e["top_comments"], e["latency"])
        raise RuntimeError("no result")


def _timed(timings: dict[str, float], name: str, f: Callable[[], Any]) -> Any:
    begun = time.perf_counter()
    try:
        return f()
    finally:
        timings[name] = timings.get(name, 0.0) + time.perf_counter() - begun


def server_sent(events: Iterator[dict[str, Any]]) -> Iterator[str]:
    """Events as server-sent lines, closed by ``[DONE]``."""
    for e in events:
        yield f"data: {json.dumps({k: v for k, v in e.items() if k != 'info'}, ensure_ascii=False, default=str)}\n\n"
    yield "data: [DONE]\n\n"


def formatted(r: SearchResult) -> str:
    """A result as text for a console."""
    lines = [f"Question: {r.query_info.original}", "", r.answer, "", "Sub-queries:", *[f"  - {q} ({w:.2f})" for q, w in r.query_info.sub_queries], "", "Summaries:"]
    lines += [f"  - {s['category']} ({s['comment_count']}): {s['summary'][:100]}" for s in r.summaries]
    lines += ["", "Comments:", *[f"  [{c['rank']}] {c['score']:.4f} {c['room_type']} {c['publish_date']}: {(c['comment'] or '')[:200].replace(chr(10), ' ')}" for c in r.top_comments]]
    lines += ["", "Seconds: " + ", ".join(f"{k} {v:.3f}" for k, v in r.latency.items())]
    return "\n".join(lines)
