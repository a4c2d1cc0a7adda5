"""The SQL twin of every query that SQL can state."""

from __future__ import annotations

from .schema import SearchConfig

CFG = SearchConfig()

#: Common table expressions by name; each lists the ones it builds on.
CTE: dict[str, tuple[str, str]] = {
    "cv": ("", """select doc_id, coalesce(comment, '') as comment, coalesce(room_type, '') as room_type, coalesce(fuzzy_room_type, '') as fuzzy_room_type,
        coalesce(score, 0) as score_val, coalesce(publish_date, '') as publish_date, coalesce(quality_score, 0) as quality_score, coalesce(comment_len, 0) as comment_len,
        coalesce(useful_count, 0) as useful_count, coalesce(review_count, 0) as review_count, coalesce(images, '') as images
        from (select *, row_number() over (partition by doc_id order by useful_count desc nulls last, review_count desc nulls last, score desc nulls last,
              publish_date desc nulls last, comment_len desc nulls last, images desc nulls last) as rn from comments where doc_id is not null) where rn = 1"""),
    "nv": ("", "select count(*) as n from embeddings"),
    "ev": ("", "select vec_id, cast(embedding as double[]) as e from embeddings"),
    "qs": ("", "select distinct query_id, query, intent_room_type, intent_fuzzy_room_type, time_sensitivity, hyde from query_log where query_id % 20 = 0"),
    "qv": ("qs nv ev", "select qs.*, ev.e as qe from qs, nv join ev on ev.vec_id = (query_id * 7) % n"),
    "ql_all": ("", "select distinct query_id, query, intent_room_type, intent_fuzzy_room_type, time_sensitivity, hyde from query_log"),
    "classes": ("", "select fuzzy_room_type as class, row_number() over (order by fuzzy_room_type) - 1 as no from cutoff_targets"),
    "qc": ("qv classes", "select qv.* replace (coalesce(nullif(intent_fuzzy_room_type, ''), class) as intent_fuzzy_room_type) from qv left join classes on no = (query_id // 20) % 9"),
    "qch": ("qs nv ev classes", "select qs.* replace (coalesce(nullif(intent_fuzzy_room_type, ''), class) as intent_fuzzy_room_type), ev.e as qe from qs left join classes on no = (query_id // 20) % 9, nv join ev on ev.vec_id = (query_id * 7 + 3) % n"),
    "qt": ("qs nv ev", "select qs.*, ev.e as qe from qs, nv join ev on ev.vec_id = (query_id * 7 + 11) % n"),
    "cvec": ("nv ev", "select c.*, ev.e as ce from (select distinct doc_id, room_type, fuzzy_room_type from comments where doc_id is not null) c, nv join ev on ev.vec_id = cast(doc_id as bigint) % n"),
    "rq": ("", "select distinct * from reverse_queries where query_id is not null and comment_id is not null"),
    "rvec": ("rq nv ev", "select rq.query_id as question_id, comment_id, room_type, fuzzy_room_type, ev.e as ce from rq, nv join ev on ev.vec_id = cast(substr(rq.query_id, 7) as bigint) % n"),
    "catv": ("nv ev", "select c.*, ev.e as ce from (select *, row_number() over (order by category) - 1 as no from category_summaries) c, nv join ev on ev.vec_id = no % n"),
    "sw": ("", "select distinct lower(trim(word)) as word from stop_words where trim(word) <> ''"),
    "docs": ("", "select doc_id, min(comment) as comment from comments where doc_id is not null group by doc_id"),
    "tok": ("docs", "select doc_id, unnest({tokens}) as term from docs".replace("{tokens}", "flatten(list_transform(regexp_extract_all(lower(coalesce(comment, '')), '[a-z]+|[\\x{4e00}-\\x{9fff}]+'), lambda r: case when regexp_matches(r, '^[a-z]') or length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))")),
    "post": ("tok sw", "select doc_id, term, count(*) as tf from tok where term not in (select word from sw) group by 1, 2"),
    "lens": ("docs post", "select d.doc_id, cast(coalesce(sum(tf), 0) as bigint) as dl from docs d left join post p on p.doc_id = d.doc_id group by 1"),
    "stats": ("lens", "select count(*) as n, coalesce(avg(dl), 0) as avgdl from lens"),
    "df": ("post", "select term, count(*) as df from post group by 1"),
    "s3": ("catv qv", "select * from (select *, row_number() over (partition by query_id order by score desc, category) as rank from (select query_id, category, summary, comment_count, round(list_dot_product(ce, qe) / sqrt(list_dot_product(ce, ce) * list_dot_product(qe, qe)), 6) as score from catv, qv)) where rank <= 3"),
    "s3t": ("catv qt", "select * from (select *, row_number() over (partition by query_id order by score desc, category) as rank from (select query_id, category, summary, comment_count, round(list_dot_product(ce, qe) / sqrt(list_dot_product(ce, ce) * list_dot_product(qe, qe)), 6) as score from catv, qt)) where rank <= 3"),
    "sfirst": ("s3 s3t", "select query_id, category, query_idx, rank, summary, comment_count from (select *, row_number() over (partition by query_id, category order by query_idx, rank) as fs from (select *, 0 as query_idx from s3 union all select *, 1 as query_idx from s3t)) where fs = 1"),
    "logged": ("", "select *, cast(case source when 'hyde' then 1000000 when 'text' then query_idx * 3 when 'vector' then query_idx * 3 + 1 when 'reverse' then query_idx * 3 + 2 end as bigint) as list_no from (select distinct * from recall_results)"),
    "ranked": ("logged", "select *, row_number() over (partition by query_id, list_no order by score desc nulls last, hit_rank, doc_id) as rank from logged"),
    "fusedall": ("ranked", """select *, row_number() over (partition by query_id order by rrf desc, first_list, first_rank) as fused_rank from (
        select query_id, doc_id, round(sum(cast(1 as double) / (60 + rank)), 10) as rrf, count(*) as hits, min(list_no) as first_list,
        cast(min(list_no * 10000000000 + rank) % 10000000000 as bigint) as first_rank, arg_min(source, list_no * 10000000000 + rank) as source, arg_min(query_idx, list_no * 10000000000 + rank) as query_idx,
        string_agg(source || ': #' || rank || ' (Q' || query_idx || ')', '; ' order by list_no, rank) as routes from ranked group by 1, 2)"""),
    "cut": ("fusedall", "select * from fusedall where fused_rank <= 80"),
    "ql": ("", "select distinct query_id, time_sensitivity from query_log"),
}

TIME = "case when {flag} and regexp_full_match(publish_date, '\\d{4}-\\d{1,2}-\\d{1,2}') and try_cast(publish_date as date) is not null then greatest(0, 1 - date_diff('day', try_cast(publish_date as date), date '2025-04-16') / cast(730 as double)) else cast(0.5 as double) end"
SCORE = """round(0.4::double * rerank_score + 0.25::double * quality_score / 10 + 0.05::double * comment_len / greatest(m1, 1) + 0.05::double * review_count / greatest(m2, 1) + 0.05::double * useful_count / greatest(m3, 1) + 0.2::double * {time}, 6)"""
#: The composite over a reranked set ``{src}``.
FINAL = """select *, row_number() over (partition by query_id order by final_score desc, rerank_rank) as final_rank from (select *, {score} as final_score from (
    select *, max(comment_len) over (partition by query_id) as m1, max(review_count) over (partition by query_id) as m2, max(useful_count) over (partition by query_id) as m3 from {src}))"""


def _final(src: str, flag: str) -> str:
    return FINAL.replace("{score}", SCORE.replace("{time}", TIME.replace("{flag}", flag))).replace("{src}", src)


#: The tokens of a query, one a row.
TOKENS = "unnest(flatten(list_transform(regexp_extract_all(lower(coalesce(query, '')), '[a-z]+|[\\x{4e00}-\\x{9fff}]+'), lambda r: case when regexp_matches(r, '^[a-z]') or length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end)))"
#: Similarity of the vectors ``ce`` and ``qe``, and the rows a query's filters let through.
COS = "round(list_dot_product(ce, qe) / sqrt(list_dot_product(ce, ce) * list_dot_product(qe, qe)), 6)"
SEEN = "(coalesce(intent_room_type, '') = '' or intent_room_type = room_type) and (coalesce(intent_fuzzy_room_type, '') = '' or intent_fuzzy_room_type = fuzzy_room_type)"
#: What reranking needs of a document, with the fields stored with its question first and defaults last.
FIELDS = "coalesce(st.comment, cv.comment, '') as comment, coalesce(st.room_type, cv.room_type, '') as room_type, coalesce(st.fuzzy_room_type, cv.fuzzy_room_type, '') as fuzzy_room_type, coalesce(score_val, 0) as score_val, coalesce(publish_date, '') as publish_date, coalesce(quality_score, 0) as quality_score, coalesce(comment_len, 0) as comment_len, coalesce(useful_count, 0) as useful_count, coalesce(review_count, 0) as review_count, coalesce(images, '') as images"


def _top(key: str, score: str, source: str, k: int, by: str = "query_id", extra: str = "") -> str:
    return f"select * from (select *, row_number() over (partition by {by} order by score desc, {key}) as rank from (select {by}, {key}{extra}, {score} as score from {source})) where rank <= {k}"


def _bm25(queries: str, by: str) -> str:
    tokens = f"select {by}, term, count(*) as qtf from (select {by}, {TOKENS} as term from {queries}) where term not in (select word from sw) group by all"
    score = "round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6)"
    return f"""select * from (select *, row_number() over (partition by {by} order by score desc, doc_id) as rank from (
        select {by}, p.doc_id, {score} as score from ({tokens}) join df using (term) join post p using (term) join lens l on l.doc_id = p.doc_id, stats group by {by}, p.doc_id)) where rank <= 150"""


def _reranked(cut: str, stored: str, on: str) -> str:
    """The best 40 of the documents of ``cut`` by the likeness of their vectors; ``stored`` holds the fields kept with questions."""
    return f"""select * from (select *, row_number() over (partition by query_id order by rerank_score desc, fused_rank) as rerank_rank from (
        select c.*, ql.time_sensitivity, {FIELDS}, round((list_dot_product(a.e, b.e) + 1) / 2, 6) as rerank_score
        from (select * from {cut} where fused_rank <= 80) c join ql using (query_id) left join cv on cv.doc_id = c.doc_id left join {stored} st on c.source = 'reverse' and {on},
        nv join ev a on a.vec_id = (c.query_id * 7) % n join ev b on b.vec_id = cast(c.doc_id as bigint) % n)) where rerank_rank <= 40"""


CTE["bm"] = ("qs sw df post lens stats", _bm25("qs", "query_id"))
CTE["qtok"] = ("qs sw", CTE["bm"][1][CTE["bm"][1].index("from (select query_id, term") + 6 : CTE["bm"][1].index(") join df using")])
CTE["vk"] = ("cvec qv", _top("doc_id", COS, "cvec, qv", 150))
CTE["vf"] = ("cvec qc", _top("doc_id", COS, f"cvec, qc where {SEEN}", 150))
CTE["hf"] = ("cvec qch", _top("doc_id", COS, f"cvec, qch where {SEEN}", 150))
CTE["rf"] = ("rvec qc", _top("question_id", COS, f"rvec, qc where {SEEN}", 150, extra=", comment_id as doc_id"))
CTE["gone"] = ("rq", "select comment_id as doc_id, arg_min(comment, query_id) as comment, arg_min(room_type, query_id) as room_type, arg_min(fuzzy_room_type, query_id) as fuzzy_room_type from rq where comment_id not in (select doc_id from comments where doc_id is not null) group by 1")
CTE["rr"] = ("cut ql cv nv ev gone", _reranked("cut", "gone", "st.doc_id = c.doc_id"))
CTE["fin"] = ("rr", _final("rr", "time_sensitivity is not null"))
CTE["logged2"] = ("logged", "select * from logged where source <> 'hyde'")
CTE["ranked2"] = ("logged2", CTE["ranked"][1].replace("from logged", "from logged2"))
CTE["fused2"] = ("ranked2", CTE["fusedall"][1].replace("from ranked", "from ranked2"))
CTE["sub_e"] = ("qv", "select *, 0 as query_idx from qv")
CTE["sub_m"] = ("qv qt", "select *, 0 as query_idx from qv union all select * replace (concat_ws(' ', query, intent_room_type, intent_fuzzy_room_type) as query), 1 as query_idx from qt")
CTE["qhy"] = ("qs nv ev", "select qs.*, ev.e as qe, 0 as query_idx from qs, nv join ev on ev.vec_id = (query_id * 7 + 3) % n where hyde")
for _v in "em":  # one sub-query a question, and two
    CTE[f"bm_{_v}"] = (f"sub_{_v} sw df post lens stats", _bm25(f"sub_{_v}", "query_id, query_idx"))
    CTE[f"vf_{_v}"] = (f"cvec sub_{_v}", _top("doc_id", COS, f"cvec, sub_{_v} where {SEEN}", 150, "query_id, query_idx"))
    CTE[f"rf_{_v}"] = (f"rvec sub_{_v}", _top("question_id", COS, f"rvec, sub_{_v} where {SEEN}", 150, "query_id, query_idx", ", comment_id as doc_id"))
    CTE[f"hf_{_v}"] = ("cvec qhy", _top("doc_id", COS, f"cvec, qhy where {SEEN}", 150, "query_id, query_idx"))
    CTE[f"lists_{_v}"] = (
        f"bm_{_v} vf_{_v} rf_{_v} hf_{_v}",
        f"""select *, cast(case source when 'hyde' then 1000000 when 'text' then query_idx * 3 when 'vector' then query_idx * 3 + 1 else query_idx * 3 + 2 end as bigint) as list_no from (
        select query_id, query_idx, 'text' as source, rank, doc_id, score from bm_{_v} union all select query_id, query_idx, 'vector', rank, doc_id, score from vf_{_v}
        union all select query_id, query_idx, 'reverse', rank, doc_id, score from rf_{_v} union all select query_id, query_idx, 'hyde', rank, doc_id, score from hf_{_v})""",
    )
    CTE[f"cut_{_v}"] = (f"lists_{_v}", CTE["fusedall"][1].replace("from ranked", f"from lists_{_v}"))
    CTE[f"st_{_v}"] = (f"rf_{_v} rq", f"select r.query_id, query_idx, rank, rq.comment, rq.room_type, rq.fuzzy_room_type from rf_{_v} r join rq on rq.query_id = r.question_id")
    CTE[f"rr_{_v}"] = (f"cut_{_v} st_{_v} ql cv nv ev", _reranked(f"cut_{_v}", f"st_{_v}", "st.query_id = c.query_id and st.query_idx = c.query_idx and st.rank = c.first_rank"))
CTE["efin"] = ("rr_e", _final("rr_e", "time_sensitivity is not null"))
CTE["efin_on"] = ("rr_e", _final("rr_e", "true"))
CTE["mfin"] = ("rr_m", _final("rr_m", "time_sensitivity is not null"))


def _with(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in CTE[name][0].split():
                add(x)
            order.append(name)

    for n in names.split():
        add(n)
    return "with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" + body


def oracle_sql() -> dict[str, str]:
    sql = {
        "comments_view": ("cv", "select * from cv"),
        "typed_defaults": ("", "select coalesce(quality_score, 0) as quality_score, coalesce(fuzzy_room_type, '') as fuzzy_room_type, count(*) as n, cast(sum(coalesce(useful_count, 0)) as bigint) as useful, cast(sum(coalesce(comment_len, 0)) as bigint) as chars from comments group by 1, 2"),
        "field_fallback": ("rq cv", "select rq.query_id, comment_id as doc_id, coalesce(rq.room_type, cv.room_type, '') as room_type, coalesce(nullif(rq.fuzzy_room_type, '大床房'), cv.fuzzy_room_type, '') as fuzzy_room_type, coalesce(cv.publish_date, '') as publish_date from rq left join cv on cv.doc_id = comment_id"),
        "stringify_fields": ("cv", "select doc_id as id, cast(quality_score as varchar) as rating, cast(useful_count as varchar) as likes, room_type as room from cv"),
        "output_truncate": ("cv", "select doc_id, case when length(comment) > 300 then substr(comment, 1, 300) || '...' else comment end as comment, replace(substr(comment, 1, 200), chr(10), ' ') as line from cv"),
        "summary_truncate": ("", "select category, substr(summary, 1, 200) || '...' as summary, comment_count from category_summaries"),
        "hyde_preview": ("ql_all", "select query_id, case when hyde and query <> '' then substr(query, 1, 100) || '...' end as preview from ql_all"),
        "prefilter_conj": ("cv ql_all", "select query_id, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from ql_all q join cv on (coalesce(intent_room_type, '') = '' or intent_room_type = room_type) and (coalesce(intent_fuzzy_room_type, '') = '' or intent_fuzzy_room_type = fuzzy_room_type) group by query_id, query, intent_room_type, intent_fuzzy_room_type, time_sensitivity, hyde"),
        "token_filter": ("", "select term, count(*) as n from (select unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) as term from documents) where regexp_full_match(term, '[\\x{4e00}-\\x{9fff}a-z]+') group by 1"),
        "stopword_antijoin": ("ql_all sw", CTE["qtok"][1].replace("from qs", "from ql_all").replace("as qtf", "as n")),
        "strip_blanks": ("ql_all", "select query_id, regexp_replace(query, '[\\s\\x{3000}\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}]+', '', 'g') as query from ql_all"),
        "tokenize": ("tok", "select doc_id, count(*) as n from tok group by 1"),
        "term_freq": ("post", "select * from post"),
        "doc_length": ("lens", "select * from lens"),
        "corpus_stats": ("stats", "select n, round(avgdl, 6) as avgdl from stats"),
        "doc_freq": ("df", "select * from df"),
        "term_idf": ("df stats", "select term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from df, stats"),
        "bm25_search": ("bm", "select * from bm"),
        "text_recall_meta": ("bm cv", "select query_id, bm.doc_id, rank, coalesce(comment, '') as comment, coalesce(score_val, 0) as score_val, coalesce(images, '') as images from bm left join cv on cv.doc_id = bm.doc_id"),
        "cosine_topk": ("vk", "select * from vk"),
        "cosine_topk_filtered": ("vf", "select * from vf"),
        "reverse_recall": ("rf cv", "select query_id, question_id, rf.doc_id, score, rank, coalesce(comment, '') as comment from rf left join cv on cv.doc_id = rf.doc_id"),
        "hyde_recall": ("hf", "select * from hf"),
        "summary_recall_top3": ("s3", "select * from s3"),
        "pairwise_dot": ("qv", "select query_id, count(*) as n, round(max(list_dot_product(cast(embedding as double[]), qe)), 6) as best from embeddings, qv group by 1"),
        "category_centres": ("", 'select label, dim, count(*) as n, round(avg(x), 6) as centre from (select label, cast(unnest(range(0, len(embedding))) as integer) as dim, cast(unnest(embedding) as double) as x from embeddings) group by 1, 2'),
        "recall_union": ("logged", "select query_id, list_no, source, count(*) as n from logged group by 1, 2, 3"),
        "list_rank": ("ranked", "select query_id, list_no, doc_id, hit_rank, rank from ranked"),
        "rrf_fuse": ("fusedall", "select query_id, doc_id, rrf, hits, fused_rank from fusedall"),
        "rrf_routes": ("fusedall", "select query_id, doc_id, routes from fusedall"),
        "rrf_first_seen": ("fusedall", "select query_id, doc_id, source, query_idx, first_rank from fusedall"),
        "fused_cut80": ("cut", "select query_id, doc_id, fused_rank from cut"),
        "rerank_top40": ("rr", "select query_id, doc_id, rerank_score, rerank_rank from rr"),
        "rerank_positional": ("cut", "select query_id, doc_id, round(cast(1 as double) / fused_rank, 6) as relevance from cut where fused_rank % 2 = 1"),
        "feature_max_norm": ("rr", "select query_id, cast(coalesce(nullif(max(comment_len), 0), 1) as bigint) as max_comment_len, cast(coalesce(nullif(max(review_count), 0), 1) as bigint) as max_review_count, cast(coalesce(nullif(max(useful_count), 0), 1) as bigint) as max_useful_count from rr group by 1"),
        "timeliness_on": ("cv", f"select doc_id, round({TIME.replace('{flag}', 'true')}, 6) as timeliness from cv"),
        "timeliness_off": ("cv", "select doc_id, cast(0.5 as double) as timeliness from cv"),
        "composite_score": ("fin", "select query_id, doc_id, final_score, final_rank from fin"),
        "final_top10": ("fin", "select query_id, doc_id, final_rank from fin where final_rank <= 10"),
        "result_payload": ("fin", "select query_id, final_rank as rank, cast(round(cast(final_score as decimal(18,6)), 4) as double) as score, cast(round(cast(rerank_score as decimal(18,6)), 4) as double) as rerank_score, doc_id, room_type, score_val, publish_date, quality_score, case when length(comment) > 300 then substr(comment, 1, 300) || '...' else comment end as comment, routes from fin where final_rank <= 10"),
        "summary_dedupe": ("sfirst", "select query_id, category, query_idx, rank from sfirst"),
        "context_prompt": ("sfirst fin", """select query_id, concat_ws(chr(10) || chr(10), s, c) as context from
            (select query_id, '# Category summaries' || chr(10) || chr(10) || string_agg('- ' || category || ' (' || comment_count || ' comments): ' || summary, chr(10) || chr(10) order by query_idx, rank) as s from sfirst group by 1)
            full join (select query_id, '# Guest comments' || chr(10) || chr(10) || string_agg('[' || final_rank || '] room: ' || room_type || ', score: ' || printf('%.1f', score_val) || ', date: ' || publish_date || chr(10) || comment, chr(10) || chr(10) order by final_rank) as c from fin where final_rank <= 10 group by 1) using (query_id)"""),
        "event_counts": ("logged rr", 'select l.*, coalesce(r, 0) as reranked_count from (select query_id, count(distinct doc_id) as fused_count, count(distinct query_idx) as sub_queries from logged group by 1) l left join (select query_id, count(*) as r from rr group by 1) using (query_id)'),
        "intent_flags": ("ql_all", "select query_id, time_sensitivity is not null as time_sensitive, coalesce(intent_room_type, '') <> '' as by_room from ql_all"),
        "upsert_missing": ("rq", "select query_id, comment_id from rq where comment_id not in (select doc_id from comments where doc_id is not null)"),
        "upsert_last_wins": ("", "select doc_id, useful_count, review_count from (select *, row_number() over (partition by doc_id order by useful_count desc nulls last, review_count desc nulls last) as rn from comments where doc_id is not null) where rn = 1"),
        "build_counts": ("", " union all ".join(f"select '{t}' as store, count(*) as n from {t}" for t in ("comments", "reverse_queries", "category_summaries", "stop_words", "query_log", "recall_results"))),
        "hybrid_search_e2e": ("efin", "select query_id, final_rank, doc_id, final_score, rrf, rerank_rank, routes from efin where final_rank <= 10"),
        "hybrid_search_time_sensitive": ("efin_on", "select query_id, final_rank, doc_id, final_score from efin_on where final_rank <= 10"),
        "category_vectors": ("", 'select label, comment_count, vec_id, round(list_sum(cast(embedding as double[])), 6) as total from (select label, count(*) as comment_count, min(vec_id) as vec_id from embeddings group by 1) join (select vec_id, embedding from embeddings) using (vec_id)'),
        "hyde_fused": ("fusedall fused2", 'select a.query_id, a.doc_id, a.rrf, coalesce(b.rrf, 0) as rrf_without from fusedall a left join fused2 b using (query_id, doc_id) where a.rrf > coalesce(b.rrf, 0)'),
        "bm25_multi_query": ("bm_m", 'select * from bm_m'),
        "multi_query_topk": ("cvec sub_m", 'select * from (select *, row_number() over (partition by query_id, query_idx order by score desc, doc_id) as rank from (select query_id, query_idx, doc_id, round(list_dot_product(ce, qe) / sqrt(list_dot_product(ce, ce) * list_dot_product(qe, qe)), 6) as score from cvec, sub_m)) where rank <= 150'),
        "hybrid_search_multi_query": ("mfin", 'select query_id, final_rank, doc_id, final_score, rrf, rerank_rank, routes from mfin where final_rank <= 10'),
        "intent_parse": ("ql_all", "select query_id, case when query_id % 3 < 2 then coalesce(intent_room_type, '') else '' end as room_type, case when query_id % 3 < 2 then coalesce(intent_fuzzy_room_type, '') else '' end as fuzzy_room_type, case when query_id % 3 < 2 then coalesce(time_sensitivity, '') else '' end as time_sensitivity from ql_all"),
        "subquery_parse": ("ql_all", "select query_id, 0 as query_idx, case when query_id % 3 < 2 then 'a ' || coalesce(intent_room_type, '') else coalesce(query, '') end as query, case when query_id % 3 < 2 then cast(0.75 as double) else cast(1 as double) end as weight from ql_all union all select query_id, 1, 'b ' || coalesce(intent_room_type, ''), cast(0.25 as double) from ql_all where query_id % 3 < 2"),
    }
    out = {k: _with(names, body) if names else body for k, (names, body) in sql.items()}
    out["bm25_repeated_term"] = out["bm25_search"].replace("coalesce(query, '')", "coalesce(query || ' ' || query, '')")
    out["fused_without_hyde"] = _with("fused2", "select query_id, doc_id, rrf, fused_rank from fused2 where fused_rank <= 80")
    return out
