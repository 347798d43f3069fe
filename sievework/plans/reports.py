"""Queries of records for people to read, and of experiment matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import evaluate, reports
from sievework.functions import citations
from sievework.plans.evaluation import _ESC, _M, TITLED, _metrics, _ranked, _records, _renumbered_sql, cited_sql, source_catalogue_maps, source_sql


def review_sheet(spark, sf):
    return reports.review_sheet(_records(spark, sf, "query", "answer", "retrieved", "retrieval_gold_summary", "human"))


def score_overlay(spark, sf):
    """Human scores with the judge's laid over where it gave one."""
    r = _records(spark, sf, "human", "judge").select("id", F.col("human.precision").alias("precision"), F.col("judge.precision.score").alias("judged"))
    return reports.with_scores(r.select("id", "precision"), r.filter("judged is not null").select("id", F.col("judged").alias("precision")), ["precision"])


def snippets(spark, sf):
    r = _records(spark, sf, "retrieved").select("id", F.posexplode("retrieved").alias("i", "c"))
    return r.select("id", F.col("i").alias("position"), reports.snippet(F.col("i") + 1, F.col("c"), 120).alias("snippet"))


def _final(html):
    def query(spark, sf):
        r = _records(spark, sf, "answer", "retrieved").filter("answer is not null").crossJoin(F.broadcast(source_catalogue_maps(spark, sf)))
        return r.select("id", reports.final_answer(F.col("answer"), F.col("retrieved"), None, F.col("bases"), TITLED, html).alias("answer"))

    return query


final_answers, final_answers_html = _final(False), _final(True)


def rewrite_rate(spark, sf):
    return reports.rewrite_rate(_records(spark, sf, "query", "search_query").select(F.col("query").alias("before"), F.coalesce("search_query", "query").alias("after")))


def topk_ablation(spark, sf):
    """Metrics at several cuts from one ranked list, in long form."""
    m = evaluate.rollup(evaluate.metrics_at_k(_ranked(spark, sf), (4, 6, 8, 12), ("id", "method", "dataset")), "method")
    return reports.long_metrics(m.drop("queries"), ["method", "k"])


def eval_matrix(spark, sf):
    """Overall, by dataset, by method and by both, from one pass."""
    m = _metrics(spark, sf)
    return m.cube("dataset", "method").agg(F.count("*").alias("rows"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "mrr", "ndcg"))).select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("method", F.lit("all")).alias("method"), "rows", "hit", "mrr", "ndcg")


def record_slice(spark, sf):
    return reports.record_slice(_records(spark, sf, "method"), 20, 30)


_OWN = citations.OWN_SOURCES.replace("'", "''")
_CUT = f"rtrim(regexp_replace(answer, '{_OWN}', ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"


def _final_sql(html: bool) -> str:
    name, url = source_sql("retrieved[x]")
    shown = (lambda x: _ESC.format(x)) if html else (lambda x: x)
    line = f"concat('[', i, '] ', case when {url} is not null then concat('<a href=\"', {shown(url)}, '\">', {shown(name)}, '</a>') else {shown(name)} end)" if html else f"concat('[', i, '] ', {name}, coalesce(chr(10) || '   ' || {url}, ''))"
    return f"""with {cited_sql(_CUT)} select id, case when len(used) = 0 then {shown('answer')} else concat(rtrim({shown(_renumbered_sql('answer', 'used'))}), chr(10), chr(10), 'Источники:', chr(10), array_to_string(list_transform(used, lambda x, i: {line}), chr(10))) end as answer
from g, base where answer is not null"""


_ABLATION = _M.replace("(values (1), (3), (5), (10))", "(values (4), (6), (8), (12))")

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


def _cut_sql(x: str, limit: int) -> str:
    return f"(case when length({x}) > {limit} then regexp_replace(left({x}, {limit}), '[\\s\\x{{a0}}]+$', '') || '...' else {x} end)"


def _preview_sql(label: str) -> str:
    text = f"replace({_strip('coalesce(r.text, chr(32))')}, chr(13) || chr(10), chr(10))"
    return f"""(select {_cut_sql('p', 1200)} from (select coalesce(array_to_string(list_transform(list_filter(coalesce(retrieved, []), lambda r: coalesce(r.relevance_label = '{label}', false)), lambda r: concat('[', r.rank, '] ', {_cut_sql(text, 500)})), chr(10) || chr(10)), '') as p))"""


def _source_column_sql(n: int) -> str:
    keys = "; ', '".join(f"{k}=', coalesce(cast(retrieved[{n}].{k} as varchar), 'None'), '" for k in ("rank", "source_code", "external_id", "chunk_i"))
    return f"case when len(retrieved) >= {n} then concat('{keys}', case when retrieved[{n}].canonical_url <> '' then '; url=' || retrieved[{n}].canonical_url else '' end) else '' end as source_{n}"


_SHEET = f"""select id, query, coalesce(answer, '') as answer, {', '.join(f"{_preview_sql(x)} as {x}_context_preview" for x in ("gold_relevant", "hard_negative", "unknown"))},
 coalesce(array_to_string(retrieval_gold_summary.gold_relevant_ranks, ','), '') as gold_relevant_ranks, retrieval_gold_summary.has_gold_relevant_context as has_gold_relevant_context, {', '.join(map(_source_column_sql, (1, 2, 3)))},
 coalesce(human."precision", -1) as human_precision, coalesce(human.completeness, -1) as human_completeness, coalesce(human.format, -1) as human_format, coalesce(human.comment, '') as human_comment
from (select distinct id, query, answer, retrieved, retrieval_gold_summary, human from generation_record)"""

SQL = {
    "review_sheet": _SHEET,
    "final_answers": _final_sql(False), "final_answers_html": _final_sql(True),
    "score_overlay": 'select distinct id, coalesce(judge."precision".score, human."precision") as "precision" from generation_record',
    "snippets": """with r as (select id, unnest(retrieved) as c, generate_subscripts(retrieved, 1) - 1 as i from (select distinct id, retrieved from generation_record)),
t as (select id, i, c, replace(regexp_replace(coalesce(c.text, ''), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g'), chr(10), ' ') as x from r)
select id, cast(i as integer) as position, concat('[', i + 1, '] (', concat_ws(' / ', c.source_code, c.external_id, 'chunk ' || c.chunk_i), ')', case when c.score is not null then printf(' score=%.3f', cast(round(cast(c.score as decimal(12, 6)), 3) as double)) else '' end, chr(10),
 case when length(x) > 120 then regexp_replace(left(x, 120), '[\\s\\x{a0}]+$', '') || '…' else x end) as snippet from t""",
    "rewrite_rate": "select count(*) as n, count_if(trim(coalesce(search_query, query)) <> trim(query)) as changed, round(avg(cast(trim(coalesce(search_query, query)) <> trim(query) as integer)), 6) as rate from (select distinct id, query, search_query from generation_record)",
    "topk_ablation": f"""with {_ABLATION}, g as (select method, k, round(avg("precision"), 6) as "precision", round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by method, k)
select method, k, metric, value from g unpivot (value for metric in ("precision", hit, mrr, ndcg))""",
    "eval_matrix": f"with {_M} select coalesce(dataset, 'all') as dataset, coalesce(method, 'all') as method, count(*) as rows, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by cube (dataset, method)",
    "record_slice": "select distinct id, method from generation_record order by id limit 30 offset 20",
}

QUERIES = {f.__name__: f for f in (review_sheet, score_overlay, snippets, rewrite_rate, topk_ablation, eval_matrix, record_slice)} | {"final_answers": final_answers, "final_answers_html": final_answers_html}
