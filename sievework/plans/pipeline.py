"""Queries of the reindex, of experiment matrices, and of what surrounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.numbers import norm
from sievework.functions.text import html_escape
from sievework.operators import extract, matrices, registry
from sievework.plans.evaluation import _M, _metrics, _ranked, _records
from sievework.plans.retrieval import _bm25_sql, _corpus, _titled, sql_terms
from sievework.plans.texts import _LEGAL_TEXT, _NAMESPACE, _REPORT, _UUID, _WARN, _normal
from sievework.sources import load, spread

SIZES = ((512, 64), (1024, 128))
EMBEDDERS = ("hashing", "hashing_256")
PROFILES = ("raw", "clean_basic", "clean_legal")


def reindex_points(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cleaned, cut, embedded and named for their collection."""
    p = matrices.points(spread(load(spark, sf, "documents").select("doc_id", "source", "text")))
    unit = F.abs(norm(F.col("vector")) - 1) < 1e-5
    return p.select("doc_id", "chunk_i", "point_id", F.length("text").alias("chars"), F.round("removed_ratio", 6).alias("removed_ratio"), "collection", F.size("vector").alias("dimension"), (unit | (norm(F.col("vector")) == 0)).alias("unit"))


def _own(spark, sf, ranked):
    return matrices.self_retrieval(ranked, F.col("doc_id") == F.col("query_id"))


def matrix_retrieval(spark, sf):
    """How often a document is found by its own title: dense, lexical and fused."""
    return _own(spark, sf, matrices.retrieval_matrix(_corpus(spark, sf), _titled(spark, sf)))


def matrix_embedders(spark, sf):
    return _own(spark, sf, matrices.embedder_matrix(_corpus(spark, sf), _titled(spark, sf), EMBEDDERS))


def matrix_chunking(spark, sf):
    return _own(spark, sf, matrices.chunking_matrix(_corpus(spark, sf), _titled(spark, sf), SIZES))


def matrix_rerankers(spark, sf):
    """Metrics of the retrieved lists as they are and reranked."""
    r = _ranked(spark, sf).join(_records(spark, sf, "query"), "id").select(F.col("id").alias("query_id"), "query", "text", "rank", F.coalesce("is_gold_relevant", F.lit(False)).alias("gold"))
    return matrices.self_retrieval(matrices.reranker_matrix(r).filter("rank <= 3"), F.col("gold"))


def matrix_cleaning(spark, sf):
    return matrices.cleaning_matrix(spread(load(spark, sf, "documents").select("doc_id", "text")), PROFILES)


def judge_contexts(spark, sf):
    return _records(spark, sf, "retrieved").select("id", matrices.judge_context(F.col("retrieved")).alias("context"))


def collection_names(spark, sf):
    c = load(spark, sf, "chunking_config").filter("chunk_size is not null and chunk_overlap is not null")
    tag = matrices.chunk_tag(F.col("chunk_method"), F.col("chunk_size"), F.col("chunk_overlap"))
    return c.select("config_id", tag.alias("tag"), matrices.collection_name(F.lit("org/Model-v2.base"), tag).alias("collection"))


def yes_no_scores(spark, sf):
    """Two numbers of each vector read as the logits of yes and no."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return load(spark, sf, "embeddings").select("vec_id", F.round(matrices.yes_probability(at(0), at(1)), 6).alias("yes"))


def valid_reports(spark, sf):
    m = _metrics(spark, sf).filter("k = 3").groupBy("dataset", "method").agg(*(F.avg(c).alias(c) for c in ("precision", "hit", "mrr", "ndcg")))
    n = _records(spark, sf, "dataset", "method", "retrieved").select("dataset", "method", F.size(F.coalesce("retrieved", F.array())).alias("n"))
    return matrices.valid_reports(m, n, ["dataset", "method"], ("precision", "hit", "mrr", "ndcg"))


def source_report(spark, sf):
    """Sources by their share of questions with a hit, the worst first."""
    best = _ranked(spark, sf).filter("rank = 1").select("id", F.coalesce(F.nullif("source_code", F.lit("")), F.lit("unknown")).alias("source"))
    per = _metrics(spark, sf).filter("k = 5").join(best, "id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"))
    from pyspark.sql import Window

    return per.withColumn("place", F.row_number().over(Window.orderBy("hit", "source")))  # one row for each source


def acceptance_upsert(spark, sf):
    """The last event of each user and kind: what a keyed store holds after all of the log."""
    return registry.latest_values(load(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


def event_log_append(spark, sf):
    """The log after a part of it is appended again: rows are told by their id."""
    log = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    grown = registry.insert_missing(log.filter("event_id % 3 <> 0"), log.filter("event_id % 2 = 0"), ["event_id"])
    return grown.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))


def registry_indexed(spark, sf):
    """Documents by kind after those with a loaded text are marked as indexed."""
    rows = load(spark, sf, "rag_doc")
    done = load(spark, sf, "local_document").select(F.col("doc_id").alias("id"))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return matrices.marked_indexed(rows, done, now).groupBy("kind").agg(F.count_if(F.col("indexed_at") == now).alias("marked"), F.count("*").alias("n"))


#: A page without a word has no main text of its own.
WORD = "[0-9A-Za-zА-Яа-яЁё]"


def _pages(spark, sf):
    """Documents as pages: title, navigation to be left out, the text as paragraphs, a link."""
    d = spread(load(spark, sf, "documents").select("doc_id", "title", "text", "url")).filter(F.col("text").rlike(WORD))
    page = F.concat(
        F.lit("<html><head><title>"), html_escape(F.coalesce("title", F.lit(""))), F.lit('</title><style>p {}</style></head><body><nav>menu</nav><div class="page-content__center"><p>'),
        F.array_join(F.transform(F.split("text", "\r\n|\n|\r", -1), html_escape), "</p><p>"), F.lit('</p><a href="'), html_escape(F.coalesce("url", F.lit("#"))), F.lit('"></a></div></body></html>'),
    )
    return extract.extracted(d.select("doc_id", "url", F.encode(page, "UTF-8").alias("content")))


def html_title(spark, sf):
    return _pages(spark, sf).select("doc_id", "page.title")


def html_words(spark, sf):
    """The words of the main text, in order."""
    return _pages(spark, sf).select("doc_id", F.array_join(F.regexp_extract_all("page.main", F.lit("[0-9A-Za-zА-Яа-яЁё]+"), F.lit(0)), " ").alias("words"))


def html_links(spark, sf):
    return _pages(spark, sf).select("doc_id", F.explode("page.links").alias("link")).filter("link like 'http%'")


_OWN = "select variant, count(*) as queries, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr from (select variant, query_id, max(cast(gold as integer)) as hit, coalesce(max(case when gold then 1 / rank end), 0) as mrr from ranked group by variant, query_id) group by variant"
_TITLED = "select doc_id as query_id, title as query from documents where doc_id % 100 = 0 and title is not null"


def _hashed(name: str, rows: str, text: str, size: int) -> str:
    """CTEs ``<name>_v (id, bucket, v)`` and ``<name>_n (id, n)`` of the hashing embedding."""
    return f"""{name}_v as (select id, bucket, sum(sign) as v from (select id, cast('0x' || left(md5(term), 8) as bigint) % {size} as bucket, case when cast('0x' || substring(md5(term), 9, 1) as integer) % 2 = 0 then 1.0 else -1.0 end as sign
  from (select id, unnest({sql_terms(text)}) as term from ({rows}))) group by id, bucket),
{name}_n as (select id, sqrt(sum(v * v)) as n from {name}_v group by id)"""


def _dense_sql(tag: str, size: int, k: int) -> str:
    """CTEs that end in ``near_<tag> (query_id, doc_id, score, rank)``."""
    return f"""{_hashed(f'd{tag}', 'select doc_id as id, text from documents', 'text', size)}, {_hashed(f'q{tag}', 'select doc_id as id, title from documents where doc_id % 100 = 0 and title is not null', 'title', size)},
dot{tag} as (select q.id as query_id, d.id as doc_id, sum(q.v * d.v) as s from q{tag}_v q join d{tag}_v d using (bucket) group by q.id, d.id),
all{tag} as (select q.id as query_id, d.id as doc_id, round(coalesce(s / nullif(q.n * d.n, 0), 0), 6) + 0.0 as score from q{tag}_n q cross join d{tag}_n d left join dot{tag} x on x.query_id = q.id and x.doc_id = d.id),
near_{tag} as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from all{tag} qualify rank <= {k})"""


def _chunked_sql() -> str:
    parts, names = [], []
    for size, overlap in SIZES:
        step, name = size - overlap, f"token_{size}_{overlap}"
        chunks = f"(select doc_id * 1000000 + i as doc_id, substring(text, cast(i * {step} + 1 as bigint), {size}) as text from (select *, unnest(range(0, cast(greatest(ceil((length(text) - {size}) / {step}), 0) as bigint) + 1)) as i from documents where text <> ''))"
        inner = _bm25_sql(_TITLED, 10).replace("from documents)", f"from {chunks})", 1)
        parts.append(f"{name} as (with {inner} select '{name}' as variant, query_id, doc_id // 1000000 = query_id as gold, rank from bm25)")
        names.append(f"select * from {name}")
    return f"with {', '.join(parts)}, ranked as ({' union all '.join(names)}) {_OWN}"


def _summary_sql(profile: str) -> str:
    if profile == "clean_legal":
        report = _REPORT
    else:
        text = "regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')" if profile == "raw" else _normal("nfc_normalize(coalesce(text, chr(32)))")
        report = f"with l as (select doc_id, coalesce(text, '') as source, {text} as text from documents), " + _REPORT.removeprefix(f"{_LEGAL_TEXT}, ")
    return f"(select '{profile}' as profile, * from ({report} select count(*) as docs, round(avg(removed_ratio), 6) as mean_removed_ratio, round(quantile_cont(removed_ratio, 0.95), 6) as p95_removed_ratio, count_if({_WARN} > 0) as warning_docs, round(avg(original_chars), 6) as mean_original_chars, round(avg(cleaned_chars), 6) as mean_cleaned_chars from r))"


SQL = {
    "reindex_points": f"""{_REPORT}, c as (select l.doc_id, r.removed_ratio, d.source, unnest(range(0, cast(greatest(ceil((length(l.text) - 1024) / 896), 0) as bigint) + 1)) as i, l.text from l join r using (doc_id) join documents d using (doc_id) where l.text <> ''),
w as (select doc_id, source, removed_ratio, cast(i as integer) as chunk_i, substring(text, cast(i * 896 + 1 as bigint), 1024) as text from c),
h as (select *, sha1({_NAMESPACE} || encode(concat_ws(':', coalesce(source, 'None'), doc_id, 'token', 1024, 128, chunk_i))) as h from w where trim(text) <> '')
select doc_id, chunk_i, {_UUID} as point_id, length(text) as chars, round(removed_ratio, 6) as removed_ratio, 'rag_chunks_hashing_token_1024_128' as collection, 64 as dimension, true as unit from h""",
    "matrix_retrieval": f"""with {_bm25_sql(_TITLED, 50)}, {_dense_sql('h', 64, 50)},
fused as (select coalesce(d.query_id, b.query_id) as query_id, coalesce(d.doc_id, b.doc_id) as doc_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) as score from near_h d full outer join bm25 b on d.query_id = b.query_id and d.doc_id = b.doc_id),
hybrid as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused),
ranked as (select 'dense' as variant, query_id, doc_id = query_id as gold, rank from near_h where rank <= 10 union all select 'bm25', query_id, doc_id = query_id, rank from bm25 where rank <= 10 union all select 'hybrid', query_id, doc_id = query_id, rank from hybrid where rank <= 10) {_OWN}""",
    "matrix_embedders": f"with {_dense_sql('a', 64, 10)}, {_dense_sql('b', 256, 10)}, ranked as (select 'hashing' as variant, query_id, doc_id = query_id as gold, rank from near_a union all select 'hashing_256', query_id, doc_id = query_id, rank from near_b) {_OWN}",
    "matrix_chunking": _chunked_sql(),
    "matrix_rerankers": f"""with r as (select id as query_id, query, unnest(retrieved, max_depth := 2) from (select distinct id, query, retrieved from generation_record)),
t as (select query_id, rank, coalesce(is_gold_relevant, false) as gold, list_distinct({sql_terms('query')}) as x, list_distinct({sql_terms('text')}) as y from r),
s as (select *, case when least(len(x), len(y)) > 0 then round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) else 0 end as score from t),
o as (select query_id, gold, row_number() over (partition by query_id order by score desc, rank) as rank from s),
ranked as (select 'none' as variant, query_id, gold, rank from t where rank <= 3 union all select 'overlap', query_id, gold, rank from o where rank <= 3) {_OWN}""",
    "matrix_cleaning": " union all ".join(_summary_sql(p) for p in PROFILES),
    "judge_contexts": """select id, case when coalesce(len(retrieved), 0) = 0 then 'Найденный контекст отсутствует.' else array_to_string(list_transform(retrieved, lambda r, i: concat('[Чанк ', i, ']', chr(10), 'Эталонная релевантность: ',
 coalesce(r.relevance_label, case when r.is_gold_relevant then 'gold_relevant' else 'unknown' end), chr(10), 'Уровень совпадения: ', coalesce(nullif(r.relevance_match_level, ''), 'none'), chr(10), 'Источник: source_code=', coalesce(r.source_code, 'None'), ', external_id=', coalesce(r.external_id, 'None'), ', chunk_i=', coalesce(r.chunk_i, 'None'), chr(10), 'Текст:', chr(10), trim(coalesce(r.text, '')))), chr(10) || chr(10)) end as context
from (select distinct id, retrieved from generation_record)""",
    "collection_names": """select config_id, tag, 'rag_chunks_model_v2_base_' || tag as collection from (select config_id, case when chunk_method = 'parent_child' then concat('parent', chunk_size, '_child', chunk_overlap) else concat(chunk_method, '_', chunk_size, '_', chunk_overlap) end as tag
from chunking_config where chunk_size is not null and chunk_overlap is not null)""",
    "yes_no_scores": "select vec_id, round(1 / (1 + exp(cast(embedding[2] as double) - cast(embedding[1] as double))), 6) as yes from embeddings",
    "valid_reports": f"""with {_M}, g as (select dataset, method, avg("precision") + avg(hit) + avg(mrr) + avg(ndcg) > 0 as good from m where k = 3 group by dataset, method),
n as (select dataset, method, bool_or(coalesce(len(retrieved), 0) > 0) as found from (select distinct id, dataset, method, retrieved from generation_record) group by dataset, method)
select dataset, method, good and found as valid from g join n using (dataset, method)""".replace("(values (1), (3), (5), (10))", "(values (3))"),
    "source_report": f"""with {_M}, b as (select id, coalesce(nullif(source_code, ''), 'unknown') as source from r where rank = 1),
p as (select source, count(*) as n, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr from m join b using (id) where k = 5 group by source)
select *, cast(row_number() over (order by hit, source) as integer) as place from p""",
    "acceptance_upsert": "select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "event_log_append": "select event_type, count(*) as rows, count(distinct event_id) as ids from events where event_id % 3 <> 0 or event_id % 2 = 0 group by event_type",
    "registry_indexed": "select kind, count_if(id in (select doc_id from local_document)) as marked, count(*) as n from rag_doc group by kind",
    "html_title": "select doc_id, left(nullif(trim(regexp_replace(coalesce(title, ''), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')), ''), 800) as title from documents where regexp_matches(text, '[0-9A-Za-zА-Яа-яЁё]')",
    "html_words": "select doc_id, array_to_string(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё]+'), ' ') as words from documents where regexp_matches(text, '[0-9A-Za-zА-Яа-яЁё]')",
    "html_links": "select doc_id, url as link from documents where regexp_matches(text, '[0-9A-Za-zА-Яа-яЁё]') and url like 'http%'",
}

QUERIES = {
    f.__name__: f
    for f in (
        reindex_points, matrix_retrieval, matrix_embedders, matrix_chunking, matrix_rerankers, matrix_cleaning, judge_contexts, collection_names, yes_no_scores, valid_reports, source_report, acceptance_upsert, event_log_append, registry_indexed,
        html_title, html_words, html_links,
    )
}
