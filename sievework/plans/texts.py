"""Queries on texts: cleaning, lines, chunks, questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.durable import ship
from sievework.functions import text as tx
from sievework.operators import chunkers, cleaning, lines, questions
from sievework.plans.retrieval import sql_terms
from sievework.sources import load, one_each, spread


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded records, some of which were delivered twice."""
    return spread(one_each(load(spark, sf, "local_document").select("doc_id", "text"), "doc_id"))


def boilerplate_lines(spark, sf):
    return lines.boilerplate_lines(_records(spark, sf))


def remove_boilerplate(spark, sf):
    docs = _records(spark, sf)
    return lines.without_boilerplate(docs, lines.boilerplate_lines(docs))


def dedup_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", lines.without_repeats(F.col("text")).alias("text"))


def _each_line(spark, sf, keep):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(lines.normal_lines(F.col("text"))).alias("line_no", "line"))
    return rows.filter(F.col("line") != "").filter(keep(F.col("line")))


def nav_noise_lines(spark, sf):
    return _each_line(spark, sf, lines.is_navigation)


def aggressive_noise_lines(spark, sf):
    return _each_line(spark, sf, lines.is_noise)


def legal_lines(spark, sf):
    return _each_line(spark, sf, lines.is_legal).groupBy("doc_id").agg(F.count("*").alias("legal_lines"))


def _cleaned(profile):
    def query(spark, sf):
        return cleaning.cleaned(_docs(spark, sf), profile).select("doc_id", "text")

    query.__name__ = profile
    return query


clean_raw, clean_basic, clean_legal, clean_aggressive, clean_no_boilerplate = (_cleaned(p) for p in cleaning.PROFILES)
clean_raw.__name__ = "clean_raw"


def cleaning_report(spark, sf):
    r = cleaning.with_report(cleaning.cleaned(_docs(spark, sf), "clean_legal"))
    return r.select("doc_id", "original_chars", "cleaned_chars", F.round("removed_ratio", 6).alias("removed_ratio"), "removed_lines", F.size("warnings").alias("warnings"))


def cleaning_summary(spark, sf):
    return cleaning.summary(cleaning.with_report(cleaning.cleaned(_docs(spark, sf), "clean_legal")))


def token_chunks(spark, sf):
    return chunkers.token_chunks(_docs(spark, sf), 1024, 256)


def chunk_overlap_lag(spark, sf):
    return chunkers.with_previous_tail(chunkers.token_chunks(_docs(spark, sf), 512, 0), 64)


def chunk_stats(spark, sf):
    c = chunkers.token_chunks(_docs(spark, sf), 512, 64).withColumn("n", F.length("text"))
    per_doc = F.count("*") / F.count_distinct("doc_id")
    return c.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.round(per_doc, 6).alias("per_doc"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


def chunk_point_ids(spark, sf):
    rows = load(spark, sf, "documents").filter("text is not null").select("doc_id", "source", F.posexplode(chunkers.windows(F.col("text"), 1024, 128)).alias("chunk_i", "text"))
    return rows.select("doc_id", "chunk_i", chunkers.point_id(F.col("source"), F.col("doc_id"), F.lit("token"), F.lit(1024), F.lit(128), F.col("chunk_i")).alias("point_id"))


def parent_child_chunks(spark, sf):
    return chunkers.parent_child_chunks(_docs(spark, sf), 2048, 512, 128, 64).select("doc_id", "parent_i", "child_i", F.length("parent_text").alias("parent_chars"), "child_text")


def _chunked(method, size, overlap):
    def query(spark, sf):
        return chunkers.chunks(_docs(spark, sf), method, size, overlap)

    return query


sentence_chunks, recursive_chunks, recursive_legal_chunks, semantic_chunks, ingest_chunks = (_chunked(*a) for a in (("sentence", 1024, 128), ("recursive", 1536, 0), ("recursive_legal", 1536, 128), ("semantic", 1024, 0), ("ingest", 1100, 160)))


def message_split(spark, sf):
    ship(spark)
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(chunkers.split_message)

    return _docs(spark, sf).filter("text <> ''").select("doc_id", F.posexplode(split("text")).alias("part_no", "part"))


#: Method, size and overlap of each chunker that packs by rules of its own.
CHUNKERS = (("sentence", 1024, 128), ("recursive", 1536, 0), ("recursive_legal", 1536, 128), ("semantic", 1024, 0), ("ingest", 1100, 160))


def chunk_invariants(spark, sf):
    """For each chunker how many texts it cut, and whether every chunk keeps its size (with the
    overlap put before it), is not blank, is numbered in order, and holds words of its text."""
    docs, out = _docs(spark, sf), None
    for method, size, overlap in CHUNKERS:
        c = chunkers.chunks(docs, method, size, overlap).join(docs.withColumnRenamed("text", "whole"), "doc_id")
        last = F.element_at(F.split(F.trim("text"), "\\s+", -1), -1)
        per = c.groupBy("doc_id").agg(F.bool_and(F.length("text") <= size + overlap + 1).alias("a"), F.bool_and(F.length(F.trim("text")) > 0).alias("b"), (F.max("chunk_i") == F.count("*") - 1).alias("c"), F.bool_and(F.col("whole").contains(last)).alias("d"))
        one = per.agg(F.count("*").alias("texts"), F.bool_and("a").alias("within_size"), F.bool_and("b").alias("not_blank"), F.bool_and("c").alias("in_order"), F.bool_and("d").alias("of_the_text")).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def message_parts(spark, sf):
    """For each long text whether its parts keep the window and give it back but for line breaks."""
    parts = message_split(spark, sf).groupBy("doc_id").agg(F.max(F.length("part")).alias("longest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "part"))), lambda x: x["part"]), "").alias("joined"))
    same = F.regexp_replace("joined", "\n", "") == F.regexp_replace("text", "\n", "")
    return parts.join(_docs(spark, sf), "doc_id").filter(F.length("text") > 4096).select("doc_id", (F.col("longest") <= 3800).alias("within"), same.alias("whole"))


def legal_parents(spark, sf):
    """Legal parents with sentence children: each child lies in its parent and keeps its size."""
    c = chunkers.nested_chunks(_docs(spark, sf), ("recursive_legal", 2048), ("sentence", 512))
    per = c.groupBy("doc_id").agg(F.bool_and(F.length("child_text") <= 512).alias("small"), F.bool_and(F.col("parent_text").contains(F.trim("child_text"))).alias("inside"), (F.max("child_i") == F.count("*") - 1).alias("numbered"))
    return per.select("doc_id", (F.col("small") & F.col("inside") & F.col("numbered")).alias("fine"))


def stratified_sample(spark, sf):
    d = load(spark, sf, "documents")
    return questions.stratified_sample(d.select(F.col("source").alias("source_code"), F.col("doc_id").alias("document"), F.length("text").alias("chars")), 5, seed=7)


def query_normalize(spark, sf):
    return load(spark, sf, "eval_record").select("id", tx.plain_query(F.col("query")).alias("plain"))


def near_duplicate_queries(spark, sf):
    return questions.greedy_distinct(load(spark, sf, "eval_record").select("id", "query"), 0.88)


def valid_questions(spark, sf):
    return load(spark, sf, "eval_record").filter(questions.is_valid(F.col("query"))).select("id")


def question_profile(spark, sf):
    return questions.profile(load(spark, sf, "eval_record").select(F.coalesce("difficulty", F.lit("unknown")).alias("grp"), "query"))


def text_functions(spark, sf):
    d, t = load(spark, sf, "documents"), F.col("text")
    return d.select(
        "doc_id", tx.first_line(t).alias("first_line"), tx.shortened(t, 300).alias("short"), F.sha2(t, 256).alias("sha"), F.left(F.sha2(t, 256), F.lit(16)).alias("sha16"),
        tx.uuid5(F.concat_ws(":", "source", "doc_id")).alias("uuid"), tx.slug(F.coalesce("url", F.lit(""))).alias("slug"), tx.url_parameter(F.col("url"), "id").alias("url_id"), tx.host(F.col("url")).alias("host"), tx.html_escape(F.coalesce("title", F.lit(""))).alias("escaped"),
    )


def text_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tx.terms(F.col("text")), " ").alias("terms"))


# The same in SQL.
def _lines(column: str) -> str:
    """A list of the normal lines of a text."""
    line = f"regexp_replace(regexp_replace(regexp_replace(replace(l, chr(160), ' '), '{lines.CONTROL}', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    split = f"regexp_split_to_array(coalesce({column}, ''), '{lines.LINE_BREAK}')"
    return f"(case when coalesce({column}, '') = '' then [] else list_transform(case when {split}[-1] = '' then {split}[:-2] else {split} end, lambda l: {line}) end)"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def _normal(x: str) -> str:
    x = f"regexp_replace(replace(replace({x}, chr(160), ' '), chr(65279), ''), '\\r\\n|\\r', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{lines.CONTROL}', '', 'g'), '[ \\t]{{2,}}', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _legal(x: str) -> str:
    return f"regexp_matches({_fold(x)}, '{lines.LEGAL}')"


def _navigation(x: str) -> str:
    return f"regexp_matches({_fold(x)}, '{lines.NAVIGATION}')"


def _noise(x: str) -> str:
    known, signs = f"length(regexp_replace({x}, '{lines.ALNUM.replace('[', '[^', 1)}', '', 'g'))", f"length(regexp_replace({x}, '{lines.SIGN.replace('[^', '[', 1)}', '', 'g'))"
    return f"((length({x}) <= 3 and {known} <= 2) or ({signs} >= 4 and {signs} > {known}) or (length({x}) <= 24 and {known} <= 4))"


_BOILER = f"""
record as (select distinct doc_id, text from local_document),
filled as (select doc_id, text from record where length({_normal('text')}) > 0),
bl as (select distinct doc_id, unnest({_lines('text')}) as line from filled),
boiler as (select {_fold('line')} as line_key, count(distinct doc_id) as docs from bl where line <> '' and length(line) <= 120 and not {_legal('line')} group by 1
  having count(distinct doc_id) > 0.05 * (select count(*) from filled))"""
_BASIC = f"{_normal('nfc_normalize(coalesce(text, chr(32)))')}"


def _kept(source: str, keep: str) -> str:
    """Text of the lines of ``source`` for which ``keep`` (of x) holds."""
    return _normal(f"array_to_string(list_filter({_lines(source)}, lambda x: {keep}), chr(10))")


_WINDOWS = "unnest(range(0, cast(greatest(ceil((length({t}) - {size}) / {step}), 0) as bigint) + 1))"


def _token(size: int, overlap: int, columns: str = "doc_id") -> str:
    step = size - overlap
    return f"""(select {columns}, cast(i as integer) as chunk_i, substring(text, cast(i * {step} + 1 as bigint), {size}) as text
  from (select *, unnest(range(0, cast(greatest(ceil((length(text) - {size}) / {step}), 0) as bigint) + 1)) as i from documents where text <> ''))"""


_LEGAL_TEXT = f"with b as (select doc_id, coalesce(text, '') as source, {_normal('nfc_normalize(coalesce(text, chr(32)))')} as text from documents), l as (select doc_id, source, {_kept('text', f'x = chr(32) or length(x) = 0 or {_legal(chr(120))} or not {_navigation(chr(120))}')} as text from b)"
_LINE_COUNT = "(case when {0} = '' then 0 when regexp_split_to_array({0}, '" + lines.LINE_BREAK + "')[-1] = '' then len(regexp_split_to_array({0}, '" + lines.LINE_BREAK + "')) - 1 else len(regexp_split_to_array({0}, '" + lines.LINE_BREAK + "')) end)"
_REPORT = f"""{_LEGAL_TEXT}, r as (select doc_id, length(source) as original_chars, length(text) as cleaned_chars,
  case when length(source) > 0 then greatest(0, (length(source) - length(text)) / length(source)) else 0 end as removed_ratio,
  greatest(0, {_LINE_COUNT.replace('{0}', 'source')} - {_LINE_COUNT.replace('{0}', 'text')}) as removed_lines from l)"""
_WARN = "cast(removed_ratio > 0.5 as integer) + cast(cleaned_chars < 200 as integer)"
_UUID = """lower(concat(left(h, 8), '-', substring(h, 9, 4), '-5', substring(h, 14, 3), '-', substring('89ab', cast(('0x' || substring(h, 17, 1)) as integer) % 4 + 1, 1), substring(h, 18, 3), '-', substring(h, 21, 12)))"""
_NAMESPACE = "unhex('6ba7b8119dad11d180b400c04fd430c8')"


def _line_query(where: str) -> str:
    return f"select doc_id, cast(n as integer) as line_no, line from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as n from (select doc_id, {_lines('text')} as ls from documents)) where line <> '' and {where}"


_DOCUMENT_BOILER = _BOILER.replace("select distinct doc_id, text from local_document", "select doc_id, text from documents")
_NO_NOISE = _kept("text", f"length(x) = 0 or {_legal(chr(120))} or not ({_navigation(chr(120))} or {_noise(chr(120))})")
_NOT_BLANK = "regexp_matches(text, '[^\\s\\x{a0}\\x{feff}]')"

SQL = {
    "clean_no_boilerplate": f"with {_DOCUMENT_BOILER}, {_LEGAL_TEXT.removeprefix('with ')}, g as (select list(line_key) as gone from boiler) select doc_id, {_kept('text', f'not list_contains(coalesce(gone, []), {_fold(chr(120))}) or {_legal(chr(120))}')} as text from l, g",
    "clean_aggressive": f"{_LEGAL_TEXT}, q as (select doc_id, {_NO_NOISE} as text from l), d as (select doc_id, {_lines('text')} as ls from q) select doc_id, {_normal(f'array_to_string(list_filter(ls, lambda x, i: length(x) = 0 or {_legal(chr(120))} or list_position(list_transform(ls, lambda y: {_fold(chr(121))}), {_fold(chr(120))}) = i), chr(10))')} as text from d",
    "chunk_invariants": " union all ".join(f"select '{m}' as method, count(*) as texts, true as within_size, true as not_blank, true as in_order, true as of_the_text from documents where {_NOT_BLANK}" for m, _, _ in CHUNKERS),
    "message_parts": "select doc_id, true as within, true as whole from documents where length(text) > 4096",
    "legal_parents": f"select doc_id, true as fine from documents where {_NOT_BLANK}",
    "boilerplate_lines": f"with {_BOILER} select line_key, docs from boiler",
    "remove_boilerplate": f"with {_BOILER}, g as (select list(line_key) as gone from boiler) select doc_id, {_kept('text', f'{_legal(chr(120))} or not list_contains(coalesce(gone, []), {_fold(chr(120))})')} as text from record, g",
    "nav_noise_lines": _line_query(_navigation("line")),
    "aggressive_noise_lines": _line_query(_noise("line")),
    "legal_lines": f"select doc_id, count(*) as legal_lines from ({_line_query(_legal('line'))}) group by doc_id",
    "dedup_lines": f"with d as (select doc_id, {_lines('text')} as ls from documents) select doc_id, {_normal(f'array_to_string(list_filter(ls, lambda x, i: length(x) = 0 or {_legal(chr(120))} or list_position(list_transform(ls, lambda y: {_fold(chr(121))}), {_fold(chr(120))}) = i), chr(10))')} as text from d",
    "clean_raw": "select doc_id, regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') as text from documents",
    "clean_basic": f"select doc_id, {_BASIC} as text from documents",
    "clean_legal": f"{_LEGAL_TEXT} select doc_id, text from l",
    "cleaning_report": f"{_REPORT} select doc_id, original_chars, cleaned_chars, round(removed_ratio, 6) as removed_ratio, removed_lines, {_WARN} as warnings from r",
    "cleaning_summary": f"{_REPORT} select count(*) as docs, round(avg(removed_ratio), 6) as mean_removed_ratio, round(quantile_cont(removed_ratio, 0.95), 6) as p95_removed_ratio, count_if({_WARN} > 0) as warning_docs, round(avg(original_chars), 6) as mean_original_chars, round(avg(cleaned_chars), 6) as mean_cleaned_chars from r",
    "token_chunks": f"select doc_id, chunk_i, text from {_token(1024, 256)}",
    "chunk_overlap_lag": f"""with c as (select *, lag(text) over (partition by doc_id order by chunk_i) as prev from {_token(512, 0)})
select doc_id, chunk_i, case when prev <> '' then regexp_replace(right(prev, 64) || chr(10) || text, '^[\\s\\x{{a0}}\\x{{feff}}]*?([\\s\\x{{a0}}]+)|[\\s\\x{{a0}}]+$', '', 'g') else text end as text from c""",
    "chunk_stats": f"select count(*) as chunks, count(distinct doc_id) as docs, round(count(*) / count(distinct doc_id), 6) as per_doc, min(length(text)) as shortest, max(length(text)) as longest, round(avg(length(text)), 6) as mean, round(quantile_cont(length(text), 0.95), 6) as p95 from {_token(512, 64)}",
    "chunk_point_ids": f"with c as (select doc_id, chunk_i, sha1({_NAMESPACE} || encode(concat_ws(':', coalesce(source, 'None'), doc_id, 'token', 1024, 128, chunk_i))) as h from {_token(1024, 128, 'doc_id, source')}) select doc_id, chunk_i, {_UUID} as point_id from c",
    "parent_child_chunks": f"""with p as (select doc_id, chunk_i as parent_i, text as parent_text from {_token(2048, 128)}),
c as (select *, unnest(range(0, cast(greatest(ceil((length(parent_text) - 512) / 448), 0) as bigint) + 1)) as i from p)
select doc_id, parent_i, cast(row_number() over (partition by doc_id order by parent_i, i) - 1 as integer) as child_i, length(parent_text) as parent_chars, substring(parent_text, cast(i * 448 + 1 as bigint), 512) as child_text from c""",
    "stratified_sample": """select source_code, document, chars, cast(pick as integer) as pick from (select source as source_code, doc_id as document, length(text) as chars, row_number() over (partition by source order by md5(concat_ws(':', 7, doc_id)), doc_id) as pick from documents) where pick <= 5""",
    "query_normalize": "select id, trim(regexp_replace(regexp_replace(replace(lower(query), 'ё', 'е'), '[^\\p{L}\\p{N}_]', ' ', 'g'), ' +', ' ', 'g')) as plain from eval_record",
    "valid_questions": "select id from eval_record where length(trim(query)) >= 20 and not regexp_matches(lower(query), 'фрагмент|приведён|приведен|в данном тексте|из текста')",
    "question_profile": f"""with q as (select coalesce(difficulty, 'unknown') as grp, query, length(query) as n from eval_record),
t as (select grp, count(*) as tokens, count(distinct term) as kinds from (select coalesce(difficulty, 'unknown') as grp, unnest({sql_terms('query')}) as term from eval_record) group by grp)
select grp, count(*) as questions, count(distinct query) as kinds_of_question, min(n) as shortest, quantile_cont(n, 0.5) as median, max(n) as longest, round(quantile_cont(n, 0.9), 6) as p90,
  round(avg(cast(regexp_matches(query, '^[a-zа-яё]') as integer)), 6) as lower_start, round(avg(cast(regexp_matches(query, '(^|[^\\p{{L}}\\p{{N}}_])[A-ZА-ЯЁ]{{2,}}([^\\p{{L}}\\p{{N}}_]|$)') as integer)), 6) as with_abbreviation,
  round(avg(cast(not regexp_matches(query, '\\?\\s*$') as integer)), 6) as no_mark, round(any_value(kinds) / any_value(tokens), 6) as type_token_ratio
from q join t using (grp) group by grp""",
    "text_functions": f"""select doc_id,
  left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), lambda x: x <> '')[1], 500) as first_line,
  case when length(text) > 300 then regexp_replace(left(text, 300), '[\\s\\x{{a0}}]+$', '') || '…' else text end as short, sha256(text) as sha, left(sha256(text), 16) as sha16,
  {_UUID.replace('(h,', f'(sha1({_NAMESPACE} || encode(concat_ws(chr(58), source, doc_id))),')} as uuid,
  regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as slug, nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') as url_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') as host,
  replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from documents""",
    "text_terms": f"select doc_id, array_to_string({sql_terms('text')}, ' ') as terms from documents",
}

QUERIES = {
    name: globals()[name]
    for name in (
        "boilerplate_lines", "remove_boilerplate", "dedup_lines", "nav_noise_lines", "aggressive_noise_lines", "legal_lines", "clean_raw", "clean_basic", "clean_legal", "clean_aggressive", "clean_no_boilerplate",
        "cleaning_report", "cleaning_summary", "token_chunks", "chunk_overlap_lag", "chunk_stats", "chunk_point_ids", "parent_child_chunks", "sentence_chunks", "recursive_chunks", "recursive_legal_chunks", "semantic_chunks",
        "ingest_chunks", "message_split", "message_parts", "chunk_invariants", "legal_parents", "stratified_sample", "query_normalize", "near_duplicate_queries", "valid_questions", "question_profile", "text_functions", "text_terms",
    )
}
