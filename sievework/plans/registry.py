"""Queries on the registry, the fetch log, experiment logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import backoff_days, day8
from sievework.operators import experiments, extract, models, registry
from sievework.sources import load
from sievework.streaming import events as streams

NOW = "2025-03-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _micros(name):
    """A moment as microseconds, which every engine writes alike."""
    return F.unix_micros(name).alias(name)


def source_catalogue(spark, sf):
    s = load(spark, sf, "rag_source")
    return s.filter("active").select("code", "base_url", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("handler", F.lit("")).alias("handler"), F.coalesce("crawl_freq_days", F.lit(7)).alias("freq"))


def _log(spark, sf) -> DataFrame:
    return load(spark, sf, "rag_fetch_log")


def fetch_status_counts(spark, sf):
    method = F.upper(F.coalesce("method", F.lit("unknown")))
    return _log(spark, sf).groupBy(method.alias("method"), "status_code").agg(F.count("*").alias("fetches"), F.count_distinct("doc_id").alias("docs"))


def fetch_once(spark, sf):
    """Fetches of each document without double writes: the same content under a later id."""
    rows = registry.once(_log(spark, sf), ["doc_id", "url", "fetched_at", "status_code", "body_sha256"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("fetches"))


def fetch_latency(spark, sf):
    return _log(spark, sf).filter("elapsed_ms is not null").groupBy("status_code").agg(F.count("*").alias("n"), F.round(F.percentile("elapsed_ms", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("elapsed_ms", F.lit(0.95)), 6).alias("p95"))


def _fetched(spark, sf):
    """The latest fetch of each document that gave an answer."""
    rows = _log(spark, sf).filter("doc_id is not null and status_code in (200, 304)")
    return registry.latest_values(rows, ["doc_id"], ["fetched_at", "id"], ["status_code", "body_sha256", "resp_etag", "resp_last_mod"])


def registry_change_detect(spark, sf):
    r = load(spark, sf, "rag_doc")
    f = _fetched(spark, sf).join(r.select(F.col("id").alias("doc_id"), "source_code", "external_id"), "doc_id")
    got = f.select("doc_id", "source_code", "external_id", F.col("body_sha256").alias("sha"), (F.col("status_code") == 304).alias("not_modified"))
    return registry.change_status(got, r.filter("external_id is not null")).select("doc_id", "status")


def registry_merge(spark, sf):
    r = load(spark, sf, "rag_doc")
    freq = load(spark, sf, "rag_source").select(F.col("code").alias("source_code"), F.col("crawl_freq_days").alias("freq"))
    status = registry_change_detect(spark, sf)
    changes = _fetched(spark, sf).join(status, "doc_id").join(r.select(F.col("id").alias("doc_id"), "source_code"), "doc_id").join(F.broadcast(freq), "source_code", "left")
    c = changes.select(F.col("doc_id").alias("id"), F.col("body_sha256").alias("sha"), F.col("resp_etag").alias("etag"), F.col("resp_last_mod").alias("last_mod"), "freq", "status")
    return registry.merged_content(r, c, _now()).select("id", "content_sha256", "qdrant_revision", _micros("indexed_at"), "http_etag", _micros("next_check_at"), "error_count", "last_error")


def registry_due(spark, sf):
    return registry.due(load(spark, sf, "rag_doc"), _now()).select("id", _micros("next_check_at"))


def registry_errors(spark, sf):
    """Registry rows of documents with a failed fetch, marked with the latest message."""
    r = load(spark, sf, "rag_doc")
    last = registry.latest_values(_log(spark, sf).filter("doc_id is not null and error is not null"), ["doc_id"], ["fetched_at", "id"], ["error"])
    bad = last.select(F.col("doc_id").alias("id"), F.col("error").alias("message"), F.lit(7).alias("freq"))
    return registry.marked_errors(r, bad, _now()).join(bad.select("id"), "id", "left_semi").select("id", "error_count", "last_error", _micros("next_check_at"))


def error_backoff(spark, sf):
    return spark.range(0, 12).select(F.col("id").cast("int").alias("errors"), backoff_days(F.lit(7), F.col("id").cast("int")).alias("days"))


def registry_insert(spark, sf):
    """Loaded records that the registry lacks by their natural key, added once."""
    r = load(spark, sf, "rag_doc").select("source_code", "external_id", "canonical_url")
    fresh = load(spark, sf, "documents").select(F.col("source").alias("source_code"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("external_id"), F.col("url").alias("canonical_url")).filter("source_code is not null")
    return registry.insert_missing(r, fresh, ["source_code", "external_id"]).groupBy("source_code").agg(F.count("*").alias("docs"))


def points_upsert(spark, sf):
    """Vectors with the later half of the labels written again under the same ids."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    again = e.filter("label >= 5").select("point_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("seq")).unionByName(e.filter("label >= 8").select("point_id", (F.col("label") + 200).alias("label"), F.lit(2).alias("seq")))
    return registry.upserted(e, again)


def points_delete(spark, sf):
    d = load(spark, sf, "local_document").select("source_code", "external_id", "doc_id").distinct()
    gone = load(spark, sf, "rag_doc").filter("lower(status) <> 'active'").select("source_code", "external_id").filter("external_id is not null")
    return registry.without_documents(d, gone).groupBy("source_code").agg(F.count("*").alias("docs"))


def document_dates(spark, sf):
    return load(spark, sf, "local_document").select("doc_id", "document_date").distinct().select("doc_id", day8(F.regexp_replace("document_date", r"[^0-9]", "")).alias("day"))


CALENDAR = """<calendar><title>Календарь</title><year index="2025"><month name="Март"><day num="3" type="work">Срок уплаты</day><day num="1" type="rest"/><day type="work">x</day></month>
<month name="мартобрь"><day num="5" type="work">никогда</day></month><month name="январь"><day num="9" type="work">Отчет &amp; взнос</day></month></year></calendar>"""


def _calendar(spark):
    return spark.createDataFrame([(CALENDAR,)], "xml string")


def calendar_days(spark, sf):
    return extract.calendar_days(_calendar(spark)).select("title", "day", "kind", "text")


def calendar_text(spark, sf):
    return extract.calendar_text(extract.calendar_days(_calendar(spark)))


LINKS = ("https://x.example/data-20240105-structure-1.xml", "https://x.example/data-05022025-structure-1.xml", "https://x.example/data-20241301-structure-1.xml", "https://x.example/other.xml")


def latest_dataset(spark, sf):
    return extract.latest_dataset(spark.createDataFrame([(x,) for x in LINKS], "url string"))


def hashed_embedding(spark, sf):
    return models.hashed_terms(load(spark, sf, "eval_record"), "id", "query")


def _runs(spark, sf):
    """Every judged record as a run of its method on its dataset."""
    r = load(spark, sf, "generation_record").select("id", "dataset", "method", "judge", "generation_metadata").distinct()
    return r.select("id", "dataset", "method", F.col("generation_metadata.created_at").alias("made"), F.col("judge.precision.score").cast("double").alias("p"), F.col("judge.format.score").cast("double").alias("f")).withColumn("status", F.when(F.col("p").isNotNull(), "ok").otherwise("failed")).withColumn("position", F.struct(F.coalesce("made", F.lit(0).cast("timestamp")), "id"))


def experiment_latest(spark, sf):
    return experiments.latest_runs(_runs(spark, sf), ["dataset", "method"]).select("dataset", "method", "id", "p")


def experiment_remaining(spark, sf):
    r = _runs(spark, sf)
    return experiments.remaining(r.select("dataset", "method", "id").distinct(), r, ["id"]).groupBy("dataset").agg(F.count("*").alias("open"))


def experiment_top3(spark, sf):
    means = _runs(spark, sf).filter("status = 'ok'").groupBy("dataset", "method").agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.avg("f"), 6).alias("f"))
    return experiments.top_variants(means, "method", ["p", "f"])


def experiment_tail(spark, sf):
    return experiments.tail(_runs(spark, sf), 50).select("id", "status")


def experiment_markdown(spark, sf):
    t = _runs(spark, sf).filter("status = 'ok'").groupBy("dataset", "method").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    return experiments.markdown_rows(t).select("dataset", "method", "line")


def stream_event_windows(spark, sf):
    table = streams.run_to_end(streams.event_windows(streams.table_stream(spark, sf, "events"), "ts", "event_type"), "event-windows")
    return table.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def stream_registry(spark, sf):
    """The registry after the fetch log has passed through as a stream."""
    r = load(spark, sf, "rag_doc")
    points = lambda changed: changed.select(F.concat_ws(":", "doc_id", "sha").alias("point_id"), "doc_id")
    refresh = streams.RegistryRefresh(spark, r, points, "point_id string, doc_id bigint", _now())
    refresh.run(streams.table_stream(spark, sf, "rag_fetch_log")).awaitTermination()
    made = refresh.points.read().select(F.col("doc_id").alias("id"), "point_id")
    return refresh.rows.read().join(made, "id", "left").select("id", "content_sha256", "qdrant_revision", "error_count", "point_id")


def stream_document_state(spark, sf):
    """Last hash, changes and failures in a row of each document, by keyed state."""
    stream = streams.document_state(streams.table_stream(spark, sf, "rag_fetch_log"))
    return streams.run_to_end(stream, "document-state", "update")


def stream_refresh(spark, sf):
    refresh = streams.Refresh(spark)
    refresh.run(streams.table_stream(spark, sf, "rag_fetch_log")).awaitTermination()
    return refresh.state().select("doc_id", "body_sha256")


_FETCHED = """f as (select * from rag_fetch_log where doc_id is not null and status_code in (200, 304) qualify row_number() over (partition by doc_id order by fetched_at desc nulls last, id desc) = 1)"""
_STATUS = """st as (select f.doc_id, case when f.status_code = 304 then 'SKIP_NOT_MODIFIED' when d.external_id is null then 'INGESTED' when d.content_sha256 = f.body_sha256 then 'SKIP_UNCHANGED' else 'UPDATED' end as status from f join rag_doc d on d.id = f.doc_id)"""
_RUNS = "runs as (select distinct id, dataset, method, generation_metadata.created_at as made, cast(judge.\"precision\".score as double) as p, cast(judge.format.score as double) as f, case when judge.\"precision\".score is not null then 'ok' else 'failed' end as status from generation_record)"

SQL = {
    "source_catalogue": "select code, base_url, coalesce(kind, 'unknown') as kind, coalesce(handler, '') as handler, coalesce(crawl_freq_days, 7) as freq from rag_source where active",
    "fetch_status_counts": "select upper(coalesce(method, 'unknown')) as method, status_code, count(*) as fetches, count(distinct doc_id) as docs from rag_fetch_log group by 1, 2",
    "fetch_once": "select doc_id, count(*) as fetches from (select distinct doc_id, url, fetched_at, status_code, body_sha256 from rag_fetch_log) group by doc_id",
    "fetch_latency": "select status_code, count(*) as n, round(quantile_cont(elapsed_ms, 0.5), 6) as p50, round(quantile_cont(elapsed_ms, 0.95), 6) as p95 from rag_fetch_log where elapsed_ms is not null group by status_code",
    "registry_change_detect": f"with {_FETCHED}, {_STATUS} select doc_id, status from st",
    "registry_merge": f"""with {_FETCHED}, {_STATUS}, c as (select f.doc_id, f.body_sha256, f.resp_etag, st.status, coalesce(s.crawl_freq_days, 7) as freq, st.status in ('INGESTED', 'UPDATED') as changed
 from f join st on st.doc_id = f.doc_id join rag_doc d on d.id = f.doc_id left join rag_source s on s.code = d.source_code)
select d.id, case when c.changed then c.body_sha256 else d.content_sha256 end as content_sha256, case when c.changed then coalesce(d.qdrant_revision, 0) + 1 else d.qdrant_revision end as qdrant_revision,
 epoch_us(case when c.changed then null else d.indexed_at end) as indexed_at, case when c.doc_id is not null then coalesce(c.resp_etag, d.http_etag) else d.http_etag end as http_etag,
 epoch_us(case when c.doc_id is not null then timestamptz '{NOW}+00' + to_days(c.freq) else d.next_check_at end) as next_check_at, case when c.doc_id is not null then 0 else d.error_count end as error_count, case when c.doc_id is not null then null else d.last_error end as last_error
from rag_doc d left join c on c.doc_id = d.id""",
    "registry_due": f"select id, epoch_us(next_check_at) as next_check_at from rag_doc where lower(status) = 'active' and (next_check_at is null or next_check_at <= timestamptz '{NOW}+00')",
    "registry_errors": f"""with l as (select doc_id, error from rag_fetch_log where doc_id is not null and error is not null qualify row_number() over (partition by doc_id order by fetched_at desc nulls last, id desc) = 1)
select d.id, coalesce(d.error_count, 0) + 1 as error_count, left(l.error, 500) as last_error, epoch_us(timestamptz '{NOW}+00' + to_days(cast(least(7, power(2, coalesce(d.error_count, 0) + 1)) as integer))) as next_check_at from rag_doc d join l on l.doc_id = d.id""",
    "error_backoff": "select cast(i as integer) as errors, cast(least(7, power(2, i)) as integer) as days from range(12) t(i)",
    "registry_insert": """with fresh as (select distinct source as source_code, 'doc-' || doc_id as external_id from documents where source is not null), added as (select * from fresh f where not exists (select 1 from rag_doc d where d.source_code = f.source_code and d.external_id = f.external_id))
select source_code, count(*) as docs from (select source_code from rag_doc union all select source_code from added) group by source_code""",
    "points_upsert": "select vec_id as point_id, case when label >= 8 then label + 200 when label >= 5 then label + 100 else label end as label from embeddings",
    "points_delete": "select source_code, count(*) as docs from (select distinct source_code, external_id, doc_id from local_document) d where not exists (select 1 from rag_doc r where lower(r.status) <> 'active' and r.source_code = d.source_code and r.external_id = d.external_id) group by source_code",
    "document_dates": """with d as (select distinct doc_id, document_date, regexp_replace(document_date, '[^0-9]', '', 'g') as x from local_document)
select doc_id, cast(case when regexp_matches(x, '^\\d{8}$') then case when cast(left(x, 4) as integer) between 2000 and 2099 then try_strptime(x, '%Y%m%d') else try_strptime(x, '%d%m%Y') end end as date) as day from d""",
    "calendar_days": "select * from (values ('Календарь', date '2025-03-03', 'work', 'Срок уплаты'), ('Календарь', date '2025-03-01', 'rest', ''), ('Календарь', date '2025-01-09', 'work', 'Отчет & взнос')) t(title, day, kind, text)",
    "calendar_text": "select 'Календарь' as title, '2025-01-09 [work] Отчет & взнос' || chr(10) || '2025-03-03 [work] Срок уплаты' as text",
    "latest_dataset": "select 'https://x.example/data-05022025-structure-1.xml' as url",
    "hashed_embedding": """with t as (select id, unnest(list_transform(regexp_extract_all(coalesce(query, ''), '[0-9A-Za-zА-Яа-яЁё]{3,}'), lambda x: replace(lower(x), 'ё', 'е'))) as term from eval_record),
s as (select id, cast(('0x' || left(md5(term), 8)) as bigint) % 64 as bucket, sum(case when cast(('0x' || substring(md5(term), 9, 1)) as integer) % 2 = 0 then 1.0 else -1.0 end) as value from t group by all having value <> 0)
select id, bucket, round(cast(value as double) / sqrt(sum(cast(value as double) * cast(value as double)) over (partition by id)), 6) as value from s""",
    "experiment_latest": f"with {_RUNS} select dataset, method, id, p from runs where status = 'ok' qualify row_number() over (partition by dataset, method order by coalesce(made, timestamptz '1970-01-01 00:00:00+00') desc, id desc) = 1",
    "experiment_remaining": f"with {_RUNS} select dataset, count(*) as open from runs where status <> 'ok' group by dataset",
    "experiment_top3": f"with {_RUNS}, m as (select dataset, method, round(avg(p), 6) as p, round(avg(f), 6) as f from runs where status = 'ok' group by dataset, method), b as (select method, p, f from m qualify row_number() over (partition by method order by p desc, f desc) = 1) select method, p, f from b order by p desc, f desc, method limit 3",
    "experiment_tail": f"with {_RUNS} select id, status from runs order by coalesce(made, timestamptz '1970-01-01 00:00:00+00') desc, id desc limit 50",
    "experiment_markdown": f"with {_RUNS} select dataset, method, concat('| ', dataset, ' | ', method, ' | ', format('{{:.4f}}', avg(p)), ' | ', count(*), ' |') as line from runs where status = 'ok' group by dataset, method",
    "stream_event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2",
    "stream_registry": f"""with {_FETCHED}, {_STATUS}, c as (select f.doc_id, f.body_sha256, st.status in ('INGESTED', 'UPDATED') as changed from f join st on st.doc_id = f.doc_id)
select d.id, case when c.changed then c.body_sha256 else d.content_sha256 end as content_sha256, case when c.changed then coalesce(d.qdrant_revision, 0) + 1 else d.qdrant_revision end as qdrant_revision,
 case when c.doc_id is not null then 0 else d.error_count end as error_count, case when c.changed then concat_ws(':', c.doc_id, c.body_sha256) end as point_id from rag_doc d left join c on c.doc_id = d.id""",
    "stream_document_state": """with f as (select *, coalesce(status_code in (200, 304), false) as ok, status_code = 200 and body_sha256 is not null as whole from rag_fetch_log where doc_id is not null),
h as (select doc_id, body_sha256, lag(body_sha256) over (partition by doc_id order by fetched_at, id) as before, row_number() over (partition by doc_id order by fetched_at desc, id desc) as back from f where whole),
r as (select doc_id, count_if(before is distinct from body_sha256) as revisions, max(case when back = 1 then body_sha256 end) as body_sha256 from h group by doc_id),
l as (select doc_id, max(case when ok then (fetched_at, id) end) as last from f group by doc_id)
select l.doc_id, r.body_sha256, coalesce(r.revisions, 0) as revisions, count_if(not f.ok and (l.last is null or (f.fetched_at, f.id) > l.last)) as errors from l join f using (doc_id) left join r using (doc_id) group by all""",
    "stream_refresh": "select doc_id, body_sha256 from rag_fetch_log where doc_id is not null and body_sha256 is not null qualify row_number() over (partition by doc_id order by fetched_at desc, id desc) = 1",
}

QUERIES = {name: globals()[name] for name in SQL}
