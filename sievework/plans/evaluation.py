"""Queries on evaluation and generation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import citations
from sievework.operators import evaluate, judging
from sievework.sources import load

KS = (1, 3, 5, 10)


def _records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Generation records, each once."""
    return load(spark, sf, "generation_record").select("id", *columns).distinct()


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf, "method", "dataset", "retrieved").select("id", "method", "dataset", F.explode("retrieved").alias("r")).select("id", "method", "dataset", "r.*")
    return r.withColumn("relevant", F.col("is_gold_relevant")).withColumn("hard_negative", F.col("relevance_label") == "hard_negative")


def _metrics(spark, sf):
    return evaluate.metrics_at_k(_ranked(spark, sf), KS, ("id", "method", "dataset"))


def eval_metrics_at_k(spark, sf):
    six = [F.round(c, 6).alias(c) for c in ("precision", "hit", "mrr", "ndcg")]
    return _metrics(spark, sf).select("id", "k", *six, "hard_negatives", "first_hard_negative")


def eval_by_method(spark, sf):
    return evaluate.rollup(_metrics(spark, sf), "method", "dataset")


def eval_overall(spark, sf):
    return evaluate.rollup(_metrics(spark, sf))


def eval_per_source(spark, sf):
    """Metrics by the source of the best retrieved item; a missing one is ``unknown``."""
    best = _ranked(spark, sf).filter("rank = 1").select("id", F.coalesce(F.nullif("source_code", F.lit("")), F.lit("unknown")).alias("source"))
    return evaluate.rollup(_metrics(spark, sf).join(best, "id", "left").withColumn("source", F.coalesce("source", F.lit("unknown"))), "source")


def eval_hard_negatives(spark, sf):
    has = _records(spark, sf, "retrieval_gold_summary").select("id", (F.col("retrieval_gold_summary.hard_negative_retrieved_count") > 0).alias("has"))
    return evaluate.hard_negative_rates(_metrics(spark, sf).join(has, "id"), F.col("has"), "method")


def eval_latency_percentiles(spark, sf):
    return evaluate.latency_percentiles(load(spark, sf, "events"), "value", "event_type")


def judge_latency(spark, sf):
    j = _records(spark, sf, "method", "judge")
    rows = j.select("method", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"judge.{m}.latency_ms").alias("ms")) for m in judging.METRICS))).alias("x")).select("method", "x.*")
    return evaluate.latency_percentiles(rows.filter("ms is not null"), "ms", "method", "metric")


def eval_rollup(spark, sf):
    """By method in one row: retrieval at 5, hard negatives, citations, and the judge's latency."""
    m = _metrics(spark, sf).filter("k = 5")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    found = m.groupBy("method").agg(F.count("*").alias("queries"), *(mean(c) for c in ("precision", "hit", "mrr", "ndcg")), F.round(F.avg("any_hard_negative"), 6).alias("hard_negative_rate"), F.round(F.avg("hard_negatives"), 6).alias("hard_negatives"))
    a, n = F.col("answer"), F.size(F.coalesce("retrieved", F.array()))
    cited = _records(spark, sf, "method", "answer", "retrieved").select("method", citations.present(a).alias("presence"), citations.valid_share(a, n).alias("validity"), citations.density(a).alias("density"))
    marks = cited.groupBy("method").agg(*(mean(c) for c in ("presence", "validity", "density")))
    j = _records(spark, sf, "method", "judge").select("method", F.col("judge.precision.latency_ms").alias("ms"))
    slow = evaluate.latency_percentiles(j.filter("ms is not null"), "ms", "method").select("method", F.col("mean").alias("latency_mean"), F.col("p50").alias("latency_p50"), F.col("p95").alias("latency_p95"))
    return found.join(marks, "method", "left").join(slow, "method", "left")


def retrieved_sample(spark, sf):
    """Of each method the first 200 retrieved items by question and rank: lengths and parents."""
    order = Window.partitionBy("method").orderBy("id", "rank")
    first = _ranked(spark, sf).withColumn("n", F.row_number().over(order)).filter("n <= 200").withColumn("parent", F.nullif("parent_id", F.lit("")))
    kinds, all_ = F.count_distinct("parent"), F.count("parent")
    return first.groupBy("method").agg(F.count("*").alias("items"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), kinds.alias("parents"), F.round(F.when(all_ > 0, 1 - kinds / all_).otherwise(0.0), 6).alias("duplicate_parent_rate"))


def _matched(mode):
    def query(spark, sf):
        e = load(spark, sf, "eval_record")
        plain = lambda c: F.struct(*(c[k].alias(k) for k in ("source_code", "external_id", "chunk_i", "point_id", "text")))
        found = F.concat(F.transform(F.coalesce("relevant", F.array()), plain), F.transform(F.coalesce("hard_negatives", F.array()), plain))
        rows = e.select("id", F.array("source_chunk").alias("targets"), F.posexplode(found).alias("position", "c"))
        return rows.select("id", "position", evaluate.any_match(F.col("targets"), F.col("c"), mode).alias("matched"))

    return query


match_strict, match_doc, match_doc_overlap, match_hybrid = map(_matched, evaluate.MATCH_MODES)


def _contexts(order):
    def query(spark, sf):
        return evaluate.context(_ranked(spark, sf).withColumnRenamed("id", "query_id"), order)

    return query


context_budget, context_thirds = _contexts("rerank_123"), _contexts("rerank_132")


def label_retrieved(spark, sf):
    """Label of every candidate of an evaluation record against its own targets."""
    e = load(spark, sf, "eval_record")
    plain = lambda c: F.struct(*(c[k].alias(k) for k in ("source_code", "external_id", "chunk_i")))
    gold, hard = F.transform(F.coalesce("relevant", F.array()), plain), F.transform(F.coalesce("hard_negatives", F.array()), plain)
    rows = e.select("id", gold.alias("gold"), hard.alias("hard"), F.posexplode(F.concat(gold, hard)).alias("position", "c"))
    levels = rows.withColumn("g", judging.match_level(F.col("c"), F.col("gold"))).withColumn("h", judging.match_level(F.col("c"), F.col("hard")))
    return levels.select("id", (F.col("position") + 1).alias("rank"), "g", "h", judging.label(F.col("g"), F.col("h")).alias("label"))


def eval_gold_summary(spark, sf):
    s = judging.gold_summary(label_retrieved(spark, sf), "id")
    return s.withColumn("gold_ranks", F.array_join(F.transform("gold_ranks", lambda x: x.cast("string")), ","))


def retrieval_gold_summary(spark, sf):
    rows = _ranked(spark, sf).withColumn("label", F.col("relevance_label"))
    s = judging.gold_summary(rows, "id")
    return s.withColumn("gold_ranks", F.array_join(F.transform("gold_ranks", lambda x: x.cast("string")), ","))


def _candidates(spark, sf):
    e = load(spark, sf, "eval_record")
    plain = lambda c: F.struct(*(c[k].alias(k) for k in ("source_code", "external_id", "chunk_i", "point_id", "score")))
    found = F.concat(F.transform(F.coalesce("relevant", F.array()), plain), F.transform(F.coalesce("hard_negatives", F.array()), plain))
    rows = e.select(F.col("id").alias("query_id"), F.col("source_chunk").alias("s"), F.posexplode(found).alias("position", "c"))
    same = lambda *ks: [F.coalesce(F.col(f"s.{k}") == F.col(f"c.{k}"), F.lit(False)) for k in ks]
    a, b, c = same("source_code", "external_id", "chunk_i")
    return rows.select("query_id", "position", "c.point_id", "c.score", (a & b & c).alias("is_source"), a.alias("same_source"))


def fallback_labels(spark, sf):
    return judging.fallback_labels(_candidates(spark, sf)).select("query_id", "position", "point_id", "label")


def eval_record_caps(spark, sf):
    """At most five relevant items and five hard negatives of each record, best first."""
    rows = judging.fallback_labels(_candidates(spark, sf)).filter("label <> 'irrelevant'")
    order = Window.partitionBy("query_id", "label").orderBy(F.col("score").desc_nulls_last(), "position")
    best = rows.withColumn("place", F.row_number().over(order)).filter("place <= 5")
    return best.groupBy("query_id", "label").agg(F.count("*").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "point_id"))), lambda x: x["point_id"]), ",").alias("point_ids"))


def _pairs(spark, sf):
    r = _records(spark, sf, "method", "human", "judge")
    return r.select("id", "method", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"human.{m}").alias("human"), F.col(f"judge.{m}.score").alias("judge")) for m in judging.METRICS))).alias("x")).select("id", "method", "x.*")


def judge_agreement(spark, sf):
    return judging.agreement(_pairs(spark, sf), "metric")


def judge_agreement_by_method(spark, sf):
    return judging.agreement(_pairs(spark, sf), "method", "metric")


def judge_macro(spark, sf):
    return judging.macro(judge_agreement(spark, sf))


def judge_averages(spark, sf):
    valid = judging.valid_score
    return _pairs(spark, sf).groupBy("metric").agg(F.count("*").alias("records"), F.count(valid(F.col("human"))).alias("human_labelled"), F.round(F.avg(valid(F.col("human"))), 6).alias("human_mean"), F.count(valid(F.col("judge"))).alias("judged"), F.round(F.avg(valid(F.col("judge"))), 6).alias("judge_mean"))


def judge_rates(spark, sf):
    """Quality of the retrieved context over records; what is null is skipped."""
    s = _records(spark, sf, "method", "retrieval_gold_summary", "judge").select("method", "retrieval_gold_summary.*", F.col("judge.precision.status").alias("status"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.groupBy("method").agg(share(F.col("has_gold_relevant_context")).alias("with_gold"), F.round(F.avg("gold_relevant_retrieved_count"), 6).alias("gold"), F.round(F.avg("hard_negative_retrieved_count"), 6).alias("hard"), F.round(F.avg("unknown_retrieved_count"), 6).alias("unknown"), share(F.col("status") == "ok").alias("judged_ok"))


def human_judge_merge(spark, sf):
    """Human scores laid over judged records; an id that comes twice is an error."""
    r = _records(spark, sf, "human", "judge")
    judged, human = r.select("id", F.col("judge.precision.score").alias("judge_score")), r.select("id", F.col("human.precision").alias("human_score"))
    twice = human.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("twice"))
    checked = human.crossJoin(F.broadcast(twice)).select("id", "human_score", F.expr("assert_true(twice = 0, 'duplicate id')").alias("_ok"))
    return judged.join(checked, "id", "left").select("id", "judge_score", F.nullif("human_score", F.lit(-1)).alias("human_score"))


def citation_metrics(spark, sf):
    a, n = F.col("answer"), F.size(F.coalesce("retrieved", F.array()))
    return _records(spark, sf, "answer", "retrieved").select("id", citations.present(a).alias("presence"), F.round(citations.valid_share(a, n), 6).alias("validity"), F.round(citations.density(a), 6).alias("density"))


def citation_renumber(spark, sf):
    r = _records(spark, sf, "answer", "retrieved").filter("answer is not null").withColumn("n", F.size(F.coalesce("retrieved", F.array())))
    return r.select("id", F.array_join(F.transform(citations.used(F.col("answer"), F.col("n")), lambda x: x.cast("string")), ",").alias("order"), citations.renumbered(F.col("answer"), F.col("n")).alias("answer"))


def source_catalogue_maps(spark, sf):
    """One row (bases): the address of each source; the catalogue has a row for each."""
    return load(spark, sf, "rag_source").filter("code is not null and base_url is not null").agg(F.map_from_entries(F.collect_list(F.struct("code", "base_url"))).alias("bases"))


#: Sources whose titles name the document.
TITLED = ("work_calendar", "fed_orders")


def source_lines(spark, sf):
    """Sources an answer cites, numbered anew, as lines and as links."""
    r = _records(spark, sf, "answer", "retrieved").withColumn("n", F.size(F.coalesce("retrieved", F.array())))
    cited = r.select("id", "retrieved", F.posexplode(citations.used(F.col("answer"), F.col("n"))).alias("place", "number")).crossJoin(F.broadcast(source_catalogue_maps(spark, sf)))
    s, number = F.element_at("retrieved", F.col("number")), F.col("place") + 1
    name, url = citations.source_name(s, None, TITLED), citations.source_url(s, F.col("bases"))
    return cited.select("id", number.alias("number"), citations.source_line(number, name, url).alias("line"), citations.source_line(number, name, url, html=True).alias("link"))


def history_window(spark, sf):
    """The last four messages before each question of a session (dataset and method)."""
    r = _records(spark, sf, "dataset", "method", "query", "answer", "generation_metadata").withColumn("at", F.col("generation_metadata.created_at"))
    order = Window.partitionBy("dataset", "method").orderBy("at", "id")
    turns = F.collect_list(F.struct("query", "answer")).over(order.rowsBetween(-2, -1))
    lines = F.flatten(F.transform(turns, lambda t: F.array(F.concat(F.lit("user: "), F.coalesce(t["query"], F.lit(""))), F.concat(F.lit("assistant: "), F.coalesce(t["answer"], F.lit(""))))))
    return r.select("id", F.row_number().over(order).alias("turn"), F.array_join(lines, "\n").alias("history"))


def agent_global_numbering(spark, sf):
    """Chunks of all searches of a session, each once, numbered by first sight, up to 24."""
    steps = _ranked(spark, sf).withColumn("item", F.concat_ws(":", "source_code", "external_id", "chunk_i"))
    first = steps.groupBy("dataset", "method", "item").agg(F.min(F.struct("id", "rank")).alias("first"))
    order = Window.partitionBy("dataset", "method").orderBy("first.id", "first.rank", "item")
    return first.withColumn("number", F.row_number().over(order)).filter("number <= 24").select("dataset", "method", "number", "item")


def agent_union_hit(spark, sf):
    """Whether any search of a question finds gold, against its first item alone."""
    r = _ranked(spark, sf)
    per = r.groupBy("dataset", "id").agg(F.max(F.coalesce("relevant", F.lit(False))).alias("any_hit"), F.max(F.coalesce("relevant", F.lit(False)) & (F.col("rank") == 1)).alias("first_hit"), F.count("*").alias("chunks"))
    return per.groupBy("dataset").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("any_hit").cast("int")), 6).alias("union_hit"), F.round(F.avg(F.col("first_hit").cast("int")), 6).alias("single_hit"), F.round(F.avg("chunks"), 6).alias("mean_chunks"), F.count_if(F.col("any_hit") & ~F.col("first_hit")).alias("only_union"))


def retrieved_lengths(spark, sf):
    """Lengths of retrieved chunks and how often a document comes twice, by method."""
    r = _ranked(spark, sf)
    per = r.groupBy("method").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_distinct("source_code", "external_id").alias("documents"))
    return per.withColumn("repeat_rate", F.round(1 - F.col("documents") / F.col("chunks"), 6))


JUDGE_ANSWERS = (
    ("a", "precision", '{"score": 4, "explanation": "fine"}'),
    ("b", "precision", 'Here it is: ```json\n{"score": 7}\n``` done'),
    ("c", "completeness", '{"score": 2, "missed_items": ["x", " "]}'),
    ("d", "completeness", '{"score": 5, "missed_items": [], "covered_main_answer": false}'),
    ("e", "completeness", 'broken {"score": 3, "covered_main_answer": true'),
    ("f", "format", "no answer at all"),
    ("g", "format", '{"score": "4"}'),
    ("h", "completeness", '{"score": 3, "missed_gold_relevant_information": true'),
    ("i", "precision", None),
)


def judge_parse(spark, sf):
    rows = spark.createDataFrame(list(JUDGE_ANSWERS), "id string, metric string, raw string")
    return rows.select("id", judging.parsed_judgement(F.col("raw"), F.col("metric")).alias("j")).select("id", "j.*")


AGENT_STEPS = (("1", 'ok {"action": "search", "query": "ндс"}'), ("2", '```json\n{"action": "answer"}\n```'), ("3", '{"action": "wait"}'), ("4", "nothing"))


def agent_actions(spark, sf):
    rows = spark.createDataFrame(list(AGENT_STEPS), "id string, raw string")
    return rows.select("id", judging.agent_action(F.col("raw")).alias("a")).select("id", "a.action", "a.query")


_R = "r as (select id, method, dataset, unnest(retrieved, max_depth := 2) from (select distinct id, method, dataset, retrieved from generation_record))"
_M = f"""{_R}, ks(k) as (values (1), (3), (5), (10)),
m0 as (select id, method, dataset, k, avg(rel) as "precision", cast(max(rel) as double) as hit, coalesce(1 / min(case when rel = 1 then rank end), 0) as mrr, sum(rel / log2(rank + 1)) as dcg, sum(rel) as found,
  cast(sum(hard) as bigint) as hard_negatives, cast(max(hard) as double) as any_hard_negative, min(case when hard = 1 then rank end) as first_hard_negative
  from (select *, cast(coalesce(is_gold_relevant, false) as integer) as rel, cast(coalesce(relevance_label = 'hard_negative', false) as integer) as hard from r), ks where rank <= k group by id, method, dataset, k),
m as (select *, case when found > 0 then dcg / list_sum(list_transform(range(1, cast(found + 1 as bigint)), lambda x: 1 / log2(x + 1))) else 0 end as ndcg from m0)"""
_MEANS = 'count(*) as queries, round(avg("precision"), 6) as "precision", round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg'
_FOUND = "list_concat(list_transform(coalesce(relevant, []), lambda c: {s}), list_transform(coalesce(hard_negatives, []), lambda c: {s}))"
_E = f"""e as (select id, source_chunk as t, unnest(f) as c, generate_subscripts(f, 1) - 1 as position from (select id, source_chunk, {_FOUND.format(s="{'source_code': c.source_code, 'external_id': c.external_id, 'chunk_i': c.chunk_i, 'point_id': c.point_id, 'score': c.score, 'text': c.text}")} as f from eval_record))"""


def _same(k: str) -> str:
    return f"coalesce(nullif(cast(t.{k} as varchar), '') = nullif(cast(c.{k} as varchar), ''), false)"


_DOC = f"(nullif(t.source_code, '') is not null and nullif(t.external_id, '') is not null and {_same('source_code')} and {_same('external_id')})"
_STRICT = f"""(case when nullif(t.source_code, '') is not null and nullif(t.external_id, '') is not null and t.chunk_i is not null then {_same('source_code')} and {_same('external_id')} and {_same('chunk_i')}
 else (coalesce(nullif(t.source_code, ''), nullif(t.external_id, ''), cast(t.chunk_i as varchar), nullif(t.point_id, '')) is not null and {' and '.join(f"(nullif(cast(t.{k} as varchar), '') is null or {_same(k)})" for k in ('source_code', 'external_id', 'chunk_i', 'point_id'))}) end)"""


def _terms(x: str) -> str:
    from sievework.plans.retrieval import sql_terms

    return f"list_distinct({sql_terms(x)})"


_OVERLAP = f"({_DOC} and (len({_terms('t.text')}) = 0 or (least(len({_terms('t.text')}), len({_terms('c.text')})) > 0 and len(list_intersect({_terms('t.text')}, {_terms('c.text')})) / greatest(1, least(len({_terms('t.text')}), len({_terms('c.text')}))) >= 0.25)))"


def _match(cond: str) -> str:
    return f"with {_E} select id, cast(position as integer) as position, {cond} as matched from e"


def _context(thirds: bool) -> str:
    part = "case when n < 3 or third = 1 then 1 when third = 2 then 3 else 2 end" if thirds else "1"
    return f"""with {_R}, o as (select id as query_id, rank, trim(coalesce(text, '')) as text, ntile(3) over (partition by id order by rank) as third, count(*) over (partition by id) as n from r),
c as (select query_id, rank, {part} as part, case when length(text) > 2500 then rtrim(left(text, 2500)) || '…' else text end as text from o where text <> ''),
s as (select *, row_number() over w as number, sum(length(text) + 7) over (partition by query_id order by part, rank rows unbounded preceding) - 7 as total from c window w as (partition by query_id order by part, rank))
select query_id, cast(number as integer) as number, rank, text from s where total <= 12000"""


_LABELS = """lab as (select id, unnest(f) as c, generate_subscripts(f, 1) as rank, gold, hard from (select id, gold, hard, list_concat(gold, hard) as f from
  (select id, list_transform(coalesce(relevant, []), lambda x: {'s': x.source_code, 'e': x.external_id, 'i': x.chunk_i}) as gold, list_transform(coalesce(hard_negatives, []), lambda x: {'s': x.source_code, 'e': x.external_id, 'i': x.chunk_i}) as hard from eval_record))),
lev as (select id, rank, coalesce(list_max(list_transform(gold, lambda t: case when t.s = c.s and t.e = c.e and t.i = c.i then 2 when t.s = c.s and t.e = c.e then 1 else 0 end)), 0) as g,
  coalesce(list_max(list_transform(hard, lambda t: case when t.s = c.s and t.e = c.e and t.i = c.i then 2 when t.s = c.s and t.e = c.e then 1 else 0 end)), 0) as h from lab),
l as (select id, cast(rank as integer) as rank, g, h, case when g > 0 then 'gold_relevant' when h > 0 then 'hard_negative' else 'unknown' end as label from lev)"""
_SUMMARY = """select id, count(*) as retrieved_count, count_if(label = 'gold_relevant') as gold_count, count_if(label = 'hard_negative') as hard_negative_count, count_if(label = 'unknown') as unknown_count,
 bool_or(label = 'gold_relevant') as has_gold, coalesce(string_agg(case when label = 'gold_relevant' then cast(rank as varchar) end, ',' order by rank), '') as gold_ranks from l group by id"""
_FALLBACK = f"""{_E}, k as (select id as query_id, cast(position as integer) as position, c.point_id as point_id, c.score as score,
  coalesce(t.source_code = c.source_code, false) as same_source, coalesce(t.source_code = c.source_code and t.external_id = c.external_id and t.chunk_i = c.chunk_i, false) as is_source,
  greatest(0.7, coalesce(avg(c.score) over (partition by id), 0.7)) as bar from e),
f as (select query_id, position, point_id, score, case when is_source then 'relevant' when same_source or coalesce(score, 0) >= bar then 'hard_negative' else 'irrelevant' end as label from k where point_id <> '')"""
_P = """p as (select id, method, unnest([{'metric': 'precision', 'human': human."precision", 'judge': judge."precision".score}, {'metric': 'completeness', 'human': human.completeness, 'judge': judge.completeness.score}, {'metric': 'format', 'human': human.format, 'judge': judge.format.score}], recursive := true)
  from (select distinct id, method, human, judge from generation_record)), v as (select * from p where human between 1 and 5 and judge between 1 and 5)"""


def _kappa(groups: str) -> str:
    g = f"{groups}, " if groups else ""
    def kappa(w):
        return f"case when sum({w.format('h.human', 'j.judge')} * h.n * j.n) > 0 then round(1 - any_value(seen.{'{0}'}) * any_value(seen.n) / sum({w.format('h.human', 'j.judge')} * h.n * j.n), 6) end"
    weights = {"kappa": "cast({0} <> {1} as integer)", "kappa_linear": "abs({0} - {1})", "kappa_quadratic": "({0} - {1}) * ({0} - {1})"}
    cols = ", ".join(f"{kappa(w).format(k)} as {k}" for k, w in weights.items())
    on = " and ".join(f"h.{x} = {{0}}.{x}" for x in groups.split(", "))
    return f"""{_P}, h as (select {g} human, count(*) as n from v group by all), j as (select {g} judge, count(*) as n from v group by all),
seen as (select {g} count(*) as n, round(avg(cast(human = judge as integer)), 6) as exact, round(avg(cast(abs(human - judge) <= 1 as integer)), 6) as within_1, round(avg(abs(human - judge)), 6) as mae,
  sum(cast(human <> judge as integer)) as kappa, sum(abs(human - judge)) as kappa_linear, sum((human - judge) * (human - judge)) as kappa_quadratic from v group by {groups}),
a as (select {', '.join('h.' + x for x in groups.split(', '))}, any_value(seen.n) as n, any_value(exact) as exact, any_value(within_1) as within_1, any_value(mae) as mae, {cols}
  from h join j on {on.format('j')} join seen on {on.format('seen')} group by {', '.join('h.' + x for x in groups.split(', '))})"""


_CITED = "list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(\\d+)\\]', 1), lambda x: cast(x as integer))"
_G = f"g as (select id, answer, retrieved, len(coalesce(retrieved, [])) as n, {_CITED} as cited from (select distinct id, answer, retrieved from generation_record))"
_USED = "list_filter(list_filter(cited, lambda x, i: list_position(cited, x) = i), lambda x: x between 1 and n)"
_NAME = "coalesce(nullif(s.title, ''), s.canonical_url, '')"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

def _renumbered_sql(text: str, used: str) -> str:
    """Text between marks and marks in turn, valid marks with their place in ``used``."""
    return f"""array_to_string(list_transform(list_zip(string_split_regex({text}, '\\[\\d+\\]'), regexp_extract_all({text}, '\\[\\d+\\]')), lambda z: z[1] || coalesce(case when list_position({used}, try_cast(regexp_extract(z[2], '\\[(\\d+)\\]', 1) as integer)) > 0 then '[' || list_position({used}, try_cast(regexp_extract(z[2], '\\[(\\d+)\\]', 1) as integer)) || ']' else z[2] end, '')), '')"""


def cited_sql(text: str) -> str:
    """CTEs ``g (id, answer, retrieved, used)`` over ``text`` of the records and ``base (bases)``."""
    cited = f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '\\[(\\d+)\\]', 1), lambda x: try_cast(x as integer)), lambda x: x between 1 and coalesce(len(retrieved), 0))"
    return f"""g as (select id, {text} as answer, retrieved, list_filter({cited}, lambda x, i: list_position({cited}, x) = i) as used from (select distinct id, answer, retrieved from generation_record)),
base as (select map(list(code), list(base_url)) as bases from rag_source where code is not null and base_url is not null)"""


def source_sql(s: str) -> tuple[str, str]:
    """Name and address of a source struct."""
    title = f"regexp_replace(coalesce({s}.title, ''), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
    day = f"nullif(regexp_extract(coalesce({s}.external_id, ''), '{citations.SLUG_DATE}', 1), '')"
    fine = f"({s}.source_code in {TITLED} and lower({title}) not in {citations.GENERIC_TITLES} and length({title}) <= {citations.LONGEST_TITLE})"
    extras = f"concat_ws('; ', 'от ' || {day}, case when {fine} then {title} end)"
    name = f"concat(coalesce(nullif({s}.source_code, ''), 'Источник'), case when {extras} <> '' then concat(' (', {extras}, ')') else '' end)"
    return name, f"coalesce(nullif({s}.canonical_url, ''), nullif(bases[coalesce({s}.source_code, '')], ''))"


_CITED_SQL = cited_sql("answer")
_PLACES = "list_transform(used, lambda x, i: {'o': x, 'place': i})"
_SOURCE = "{} as name, {} as url".format(*source_sql("retrieved[c.o]"))
_RENUMBERED = _renumbered_sql("{t}", "used").replace("{t}", "answer")
_LINK = f"concat('[', number, '] ', case when url is not null then concat('<a href=\"', {_ESC.format('url')}, '\">', {_ESC.format('name')}, '</a>') else {_ESC.format('name')} end)"

SQL = {
    "eval_metrics_at_k": f'with {_M} select id, k, round("precision", 6) as "precision", hit, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg, hard_negatives, first_hard_negative from m',
    "eval_by_method": f"with {_M} select method, dataset, k, {_MEANS} from m group by method, dataset, k",
    "eval_overall": f"with {_M} select k, {_MEANS} from m group by k",
    "eval_per_source": f"with {_M}, b as (select id, coalesce(nullif(source_code, ''), 'unknown') as source from r where rank = 1) select coalesce(source, 'unknown') as source, k, {_MEANS} from m left join b using (id) group by coalesce(source, 'unknown'), k",
    "eval_hard_negatives": f"with {_M}, s as (select distinct id, coalesce(retrieval_gold_summary.hard_negative_retrieved_count > 0, false) as has from generation_record) select method, k, count_if(has) as with_negatives, round(avg(case when has then any_hard_negative end), 6) as rate, round(avg(case when has then hard_negatives end), 6) as mean_count from m join s using (id) group by method, k",
    "eval_latency_percentiles": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type",
    "judge_latency": """with x as (select method, unnest([{'metric': 'precision', 'ms': judge."precision".latency_ms}, {'metric': 'completeness', 'ms': judge.completeness.latency_ms}, {'metric': 'format', 'ms': judge.format.latency_ms}], recursive := true) from (select distinct id, method, judge from generation_record))
select method, metric, count(ms) as n, round(avg(ms), 6) as mean, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95 from x where ms is not null group by method, metric""",
    "match_strict": _match(_STRICT), "match_doc": _match(_DOC), "match_doc_overlap": _match(_OVERLAP), "match_hybrid": _match(f"({_STRICT} or {_OVERLAP})"),
    "context_budget": _context(False), "context_thirds": _context(True),
    "label_retrieved": f"with {_LABELS} select id, rank, g, h, label from l",
    "eval_gold_summary": f"with {_LABELS} {_SUMMARY}",
    "retrieval_gold_summary": f"with {_R}, l as (select id, rank, relevance_label as label from r) {_SUMMARY}",
    "fallback_labels": f"with {_FALLBACK} select query_id, position, point_id, label from f",
    "eval_record_caps": f"with {_FALLBACK}, b as (select *, row_number() over (partition by query_id, label order by score desc nulls last, position) as place from f where label <> 'irrelevant') select query_id, label, count(*) as items, string_agg(point_id, ',' order by place) as point_ids from b where place <= 5 group by query_id, label",
    "judge_agreement": f"with {_kappa('metric')} select metric, n, exact, within_1, mae, kappa, kappa_linear, kappa_quadratic from a",
    "judge_agreement_by_method": f"with {_kappa('method, metric')} select method, metric, n, exact, within_1, mae, kappa, kappa_linear, kappa_quadratic from a",
    "judge_macro": f"with {_kappa('metric')} select round(avg(exact), 6) as exact, round(avg(within_1), 6) as within_1, round(avg(mae), 6) as mae, round(avg(kappa), 6) as kappa, round(avg(kappa_linear), 6) as kappa_linear, round(avg(kappa_quadratic), 6) as kappa_quadratic from a",
    "judge_averages": f"with {_P} select metric, count(*) as records, count_if(human between 1 and 5) as human_labelled, round(avg(case when human between 1 and 5 then human end), 6) as human_mean, count_if(judge between 1 and 5) as judged, round(avg(case when judge between 1 and 5 then judge end), 6) as judge_mean from p group by metric",
    "eval_rollup": f"""with {_M}, {_G}, f as (select method, count(*) as queries, round(avg("precision"), 6) as "precision", round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(any_hard_negative), 6) as hard_negative_rate, round(avg(hard_negatives), 6) as hard_negatives from m where k = 5 group by method),
c as (select method, round(avg(cast(len(cited) > 0 as double)), 6) as presence, round(avg(case when len(cited) > 0 then len(list_filter(cited, lambda x: x between 1 and n)) / len(cited) else 0 end), 6) as validity, round(avg(len(cited) * 1000.0 / greatest(length(coalesce(answer, '')), 1)), 6) as density
  from g join (select distinct id, method from generation_record) using (id) group by method),
j as (select method, judge."precision".latency_ms as ms from (select distinct id, method, judge from generation_record)),
l as (select method, round(avg(ms), 6) as latency_mean, round(quantile_cont(ms, 0.5), 6) as latency_p50, round(quantile_cont(ms, 0.95), 6) as latency_p95 from j where ms is not null group by method)
select * from f left join c using (method) left join l using (method)""",
    "retrieved_sample": f"""with {_R}, s as (select *, nullif(parent_id, '') as parent from r qualify row_number() over (partition by method order by id, rank) <= 200)
select method, count(*) as items, round(avg(length(text)), 6) as mean_chars, count(distinct parent) as parents, round(case when count(parent) > 0 then 1 - count(distinct parent) / count(parent) else 0 end, 6) as duplicate_parent_rate from s group by method""",
    "judge_rates": """select method, round(avg(cast(s.has_gold_relevant_context as integer)), 6) as with_gold, round(avg(s.gold_relevant_retrieved_count), 6) as gold, round(avg(s.hard_negative_retrieved_count), 6) as hard, round(avg(s.unknown_retrieved_count), 6) as unknown, round(avg(cast(judge."precision".status = 'ok' as integer)), 6) as judged_ok
from (select distinct id, method, retrieval_gold_summary as s, judge from generation_record) group by method""",
    "human_judge_merge": 'select distinct id, judge."precision".score as judge_score, nullif(human."precision", -1) as human_score from generation_record',
    "citation_metrics": f"with {_G} select id, cast(len(cited) > 0 as double) as presence, case when len(cited) > 0 then round(len(list_filter(cited, lambda x: x between 1 and n)) / len(cited), 6) else 0 end as validity, round(len(cited) * 1000.0 / greatest(length(coalesce(answer, '')), 1), 6) as density from g",
    "source_lines": f"""with {_CITED_SQL}, u as (select id, c.o as o, c.place as number, {_SOURCE} from (select id, retrieved, unnest({_PLACES}) as c from g) join base on true)
select id, cast(number as integer) as number, concat('[', number, '] ', name, coalesce(chr(10) || '   ' || url, '')) as line, {_LINK} as link from u""",
    "citation_renumber": f"""with {_CITED_SQL} select id, array_to_string(list_transform({_PLACES}, lambda c: cast(c.o as varchar)), ',') as "order", {_RENUMBERED} as answer from g where answer is not null""",
    "history_window": """with r as (select distinct id, dataset, method, query, answer, generation_metadata.created_at as made from generation_record),
t as (select id, cast(row_number() over w as integer) as turn, lag(id, 1) over w as id1, lag(query, 1) over w as q1, lag(answer, 1) over w as a1, lag(id, 2) over w as id2, lag(query, 2) over w as q2, lag(answer, 2) over w as a2 from r window w as (partition by dataset, method order by made nulls first, id))
select id, turn, concat(case when id2 is not null then concat('user: ', q2, chr(10), 'assistant: ', a2, chr(10)) else '' end, case when id1 is not null then concat('user: ', q1, chr(10), 'assistant: ', a1) else '' end) as history from t""",
    "agent_global_numbering": f"with {_R}, i as (select dataset, method, concat_ws(':', source_code, external_id, chunk_i) as item, id, rank from r), f as (select dataset, method, item, min((id, rank)) as first from i group by dataset, method, item) select dataset, method, cast(row_number() over (partition by dataset, method order by first, item) as integer) as number, item from f qualify number <= 24",
    "agent_union_hit": f"with {_R}, p as (select dataset, id, bool_or(coalesce(is_gold_relevant, false)) as a, bool_or(coalesce(is_gold_relevant, false) and rank = 1) as f, count(*) as n from r group by dataset, id) select dataset, count(*) as questions, round(avg(cast(a as integer)), 6) as union_hit, round(avg(cast(f as integer)), 6) as single_hit, round(avg(n), 6) as mean_chunks, count_if(a and not f) as only_union from p group by dataset",
    "retrieved_lengths": f"with {_R} select method, count(*) as chunks, round(avg(length(text)), 6) as mean_chars, count(distinct case when source_code is not null and external_id is not null then (source_code, external_id) end) as documents, round(1 - count(distinct case when source_code is not null and external_id is not null then (source_code, external_id) end) / count(*), 6) as repeat_rate from r group by method",
    "judge_parse": """select * from (values ('a', 4, 'ok', null::boolean, null::boolean), ('b', null, 'invalid_score', null, null), ('c', 2, 'ok', true, false), ('d', 5, 'ok', false, false),
 ('e', 3, 'ok_salvaged', true, true), ('f', null, 'parse_failed', null, null), ('g', null, 'invalid_score', null, null), ('h', 3, 'ok_salvaged', true, true), ('i', null, 'parse_failed', null, null)) t(id, score, status, missed, covered)""",
    "agent_actions": "select * from (values ('1', 'search', 'ндс'), ('2', 'answer', null), ('3', null, null), ('4', null, null)) t(id, action, query)",
}

QUERIES = {
    name: globals()[name]
    for name in (
        "eval_metrics_at_k", "eval_by_method", "eval_overall", "eval_per_source", "eval_hard_negatives", "eval_latency_percentiles", "judge_latency", "eval_rollup", "retrieved_sample", "match_strict", "match_doc", "match_doc_overlap", "match_hybrid", "context_budget", "context_thirds",
        "label_retrieved", "eval_gold_summary", "retrieval_gold_summary", "fallback_labels", "eval_record_caps", "judge_agreement", "judge_agreement_by_method", "judge_macro", "judge_averages", "judge_rates", "human_judge_merge",
        "citation_metrics", "citation_renumber", "source_lines", "history_window", "agent_global_numbering", "agent_union_hit", "retrieved_lengths", "judge_parse", "agent_actions",
    )
}
