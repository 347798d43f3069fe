"""Queries of this package over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import encoding, leaks, near_duplicates, packing, pairs, site_lines, splitting, subjects
from sievework.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.repeated_lines(load(spark, sf, "local_document"))


def p1_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.cleaned_by_deltas(load(spark, sf, "local_document"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_records(load(spark, sf, "local_document"))


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.restored_texts(load(spark, sf, "local_document"), load(spark, sf, "rag_fetch_log"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_defects(load(spark, sf, "generation_record"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(load(spark, sf, "local_document"), load(spark, sf, "chunking_config"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(load(spark, sf, "local_document"), load(spark, sf, "chunking_config"))


def p4_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each configuration and record whether its pieces cover the text, keep the size, and
    begin within the overlap asked for; SQL says which pairs there are and that all is true."""
    records, configs = load(spark, sf, "local_document"), load(spark, sf, "chunking_config")
    each = splitting.split_texts(records, configs, with_text=False).distinct()
    per = each.groupBy("config_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "stop"))).alias("p"))
    joined = per.join(F.broadcast(configs.select("config_id", "chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("overlap"))), "config_id").join(records.select("doc_id", F.length("text").alias("chars")).distinct(), "doc_id")
    steps = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, i: F.get("p", i)["stop"] - x["start"])
    return joined.select(
        "config_id", "doc_id", ((F.get("p", F.lit(0))["start"] == 0) & (F.element_at("p", -1)["stop"] == F.col("chars")) & F.forall(steps, lambda x: x >= 0)).alias("covered"),
        F.forall("p", lambda x: x["stop"] - x["start"] <= F.col("chunk_size")).alias("within_size"), F.forall(steps, lambda x: (x <= F.col("overlap")) & (x >= F.col("overlap") - F.floor(F.col("overlap") / 5))).alias("within_overlap"),
        ((F.col("chars") > F.col("chunk_size")) == (F.size("p") > 1)).alias("cut_if_oversized"),
    )


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each container how many texts are placed, and whether each is placed exactly once
    and whole, no bin is above the capacity and bins are nine tenths full together."""
    documents, boxes = load(spark, sf, "documents"), load(spark, sf, "container_size")
    rows = packing.packed(documents, boxes).join(F.broadcast(boxes.select("container_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("gap"))), "container_id")
    bins = rows.groupBy("container_id", "capacity_tokens", "group_no", "bin_no").agg((F.sum("tokens") + F.first("gap") * (F.count("*") - 1)).alias("used"))
    full = bins.groupBy("container_id").agg((F.max(F.col("used") - F.col("capacity_tokens")) <= 0).alias("within_capacity"), (F.sum("used") >= 0.9 * F.sum("capacity_tokens")).alias("nearly_full"))
    texts = rows.groupBy("container_id", "doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("placed"), F.count_distinct("piece_no").alias("pieces"), F.count("*").alias("n")).join(documents.select("doc_id", F.length("text").alias("chars")), "doc_id")
    return texts.groupBy("container_id").agg(F.count("*").alias("texts"), F.bool_and((F.col("placed") == F.col("chars")) & (F.col("pieces") == F.col("n"))).alias("once_and_whole")).join(full, "container_id")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    records = load(spark, sf, "local_document")
    return near_duplicates.near_duplicate_groups(records, words=3, threshold=0.5, min_chars=200, exclude=encoding.garbled_records(records))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.group_pairs(_groups(spark, sf))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf)


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(load(spark, sf, "documents"), load(spark, sf, "container_size"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(load(spark, sf, "documents"), load(spark, sf, "eval_record"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents")
    return leaks.without_leaks(documents, leaks.leaked_spans(documents, load(spark, sf, "eval_record")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subject_areas(load(spark, sf, "documents"), load(spark, sf, "subject_label"), load(spark, sf, "subject_area"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by area; a document of several areas counts in each."""
    return p8_found(spark, sf).groupBy("subject_code").agg(F.count("*").alias("documents"))


_REPEATED = r"""
with record as (select distinct doc_id, source_code, text from local_document),
line as (select doc_id, source_code, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from record),
keyed as (select *, regexp_replace(replace(lower(line), 'ё', 'е'), '[^\p{L}]', '', 'g') as key from line),
total as (select source_code, count(*) as n from record group by source_code),
repeated as (
  select k.source_code, k.key from keyed k join total t on k.source_code is not distinct from t.source_code
  where k.key <> '' group by k.source_code, k.key, t.n
  having count(distinct k.doc_id) >= 5 and count(distinct k.doc_id) >= 0.2 * t.n)
"""


def queries() -> dict[str, Query]:
    own = (p1_found, p1_cleaned, p2_found, p2_restored, p3_found, p4_found, p4_pieces, p4_invariants, p5_found, p5_groups, p6_packed, p6_invariants, p7_found, p7_cleaned, p8_found, p8_shares)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _REPEATED + """
select k.doc_id, cast(k.line_no as integer) as line_no from keyed k
join repeated r on k.source_code is not distinct from r.source_code and k.key = r.key""",
        "p1_cleaned": _REPEATED + """
, kept as (
  select k.doc_id, string_agg(k.line, chr(10) order by k.line_no) as text from keyed k
  where not exists (select 1 from repeated r where k.source_code is not distinct from r.source_code and k.key = r.key) group by k.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text from record d left join kept k on d.doc_id = k.doc_id""",
        "p4_invariants": """
select c.config_id, d.doc_id, true as covered, true as within_size, true as within_overlap, true as cut_if_oversized
from chunking_config c, (select distinct doc_id, text from local_document) d
where c.chunk_size > 0 and coalesce(c.chunk_overlap, 0) between 0 and c.chunk_size - 1 and d.text is not null""",
        "p6_invariants": """
select c.container_id, count(*) as texts, true as once_and_whole, true as within_capacity, true as nearly_full
from container_size c, documents d where c.capacity_tokens > 0 and d.text is not null group by c.container_id""",
        "p4_found": """
select distinct c.config_id, d.doc_id from chunking_config c, local_document d
where c.chunk_size > 0 and coalesce(c.chunk_overlap, 0) between 0 and c.chunk_size - 1 and length(d.text) > c.chunk_size""",
    }
