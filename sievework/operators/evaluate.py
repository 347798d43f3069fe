"""Retrieval evaluation: matching, metrics at k, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import overlap_coefficient, terms

MATCH_MODES = ("strict", "doc", "doc_overlap", "hybrid")


def _text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _same(t: Column, c: Column, key: str) -> Column:
    return F.coalesce(_text(t[key]) == _text(c[key]), F.lit(False))


def match(target: Column, candidate: Column, mode: str, threshold: float = 0.25) -> Column:
    """Whether a candidate is the target; both structs of source_code, external_id, chunk_i,
    point_id, text.

    ``strict``: source, document and chunk if the target names all three, else every key it
    names; ``doc``: source and document; ``doc_overlap``: the document, and the terms of the two
    texts overlap by ``threshold`` (a target without terms overlaps with everything);
    ``hybrid``: strict or doc_overlap.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"Unsupported match_mode={mode!r}. Expected one of: {', '.join(MATCH_MODES)}")
    keys = ("source_code", "external_id", "chunk_i")
    full = _text(target["source_code"]).isNotNull() & _text(target["external_id"]).isNotNull() & target["chunk_i"].isNotNull()
    chunk = _same(target, candidate, "source_code") & _same(target, candidate, "external_id") & _same(target, candidate, "chunk_i")
    named = [_text(target[k]).isNotNull() for k in (*keys, "point_id")]
    each = [(~n) | _same(target, candidate, k) for n, k in zip(named, (*keys, "point_id"))]
    any_named, all_same = named[0], each[0]
    for n, e in zip(named[1:], each[1:]):
        any_named, all_same = any_named | n, all_same & e
    strict = F.when(full, chunk).otherwise(any_named & all_same)
    doc = F.when(_text(target["source_code"]).isNotNull() & _text(target["external_id"]).isNotNull(), _same(target, candidate, "source_code") & _same(target, candidate, "external_id")).otherwise(F.lit(False))
    a, b = terms(target["text"]), terms(candidate["text"])
    overlap = doc & ((F.size(a) == 0) | (overlap_coefficient(a, b) >= threshold))
    return {"strict": strict, "doc": doc, "doc_overlap": overlap, "hybrid": strict | overlap}[mode]


def any_match(targets: Column, candidate: Column, mode: str, threshold: float = 0.25) -> Column:
    return F.exists(targets, lambda t: match(t, candidate, mode, threshold))


def metrics_at_k(ranked: DataFrame, ks: tuple[int, ...], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, k, precision, hit, mrr, ndcg, hard_negatives, any_hard_negative, first_hard_negative).

    ``ranked``: one row per retrieved item with ``rank`` from 1, ``relevant`` and
    ``hard_negative`` (boolean; null counts as false).  Precision divides by what was
    returned up to k; the ideal of nDCG orders the returned items.  All k come from one pass.
    """
    rel, hard = F.coalesce("relevant", F.lit(False)), F.coalesce("hard_negative", F.lit(False))
    rows = ranked.select(*keys, "rank", rel.cast("int").alias("rel"), hard.cast("int").alias("hard")).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k")
    discount = lambda r: 1 / F.log2(r + 1)
    per = rows.groupBy(*keys, "k").agg(
        F.avg("rel").alias("precision"), F.max("rel").cast("double").alias("hit"), F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("rel") * discount(F.col("rank"))).alias("dcg"), F.sum("rel").alias("found"), F.sum("hard").alias("hard_negatives"), F.max("hard").cast("double").alias("any_hard_negative"), F.min(F.when(F.col("hard") == 1, F.col("rank"))).alias("first_hard_negative"),
    )
    # The ideal of n relevant items is a sum over ranks 1..n: no second ranking is needed.
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("found"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + discount(r))
    ndcg = F.when(F.col("found") > 0, F.col("dcg") / ideal).otherwise(0.0)
    return per.select(*keys, "k", "precision", "hit", "mrr", ndcg.alias("ndcg"), "hard_negatives", "any_hard_negative", "first_hard_negative")


def rollup(metrics: DataFrame, *groups: str) -> DataFrame:
    """Means over queries, for each group and k; means over nothing are 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return metrics.groupBy(*groups, "k").agg(F.count("*").alias("queries"), *(mean(c) for c in ("precision", "hit", "mrr", "ndcg")))


def hard_negative_rates(metrics: DataFrame, with_negatives: Column, *groups: str) -> DataFrame:
    """Averaged over queries that have hard negatives; null without any."""
    only = lambda c: F.when(with_negatives, F.col(c))
    return metrics.groupBy(*groups, "k").agg(F.count_if(with_negatives).alias("with_negatives"), F.round(F.avg(only("any_hard_negative")), 6).alias("rate"), F.round(F.avg(only("hard_negatives")), 6).alias("mean_count"))


def latency_percentiles(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*groups).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def context(ranked: DataFrame, order: str = "rerank_123", max_chunk: int = 2500, max_total: int = 12000, separator: str = "\n\n---\n\n", key: str = "query_id") -> DataFrame:
    """(key, number, rank, text): the chunks of the context in their order, numbered.

    ``rerank_132`` puts the middle third last.  Chunks without text are skipped, long ones cut;
    the context ends before the first chunk that would exceed ``max_total`` characters
    (separators count, numbers do not).
    """
    if order not in ("rerank_123", "rerank_132"):
        raise ValueError(f"Unsupported context_order={order!r}")
    w = Window.partitionBy(key).orderBy("rank")
    rows = ranked.select(key, "rank", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    if order == "rerank_132":
        third = F.ntile(3).over(w)
        small = F.count("*").over(Window.partitionBy(key)) < 3
        rows = rows.withColumn("part", F.when(small, F.lit(1)).otherwise(F.element_at(F.array(F.lit(1), F.lit(3), F.lit(2)), third)))
    else:
        rows = rows.withColumn("part", F.lit(1))
    cut = F.when(F.length("text") > max_chunk, F.concat(F.rtrim(F.left("text", F.lit(max_chunk))), F.lit("…"))).otherwise(F.col("text"))
    use = rows.filter("text <> ''").withColumn("text", cut)
    by = Window.partitionBy(key).orderBy("part", "rank")
    # Lengths are not negative, so the running sum stays above once it has been.
    number = F.row_number().over(by)
    total = F.sum(F.length("text") + F.lit(len(separator))).over(by.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    return use.withColumn("number", number).withColumn("total", total).filter(F.col("total") <= max_total).select(key, "number", "rank", "text")
