"""Records for people and models to read: review sheets, contexts, snippets, final answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import citations
from sievework.functions.text import html_escape, rstrip, strip

SHEET = (
    "id", "query", "answer", "gold_relevant_context_preview", "hard_negative_context_preview", "unknown_context_preview", "gold_relevant_ranks", "has_gold_relevant_context",
    "source_1", "source_2", "source_3", "human_precision", "human_completeness", "human_format", "human_comment",
)


def _cut(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(rstrip(F.left(text, F.lit(limit))), F.lit(mark))).otherwise(text)


def preview(retrieved: Column, label: str, each: int = 500, whole: int = 1200) -> Column:
    """Numbered texts of one label, each and all together cut."""
    chosen = F.filter(F.coalesce(retrieved, F.array()), lambda r: r["relevance_label"] == label)
    parts = F.transform(chosen, lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), _cut(F.replace(strip(F.coalesce(r["text"], F.lit(""))), F.lit("\r\n"), F.lit("\n")), each)))
    return _cut(F.array_join(parts, "\n\n"), whole)


def _named(r: Column, key: str) -> Column:
    return F.concat(F.lit(f"{key}="), F.coalesce(r[key].cast("string"), F.lit("None")))


def review_sheet(records: DataFrame) -> DataFrame:
    """One row of a review sheet for each generation record."""

    def source(n: int) -> Column:
        r = F.get("retrieved", F.lit(n))
        url = F.when(F.coalesce(r["canonical_url"], F.lit("")) != "", F.concat(F.lit("url="), r["canonical_url"]))
        return F.when(r.isNull(), "").otherwise(F.concat_ws("; ", *(_named(r, k) for k in ("rank", "source_code", "external_id", "chunk_i")), url))

    out = records.select(
        "id", "query", F.coalesce("answer", F.lit("")).alias("answer"), *(preview(F.col("retrieved"), x).alias(f"{x}_context_preview") for x in ("gold_relevant", "hard_negative", "unknown")),
        F.array_join(F.transform(F.coalesce("retrieval_gold_summary.gold_relevant_ranks", F.array()), lambda x: x.cast("string")), ",").alias("gold_relevant_ranks"), F.col("retrieval_gold_summary.has_gold_relevant_context").alias("has_gold_relevant_context"),
        *(source(n).alias(f"source_{n + 1}") for n in range(3)), *(F.coalesce(f"human.{m}", F.lit(-1)).alias(f"human_{m}") for m in ("precision", "completeness", "format")), F.coalesce("human.comment", F.lit("")).alias("human_comment"),
    )
    return out.select(*SHEET)


def with_scores(records: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Records with the scores saved for their ids laid over their own."""
    s = scores.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    return records.join(s, "id", "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns))


def snippet(number: Column, chunk: Column, limit: int = 500) -> Column:
    """``[n] (source / document / chunk) score=0.123`` (halves rounded up) and the text's beginning."""
    text = F.replace(strip(F.coalesce(chunk["text"], F.lit(""))), F.lit("\n"), F.lit(" "))
    name = F.concat_ws(" / ", chunk["source_code"], chunk["external_id"], F.concat(F.lit("chunk "), chunk["chunk_i"].cast("string")))
    score = F.when(chunk["score"].isNotNull(), F.format_string(" score=%.3f", chunk["score"])).otherwise("")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ("), name, F.lit(")"), score, F.lit("\n"), _cut(text, limit, "…"))


def final_answer(answer: Column, sources: Column, names: Column | None = None, bases: Column | None = None, titled: tuple[str, ...] = (), html: bool = False) -> Column:
    """The answer with its own section of sources cut, valid citations numbered anew, and the
    cited sources listed; without valid citations nothing is listed.

    ``sources``: array of source_code, external_id, title, canonical_url; ``names`` and
    ``bases``: maps of source code to display name and address.  With ``html`` the answer is
    escaped and the sources are links.
    """
    text = rstrip(citations.without_own_sources(answer))
    n = F.size(F.coalesce(sources, F.array()))
    order = citations.used(text, n)
    one = lambda k: F.element_at(sources, k)
    lines = F.transform(order, lambda k, i: citations.source_line(i + 1, citations.source_name(one(k), names, titled), citations.source_url(one(k), bases), html))
    shown = html_escape if html else (lambda x: x)
    return F.when(F.size(order) == 0, shown(text)).otherwise(F.concat(rstrip(shown(citations.renumbered(text, n))), F.lit("\n\nИсточники:\n"), F.array_join(lines, "\n")))


def with_source_chunk(candidates: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their query's own chunk before them (rank 0) where it is missing."""
    missing = sources.join(candidates.select(*keys).distinct(), keys, "left_anti").withColumn("rank", F.lit(0))
    return candidates.unionByName(missing, allowMissingColumns=True)


def rewrite_rate(rewrites: DataFrame) -> DataFrame:
    """(n, changed, rate) of ``before, after``."""
    changed = F.trim("after") != F.trim("before")
    return rewrites.agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"), F.round(F.coalesce(F.avg(changed.cast("int")), F.lit(0.0)), 6).alias("rate"))


def with_rewrites(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Queries with the rewrite prepared for their text, else as they are."""
    r = rewrites.select(F.col("before").alias("query"), F.col("after").alias("_after")).dropDuplicates(["query"])
    return queries.join(r, "query", "left").withColumn("search_query", F.coalesce("_after", "query")).drop("_after")


def record_slice(records: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    """Records offset to offset + limit in the order of a key."""
    return records.orderBy(order).offset(offset).limit(limit)


def long_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): a report in long form, so names need not hold k."""
    values = [c for c in metrics.columns if c not in keys]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values))
    return metrics.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")
