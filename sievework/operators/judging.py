"""Labels of retrieved context, judge answers, agreement of judges and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import valid_score

METRICS = ("precision", "completeness", "format")


def match_level(identity: Column, targets: Column) -> Column:
    """2 the chunk, 1 the document, 0 none: the best match among the targets."""
    same = lambda t, k: F.coalesce(F.nullif(t[k].cast("string"), F.lit("")) == F.nullif(identity[k].cast("string"), F.lit("")), F.lit(False))
    doc = lambda t: same(t, "source_code") & same(t, "external_id")
    level = lambda t: F.when(doc(t) & same(t, "chunk_i"), 2).when(doc(t), 1).otherwise(0)
    return F.coalesce(F.array_max(F.transform(targets, level)), F.lit(0))


def label(gold: Column, hard: Column) -> Column:
    """A document-level match is enough; gold goes before hard negative."""
    return F.when(gold > 0, "gold_relevant").when(hard > 0, "hard_negative").otherwise("unknown")


def gold_summary(labelled: DataFrame, key: str) -> DataFrame:
    """Counts of labels and the ranks of gold items of each record."""
    is_ = lambda v: F.col("label") == v
    return labelled.groupBy(key).agg(
        F.count("*").alias("retrieved_count"), F.count_if(is_("gold_relevant")).alias("gold_count"), F.count_if(is_("hard_negative")).alias("hard_negative_count"), F.count_if(is_("unknown")).alias("unknown_count"),
        F.coalesce(F.max(is_("gold_relevant")), F.lit(False)).alias("has_gold"), F.sort_array(F.collect_list(F.when(is_("gold_relevant"), F.col("rank")))).alias("gold_ranks"),
    )


def fallback_labels(candidates: DataFrame) -> DataFrame:
    """Labels without a model: the source chunk is relevant, near candidates hard negatives.

    ``candidates``: ``query_id, point_id, score, is_source, same_source``.  Near means the same
    source or a score of at least the mean of the query's scores, 0.7 at least.
    """
    from pyspark.sql import Window

    bar = F.greatest(F.lit(0.70), F.coalesce(F.avg("score").over(Window.partitionBy("query_id")), F.lit(0.70)))
    value = F.when(F.col("is_source"), "relevant").when(F.col("same_source") | (F.coalesce("score", F.lit(0.0)) >= bar), "hard_negative").otherwise("irrelevant")
    return candidates.filter("point_id is not null and point_id <> ''").withColumn("label", value)


def agreement(pairs: DataFrame, *groups: str) -> DataFrame:
    """n, exact, within one, mean error and Cohen's kappa (plain, linear, quadratic) of
    ``(groups, human, judge)`` where both are 1 to 5; a kappa that is not defined is null."""
    valid = pairs.select(*groups, valid_score(F.col("human")).alias("h"), valid_score(F.col("judge")).alias("j")).filter("h is not null and j is not null")
    cells = valid.groupBy(*groups, "h", "j").agg(F.count("*").alias("n"))
    total = cells.groupBy(*groups).agg(F.sum("n").alias("total"), F.collect_list(F.struct("h", "j", "n")).alias("cells"))  # 25 cells at most
    marginal = lambda side, v: F.aggregate(F.filter("cells", lambda c: c[side] == v), F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    labels = range(1, 6)

    def kappa(weight) -> Column:
        seen = F.aggregate("cells", F.lit(0.0), lambda s, c: s + weight(c["h"], c["j"]) * c["n"])
        chance = F.lit(0.0)
        for a in labels:
            for b in labels:
                if a != b:
                    chance = chance + weight(F.lit(a), F.lit(b)) * F.col(f"h{a}") * F.col(f"j{b}")
        return F.when(chance > 0, F.round(1 - seen * F.col("total") / chance, 6))

    wide = total
    for v in labels:
        wide = wide.withColumn(f"h{v}", marginal("h", v)).withColumn(f"j{v}", marginal("j", v))
    gap = lambda c: F.abs(c["h"] - c["j"])
    share = lambda f: F.round(F.aggregate("cells", F.lit(0.0), lambda s, c: s + f(c) * c["n"]) / F.col("total"), 6)
    return wide.select(
        *groups, F.col("total").alias("n"), share(lambda c: (gap(c) == 0).cast("double")).alias("exact"), share(lambda c: (gap(c) <= 1).cast("double")).alias("within_1"), share(lambda c: gap(c).cast("double")).alias("mae"),
        kappa(lambda a, b: (a != b).cast("double")).alias("kappa"), kappa(lambda a, b: F.abs(a - b).cast("double")).alias("kappa_linear"), kappa(lambda a, b: ((a - b) * (a - b)).cast("double")).alias("kappa_quadratic"),
    )


def macro(per_metric: DataFrame) -> DataFrame:
    """Means over metrics; what is null is skipped."""
    return per_metric.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("exact", "within_1", "mae", "kappa", "kappa_linear", "kappa_quadratic")))


# What a judge's answer may say, as JSON types.
_BOOLEANS = ("should_abstain", "did_abstain", "covered_main_answer", "missed_gold_relevant_information")


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer: within a code fence, else from the first brace to
    the last; null if there is none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def parsed_judgement(raw: Column, metric: Column) -> Column:
    """struct(score, status, missed, covered): a judge's answer.

    A whole number of 1 to 5 is ``ok``; another ``score`` is ``invalid_score``; where the JSON is
    broken a score is looked for in the text (``ok_salvaged``), else ``parse_failed``.
    Completeness without the two flags gets them from what it lists or from the score.
    """
    value = F.try_parse_json(json_object(raw))
    text = F.try_variant_get(value, "$.score", "string")
    kind = F.schema_of_variant(F.try_variant_get(value, "$.score", "variant"))
    score = F.when(kind.isin("BIGINT", "INT", "LONG") & text.rlike("^[1-5]$"), text.cast("int"))
    salvaged = F.nullif(F.regexp_extract(raw, r'"score"\s*:\s*([1-5])(?![0-9.])', 1), F.lit("")).cast("int")
    parsed = value.isNotNull()
    final = F.when(parsed, score).otherwise(salvaged)
    status = F.when(parsed & score.isNotNull(), "ok").when(parsed, "invalid_score").when(salvaged.isNotNull(), "ok_salvaged").otherwise("parse_failed")
    flag = lambda k: F.coalesce(F.when(parsed, F.try_variant_get(value, f"$.{k}", "boolean")), F.when(~F.coalesce(parsed, F.lit(False)), F.lower(F.nullif(F.regexp_extract(raw, rf'(?i)"{k}"\s*:\s*(true|false)', 1), F.lit(""))) == "true"))
    complete = (metric == "completeness") & final.isNotNull()
    items = F.size(F.coalesce(F.filter(F.try_variant_get(value, "$.missed_items", "array<string>"), lambda x: F.trim(x) != ""), F.array().cast("array<string>")))
    missed = F.when(complete, F.coalesce(flag("missed_gold_relevant_information"), F.when(parsed, items > 0).otherwise(final <= 3)))
    covered = F.when(complete, F.coalesce(flag("covered_main_answer"), final >= 3))
    return F.struct(final.alias("score"), status.alias("status"), missed.alias("missed"), covered.alias("covered"))


def agent_action(raw: Column) -> Column:
    """struct(action, query): a step of an agent; null unless it searches or answers."""
    step = F.from_json(json_object(raw), "action string, query string")
    return F.when(step["action"].isin("search", "answer"), step)


def candidate_labels(raw: Column) -> Column:
    """map of point id to label from a model's JSON; unusable entries are left out."""
    listed = F.from_json(json_object(raw), "labels array<struct<point_id string, label string>>")["labels"]
    good = F.filter(listed, lambda x: F.coalesce(x["point_id"] != "", F.lit(False)) & x["label"].isin("relevant", "hard_negative", "irrelevant"))
    return F.map_from_entries(F.transform(good, lambda x: F.struct(x["point_id"], x["label"])))


def rates(records: DataFrame, flags: dict[str, tuple[str, bool]], *groups: str) -> DataFrame:
    """For each name the share of records whose flag is set; ``flags``: name to column and
    whether it counts negated.  A missing flag is left out; without any the rate is null."""
    share = lambda column, negated: F.round(F.avg((~F.col(column) if negated else F.col(column)).cast("int")), 6)
    return records.groupBy(*groups).agg(F.count("*").alias("records"), *(share(c, n).alias(name) for name, (c, n) in flags.items()))


# What a judge's flags are reported as, and which count negated.
RATES = {
    "should_abstain_rate": ("should_abstain", False), "did_abstain_rate": ("did_abstain", False), "abstention_alignment_rate": ("abstention_aligned", False), "used_gold_relevant_context_rate": ("used_gold_relevant_context", False),
    "used_hard_negative_as_support_rate": ("used_hard_negative_as_support", False), "missed_gold_relevant_information_rate": ("missed_gold_relevant_information", False), "unreadable_rate": ("is_readable", True),
    "broken_encoding_rate": ("has_broken_encoding", False), "raw_html_rate": ("has_raw_html", False), "unwanted_markdown_or_latex_rate": ("has_unwanted_markdown_or_latex", False),
    "rude_or_unprofessional_rate": ("is_rude_or_unprofessional", False), "missing_required_structure_rate": ("has_required_structure", True),
}


def judge_rates(judged: DataFrame, *groups: str) -> DataFrame:
    """The rates of RATES over flat flags; two abstentions agree where both are known."""
    aligned = judged.withColumn("abstention_aligned", F.col("should_abstain") == F.col("did_abstain"))
    return rates(aligned, RATES, *groups)
