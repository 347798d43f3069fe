"""Cleaning profiles: each a plan over a table of texts."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.durable import ship
from sievework.functions.text import strip
from sievework.operators import lines

PROFILES = ("raw", "clean_basic", "clean_legal", "clean_aggressive", "clean_no_boilerplate")


# Entities resolved before all others, and the warnings of a report.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
TOO_MUCH, TOO_SHORT = "High removed_char_ratio; cleaning may be too aggressive.", "Cleaned text is very short."


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    """Entities resolved (named ones first, so twice-escaped ones come out) and accents composed:
    Spark has no built-in function for either."""

    def one(t):
        if t is None:
            return None
        if "&" in t:
            for a, b in ENTITIES:
                t = t.replace(a, b)
            t = html.unescape(t)
        return t if t.isascii() else unicodedata.normalize("NFC", t)

    return text.map(one)


def basic(text: Column) -> Column:
    return lines.normal_text(_composed(F.coalesce(text, F.lit(""))))


def cleaned(corpus: DataFrame, profile: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, text) under a profile; a null text counts as empty.

    The boilerplate profile counts lines over the uncleaned texts of the same corpus.
    """
    if profile not in PROFILES:
        raise ValueError(f"no cleaning profile {profile!r}; there are {', '.join(PROFILES)}")
    ship(corpus.sparkSession)
    rows = corpus.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("source"))
    if profile == "raw":
        out = rows.withColumn("text", strip(F.col("source")))
    else:
        # The Arrow step is done once; what follows are built-in expressions on its column.
        out = rows.withColumn("text", basic(F.col("source")))
        if profile != "clean_basic":
            out = out.withColumn("text", lines.without_navigation(F.col("text")))
        if profile == "clean_aggressive":
            out = out.withColumn("text", lines.without_noise(F.col("text"))).withColumn("text", lines.without_repeats(F.col("text")))
        if profile == "clean_no_boilerplate":
            gone = lines.gone_lines(lines.boilerplate_lines(corpus, text))
            rest = lines.kept(F.col("text"), lambda x: ~F.array_contains(F.col("gone"), x["folded"]) | lines.legal_folded(x["folded"]))
            out = out.crossJoin(F.broadcast(gone)).withColumn("text", rest).drop("gone")
    return out.withColumnRenamed("key", key)


def with_report(cleaned_texts: DataFrame) -> DataFrame:
    """Adds lengths, share of characters and number of lines removed, and warnings."""
    a, b = F.length("source"), F.length("text")
    ratio = F.when(a > 0, F.greatest(F.lit(0.0), (a - b) / a)).otherwise(0.0)
    gone = F.greatest(F.lit(0), F.size(lines.split_lines(F.col("source"))) - F.size(lines.split_lines(F.col("text"))))
    warnings = F.filter(F.array(F.when(F.col("removed_ratio") > 0.5, F.lit(TOO_MUCH)), F.when(b < 200, F.lit(TOO_SHORT))), lambda x: x.isNotNull())
    return cleaned_texts.withColumns({"original_chars": a, "cleaned_chars": b, "removed_ratio": ratio, "removed_lines": gone}).withColumn("warnings", warnings)


def summary(report: DataFrame) -> DataFrame:
    """One row over all documents of a report."""
    return report.agg(
        F.count("*").alias("docs"), F.round(F.avg("removed_ratio"), 6).alias("mean_removed_ratio"), F.round(F.percentile("removed_ratio", F.lit(0.95)), 6).alias("p95_removed_ratio"),
        F.count_if(F.size("warnings") > 0).alias("warning_docs"), F.round(F.avg("original_chars"), 6).alias("mean_original_chars"), F.round(F.avg("cleaned_chars"), 6).alias("mean_cleaned_chars"),
    )
