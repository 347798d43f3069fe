"""Experiment logs: append-only rows of runs and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(log: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """The last successful row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return log.filter("status = 'ok'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def remaining(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The work that no successful row of the log covers."""
    return work.join(log.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def top_variants(log: DataFrame, variant: str, scores: list[str], n: int = 3) -> DataFrame:
    """The n variants with the best scores, each at its best row."""
    best = log.groupBy(variant).agg(F.max(F.struct(*scores)).alias("best"))
    return best.select(variant, "best.*").orderBy(*(F.col(s).desc() for s in scores), variant).limit(n)


def tail(log: DataFrame, n: int, position: str = "position") -> DataFrame:
    return log.orderBy(F.col(position).desc()).limit(n)


def plausible(report: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows with status ok and some metric that is not zero."""
    some = F.exists(F.array(*(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics)), lambda x: x != 0)
    return report.filter(F.col("status") == "ok").filter(some)


def markdown_cell(value: Column, kind: str) -> Column:
    """Floats with four digits, ``-`` for null, bars escaped."""
    text = F.format_string("%.4f", value.cast("double")) if kind in ("double", "float") else F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.when(value.isNull(), F.lit("-")).otherwise(text)


def markdown_rows(table: DataFrame) -> DataFrame:
    """One ``line`` of a Markdown table for each row."""
    cells = [markdown_cell(F.col(c), kind) for c, kind in table.dtypes]
    return table.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
