"""Numeric, vector and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """A ranked list's share of the fused score; 0 where it does not rank the item."""
    return F.coalesce(1.0 / (F.lit(k) + rank), F.lit(0.0))


def valid_score(score: Column) -> Column:
    """A score of 1 to 5, else null."""
    return F.when(score.between(1, 5), score)


def day8(digits: Column) -> Column:
    """Date of eight digits: yyyyMMdd if they begin with a year of this century, else ddMMyyyy."""
    year = F.left(digits, F.lit(4)).try_cast("int")
    return F.when(digits.rlike(r"^\d{8}$"), F.when(year.between(2000, 2099), F.try_to_date(digits, "yyyyMMdd")).otherwise(F.try_to_date(digits, "ddMMyyyy")))


def backoff_days(frequency: Column, errors: Column) -> Column:
    """Days to the next try after ``errors`` failures: doubled each time, at most the frequency."""
    return F.least(frequency, F.pow(F.lit(2.0), F.least(errors, F.lit(30))).cast("int"))


def days_after(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days)
