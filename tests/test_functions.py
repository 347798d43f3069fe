import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import citations
from sievework.functions import numbers as n
from sievework.functions import text as t


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int")
    return row.select(column).first()[0]


def test_uuid5(spark):
    assert one(spark, t.uuid5(F.lit("a:b:1"))) == "0bb98f14-1818-557e-a536-53ceed4cbc67"
    names = [f"имя {i}" for i in range(40)]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select("x", t.uuid5(F.col("x"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, r[0])) for r in rows)


def test_terms_fold_and_keep_order(spark):
    assert one(spark, t.terms(F.lit("Ёлка ab НДС-2024, ёлка"))) == ["елка", "ндс", "2024", "елка"]
    assert one(spark, t.terms(F.lit(None).cast("string"))) == []


def test_overlap(spark):
    a, b = F.array(*map(F.lit, ("x", "y", "y"))), F.array(*map(F.lit, ("y", "z", "w")))
    assert one(spark, t.overlap_coefficient(a, b)) == 0.5
    assert one(spark, t.overlap_coefficient(a, F.array().cast("array<string>"))) == 0.0


def test_backoff(spark):
    rows = spark.range(1, 4).select(n.backoff_days(F.lit(7), F.col("id").cast("int"))).collect()
    assert [r[0] for r in rows] == [2, 4, 7]


def test_rrf(spark):
    assert round(one(spark, n.rrf_term(F.lit(1)) + n.rrf_term(F.lit(1))), 6) == 0.032787
    assert one(spark, n.rrf_term(F.lit(None).cast("int"))) == 0.0


def test_day8(spark):
    got = spark.createDataFrame([("20240229",), ("29022024",), ("99999999",), ("2024",), (None,)], "x string").select(n.day8(F.col("x")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-02-29", "2024-02-29", None, None, None]


def test_citations(spark):
    a = "Да [3]. Нет [1][9] и [3]."
    assert one(spark, citations.used(F.lit(a), F.lit(4))) == [3, 1]
    assert one(spark, citations.renumbered(F.lit(a), F.lit(4))) == "Да [1]. Нет [2][9] и [1]."
    assert one(spark, citations.valid_share(F.lit(a), F.lit(4))) == 0.75
    assert one(spark, citations.valid_share(F.lit("x"), F.lit(4))) == 0.0


def test_strip_is_pythons(spark):
    for x in ("  a b ", "\x1c\x85a　", "", "​a"):
        assert one(spark, t.strip(F.lit(x))) == x.strip()


def test_shortened_and_first_line(spark):
    assert one(spark, t.shortened(F.lit("abc def"), 4)) == "abc…"
    assert one(spark, t.first_line(F.lit("\n  \n x \ny"))) == "x"
    assert one(spark, t.first_line(F.lit(" \n"))) is None


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    assert one(spark, n.unit(v)) == [0.6, 0.8]
    assert one(spark, n.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, n.sigmoid(F.lit(1e9))) == pytest.approx(1.0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 7]), max_size=8))
def test_renumbering_is_dense(spark, cited):
    a = " ".join(f"x[{c}]" for c in cited)
    got = spark.createDataFrame([(a,)], "a string").select(citations.renumbered(F.col("a"), F.lit(3)).alias("r")).select(citations.numbers(F.col("r"))).first()[0]
    order = list(dict.fromkeys(c for c in cited if c <= 3))
    # Marks without a source stay as they are.
    assert got == [order.index(c) + 1 if c <= 3 else c for c in cited]
