from pyspark.sql import functions as F

from sievework.operators import reports

SOURCES = "array<struct<source_code: string, external_id: string, title: string, canonical_url: string>>"


def final(spark, answer, sources, **more):
    row = spark.createDataFrame([(answer, sources)], f"a string, s {SOURCES}")
    return row.select(reports.final_answer(F.col("a"), F.col("s"), F.create_map(F.lit("m"), F.lit("Письмо <М>")), F.create_map(F.lit("k"), F.lit("http://k/?a&b")), ("k",), **more)).first()[0]


def test_final_answer(spark):
    sources = [("m", "x_ot_01.02.2024_7", "T", "u"), ("k", "9", "День уплаты", None), ("k", "9", "Минфин", ""), (None, None, None, None)]
    got = final(spark, "Да [2], нет [7] и [1].\n\nИсточники:\n[2] что-то", sources)
    assert got == "Да [1], нет [7] и [2].\n\nИсточники:\n[1] k (День уплаты)\n   http://k/?a&b\n[2] Письмо <М> (от 01.02.2024)\n   u"
    assert final(spark, "A < B [1][3][4]", sources, html=True) == 'A &lt; B [1][2][3]\n\nИсточники:\n[1] <a href="u">Письмо &lt;М&gt; (от 01.02.2024)</a>\n[2] <a href="http://k/?a&amp;b">k</a>\n[3] Источник'
    assert final(spark, "Без ссылок", []) == "Без ссылок" and final(spark, None, None) is None
    for heading in ("## Источники", "**Источники**", "1. Источники", "Источник:", "- источники использованные"[:11] + ":"):
        assert final(spark, f"Да.\n{heading}\n[1] x", sources) == "Да.", heading
    assert final(spark, "Да.\nИсточник дохода не важен.", sources) == "Да.\nИсточник дохода не важен."


def test_review_preview(spark):
    kind = "array<struct<rank: int, text: string, relevance_label: string>>"
    row = spark.createDataFrame([([(1, "x" * 600, "unknown"), (2, " y ", "unknown"), (3, "z", "gold_relevant")],)], f"r {kind}")
    got = row.select(reports.preview(F.col("r"), "unknown")).first()[0]
    assert got == f"[1] {'x' * 500}...\n\n[2] y"


def test_source_chunk_comes_first(spark):
    c = spark.createDataFrame([("q", "a", 1)], "q string, d string, rank int")
    s = spark.createDataFrame([("q", "a"), ("q2", "b")], "q string, d string")
    assert sorted(tuple(r) for r in reports.with_source_chunk(c, s, ["q", "d"]).collect()) == [("q", "a", 1), ("q2", "b", 0)]


def test_rewrites(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query string")
    r = spark.createDataFrame([("a", "A")], "before string, after string")
    assert sorted(x.search_query for x in reports.with_rewrites(q, r).collect()) == ["A", "b"]
    assert reports.rewrite_rate(r.limit(0)).first().rate == 0.0


def test_review_sheet_with_few_sources(spark):
    item = "struct<rank: int, source_code: string, external_id: string, chunk_i: string, canonical_url: string, text: string, relevance_label: string>"
    kind = f"id string, query string, answer string, retrieved array<{item}>, retrieval_gold_summary struct<gold_relevant_ranks: array<int>, has_gold_relevant_context: boolean>, human struct<precision: int, completeness: int, format: int, comment: string>"
    rows = [("a", "q", None, [(1, "s", None, "2", "u", "t", "unknown")], ([1, 2], True), (3, None, -1, None)), ("b", "q", "x", None, None, None), ("c", "q", "x", [], None, None)]
    a, b, c = reports.review_sheet(spark.createDataFrame(rows, kind)).orderBy("id").collect()
    assert a.source_1 == "rank=1; source_code=s; external_id=None; chunk_i=2; url=u" and a.source_2 == "" and a.gold_relevant_ranks == "1,2"
    assert (a.human_precision, a.human_completeness, a.answer) == (3, -1, "") and b.source_1 == c.source_1 == "" and b.unknown_context_preview == ""
