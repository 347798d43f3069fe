import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import bm25, chunkers, cleaning, dense, evaluate, experiments, extract, fusion, judging, lines, models, questions, registry


def ranked(spark, rels, hards=None):
    return spark.createDataFrame([("q", i + 1, bool(r), bool(h)) for i, (r, h) in enumerate(zip(rels, hards or [0] * len(rels)))], "query_id string, rank int, relevant boolean, hard_negative boolean")


def test_metrics_by_hand(spark):
    m = evaluate.metrics_at_k(ranked(spark, [0, 1, 0, 1], [1, 0, 1, 0]), (3,)).first()
    assert (round(m.precision, 6), m.hit, m.mrr, round(m.ndcg, 4)) == (0.333333, 1.0, 0.5, 0.6309)
    assert (m.hard_negatives, m.first_hard_negative) == (2, 1)


def test_metrics_are_bounded(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        for m in evaluate.metrics_at_k(ranked(spark, rng.integers(0, 2, 7)), (1, 3, 10)).collect():
            assert all(0 <= x <= 1 + 1e-9 for x in (m.precision, m.hit, m.mrr, m.ndcg)) and m.mrr <= m.hit


def texts(spark, n):
    return spark.createDataFrame([("q", i, str(i)) for i in range(1, n + 1)], "query_id string, rank int, text string")


@pytest.mark.parametrize(("order", "n", "want"), [("rerank_123", 6, "123456"), ("rerank_132", 6, "125634"), ("rerank_132", 5, "12534")])
def test_context_order(spark, order, n, want):
    rows = evaluate.context(texts(spark, n), order, 100, 1000).orderBy("number").collect()
    assert "".join(r.text for r in rows) == want
    assert [r.number for r in rows] == list(range(1, n + 1))


def test_context_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([("q", 1, "a" * 10), ("q", 2, "b" * 50), ("q", 3, "c")], "query_id string, rank int, text string")
    assert [r.rank for r in evaluate.context(rows, max_total=40).collect()] == [1]
    with pytest.raises(ValueError):
        evaluate.context(rows, "rerank_321")


def test_unknown_match_mode():
    with pytest.raises(ValueError):
        evaluate.match(F.col("t"), F.col("c"), "loose")


def test_rrf_does_not_depend_on_sides(spark):
    a = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2)], "query_id string, doc_id int, score double, rank int")
    b = spark.createDataFrame([("q", 2, 5.0, 1), ("q", 3, 4.0, 2)], "query_id string, doc_id int, score double, rank int")
    x, y = ([(r.doc_id, r.score) for r in fusion.rrf(*p).orderBy("rank").collect()] for p in ((a, b), (b, a)))
    assert x == y and x[0][0] == 2


def test_bm25_ignores_empty(spark):
    docs = spark.createDataFrame([(1, "налог налог ставка"), (2, ""), (3, None), (4, "ставка")], "doc_id bigint, text string")
    q = spark.createDataFrame([("q", "Налог"), ("e", "")], "query_id string, query string")
    got = bm25.bm25_topk(docs, q).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [("q", 1)]
    assert bm25.corpus_stats(docs).first().n_docs == 2


def test_dense_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(900, None)]
    points = spark.createDataFrame(rows, "doc_id bigint, vector array<float>").repartition(5)
    ask = points.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    whole = {(r.query_id, r.rank): r.doc_id for r in dense.dense_topk(points, ask, 5).collect()}
    parts = {(r.query_id, r.rank): r.doc_id for r in dense.dense_topk(points, ask, 5, block=3).collect()}
    assert whole == parts and all(whole[(q, 1)] == q for q, _ in whole)
    assert dense.dense_topk(points, ask.limit(0), 5).count() == 0


def pairs(spark, rows):
    return spark.createDataFrame([("m", h, j) for h, j in rows], "metric string, human int, judge int")


def test_kappa(spark):
    same = judging.agreement(pairs(spark, [(1, 1), (3, 3), (5, 5), (-1, 2)]), "metric").first()
    assert (same.n, same.exact, same.kappa, same.kappa_quadratic) == (3, 1.0, 1.0, 1.0)
    flat = judging.agreement(pairs(spark, [(5, 5), (5, 5)]), "metric").first()
    assert flat.kappa is None and flat.exact == 1.0
    mixed = judging.agreement(pairs(spark, [(1, 2), (2, 2), (3, 1), (1, 1)]), "metric").first()
    # By hand: observed 2/4; expected (2*2 + 1*2 + 1*0)/16 = 6/16.
    assert mixed.kappa == pytest.approx(1 - (2 / 4) / (10 / 16), abs=1e-6)


def test_labels(spark):
    rows = spark.createDataFrame([("q", "a", 0.9, True, True), ("q", "b", 0.1, False, True), ("q", "c", 0.95, False, False), ("q", "d", 0.2, False, False), ("q", "", 0.2, False, False)], "query_id string, point_id string, score double, is_source boolean, same_source boolean")
    assert {r.point_id: r.label for r in judging.fallback_labels(rows).collect()} == {"a": "relevant", "b": "hard_negative", "c": "hard_negative", "d": "irrelevant"}


def test_candidate_labels(spark):
    raw = 'x {"labels": [{"point_id": "p", "label": "relevant"}, {"point_id": "", "label": "relevant"}, {"point_id": "r", "label": "odd"}]}'
    assert spark.createDataFrame([(raw,)], "r string").select(judging.candidate_labels(F.col("r"))).first()[0] == {"p": "relevant"}


CASES = {
    "basic": ("Текст&nbsp;&nbsp;с  пробелами &amp; сущностями\r\n\r\nИ второй абзац.", "clean_basic"),
    "legal": ("Версия для печати\nПисьмо от 01.02.2024 № 5-1\nСтатья 12 закона\nПоделиться", "clean_legal"),
    "aggressive": ("Главная › Раздел\n*** --- ***\nшум на сайте где-то\nшум на сайте где-то\nСтатья 1\nСтатья 1", "clean_aggressive"),
}


def clean(spark, name):
    text, profile = CASES[name]
    return cleaning.cleaned(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), profile).first().text


def test_clean_basic(spark):
    got = clean(spark, "basic")
    assert got == "Текст с пробелами & сущностями\n\nИ второй абзац."


def test_clean_legal(spark):
    assert clean(spark, "legal") == "Письмо от 01.02.2024 № 5-1\nСтатья 12 закона"


def test_clean_aggressive(spark):
    assert clean(spark, "aggressive").count("шум") == 1 and clean(spark, "aggressive").count("Статья 1") == 2 and "***" not in clean(spark, "aggressive")


def test_clean_no_boilerplate(spark):
    rows = [(i, f"Тело {i} важно\nРассказать друзьям сейчас\nСтатья 12 Кодекса") for i in range(20)]
    got = cleaning.cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"), "clean_no_boilerplate").collect()
    assert all("Рассказать" not in r.text and "Статья 12" in r.text and "Тело" in r.text for r in got)


def test_cleaning_nulls_and_names(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    for p in cleaning.PROFILES:
        assert [r.text for r in cleaning.cleaned(df, p).collect()] == ["", ""]
    with pytest.raises(ValueError):
        cleaning.cleaned(df, "clean_all")


def test_split_lines_is_pythons(spark):
    for x in ("", "a", "a\n", "a\r\nb c\x0bd", "\n\n"):
        assert spark.createDataFrame([(x,)], "x string").select(lines.split_lines(F.col("x"))).first()[0] == x.splitlines()


def test_windows_cover(spark):
    text = "абв" * 50
    got = [r.text for r in chunkers.token_chunks(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), 40, 10).orderBy("chunk_i").collect()]
    assert got[0] + "".join(c[10:] for c in got[1:]) == text
    with pytest.raises(ValueError):
        chunkers.windows(F.col("x"), 5, 5)


@pytest.mark.parametrize("method", ["sentence", "recursive", "recursive_legal", "semantic", "ingest"])
def test_chunkers_keep_the_text(method):
    text = "\nСтатья 1 Первое предложение тут. Второе предложение; третье.\n\nПункт 2 " + "слово " * 60 + "x" * 90
    parts = chunkers.chunk_text(text, method, 80)
    assert all(len(p) <= 80 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_chunk_method_is_checked(spark):
    with pytest.raises(ValueError):
        chunkers.chunks(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "odd", 10)


def test_split_message():
    assert chunkers.split_message("a" * 4096) == ["a" * 4096]
    parts = chunkers.split_message(("b" * 1500 + "\n") * 4)
    assert all(len(p) <= 3800 for p in parts) and "".join(parts).replace("\n", "") == "b" * 6000


def test_point_id(spark):
    row = spark.createDataFrame([("s", "e")], "s string, e string")
    got = row.select(chunkers.point_id(F.col("s"), F.col("e"), F.lit("token"), F.lit(512), F.lit(64), F.lit(3))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "s:e:token:512:64:3"))


PAGE = """<html><head><title>Сайт</title><script>x()</script></head><body><div class="popup">окно</div><div class="page-content__center"><h1>Письмо  о</h1>
<p>Первый&nbsp;абзац<br>дальше</p><a href="/a?id=1">x</a><a href="/a?id=1">y</a></div><footer>низ</footer></body></html>"""


def test_extract(spark):
    mime = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=windows-1251\r\n\r\n" + "<p>Привет</p>".encode("cp1251") + b"\r\n--b--\r\n"
    rows = spark.createDataFrame([("u", PAGE.encode()), ("u", mime), ("u/x.xml?a", b"<a/>"), (None, None)], "url string, content binary")
    html, mhtml, xml, none = (r.page for r in extract.extracted(rows).collect())
    assert html.title == "Письмо о" and "Первый абзац\nдальше" in html.main and "низ" not in html.main and "окно" not in html.text and html.links == ["/a?id=1"]
    assert (mhtml.kind, mhtml.main) == ("mhtml", "Привет") and xml.kind == "xml" and none is None or none.kind is None


def test_registry(spark):
    reg = spark.createDataFrame([(1, "s", "a", "h1", 2, 0), (2, "s", "b", "h2", 1, 3)], "id bigint, source_code string, external_id string, content_sha256 string, qdrant_revision int, error_count int")
    for c in ("indexed_at", "next_check_at", "last_fetch_at"):
        reg = reg.withColumn(c, F.lit("2025-01-01").cast("timestamp"))
    for c in ("http_etag", "http_last_mod", "last_error"):
        reg = reg.withColumn(c, F.lit("old"))
    got = spark.createDataFrame([("s", "a", "h1", False), ("s", "b", "hX", False), ("s", "c", "h", False), ("s", "b", None, True)], "source_code string, external_id string, sha string, not_modified boolean")
    assert sorted((r.external_id, r.status) for r in registry.change_status(got, reg).collect()) == [("a", "SKIP_UNCHANGED"), ("b", "SKIP_NOT_MODIFIED"), ("b", "UPDATED"), ("c", "INGESTED")]
    changes = spark.createDataFrame([(2, "hX", None, None, 7, "UPDATED")], "id bigint, sha string, etag string, last_mod string, freq int, status string")
    r = registry.merged_content(reg, changes, F.lit("2025-02-01").cast("timestamp")).filter("id = 2").first()
    assert (r.content_sha256, r.qdrant_revision, r.indexed_at, r.http_etag, r.error_count, r.last_error) == ("hX", 2, None, "old", 0, None)
    bad = registry.marked_errors(reg, spark.createDataFrame([(2, "e" * 900, 7)], "id bigint, message string, freq int"), F.lit("2025-02-01").cast("timestamp")).filter("id = 2").first()
    assert bad.error_count == 4 and len(bad.last_error) == 500 and str(bad.next_check_at).startswith("2025-02-08")
    assert registry.insert_missing(reg.select("source_code", "external_id"), got.select("source_code", "external_id"), ["source_code", "external_id"]).count() == 3


def test_dimension_is_checked(spark):
    points = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>")
    with pytest.raises(Exception, match="vector size"):
        registry.assert_dimension(points, 2).collect()


def test_task_queue(spark):
    tasks = spark.createDataFrame([(1, 7, "pending", 5), (2, 7, "pending", 1), (3, 8, "pending", 9), (4, 8, "running", 10), (5, 9, "done", 1)], "id int, doc_id int, status string, priority int")
    assert sorted(r.id for r in registry.task_queue(tasks).collect()) == [2, 4]


def test_experiments(spark):
    log = spark.createDataFrame([(1, "a", "ok", 0.1), (2, "a", "ok", 0.3), (3, "b", "failed", 0.9), (4, "b", "ok", 0.0)], "position int, v string, status string, m double")
    assert sorted((r.v, r.m) for r in experiments.latest_runs(log, ["v"]).collect()) == [("a", 0.3), ("b", 0.0)]
    assert [r.position for r in experiments.plausible(log, ["m"]).orderBy("position").collect()] == [1, 2]
    assert experiments.markdown_rows(spark.createDataFrame([("x|y", None, 0.5)], "a string, b double, c double")).first().line == "| x\\|y | - | 0.5000 |"


def test_questions(spark):
    q = spark.createDataFrame([("1", "Какая ставка НДС на хлеб?"), ("2", "Какая ставка НДС на хлеб !"), ("3", "Когда платить взносы?")], "id string, query string")
    assert {r.id: r.kept for r in questions.greedy_distinct(q).collect()} == {"1": True, "2": False, "3": True}


def test_questions_in_blocks(spark, monkeypatch):
    words = "какая ставка налога на хлеб соль сахар дом землю доход срок уплаты взноса льгота".split()
    rng = np.random.default_rng(3)
    q = spark.createDataFrame([(f"{i:03d}", " ".join(rng.choice(words, 5)) + "?") for i in range(60)] + [("zz", "какая ставка налога на хлеб?")], "id string, query string")
    whole = sorted(tuple(r) for r in questions.greedy_distinct(q, 0.7).collect())
    monkeypatch.setattr(questions, "BLOCK", 11)
    assert sorted(tuple(r) for r in questions.greedy_distinct(q, 0.7).collect()) == whole
    assert any(not r[1] for r in whole)


def test_models(spark):
    rows = spark.createDataFrame([("налог на хлеб", "налог"), ("пени", "штраф"), (None, None)], "q string, t string")
    v = [r.vector for r in models.embedded(rows, "q", "hashing").collect()]
    assert v[2] is None and abs(sum(x * x for x in v[0]) - 1) < 1e-5
    assert [round(r.score_rerank, 3) for r in models.reranked(rows, "q", "t", "overlap").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        models.embedded(rows, "q", "absent")
    out = models.chatted(rows, "q", lambda ps: ["short"] * len(ps)).select(models.rewritten(F.col("q"), F.col("answer")).alias("r")).collect()
    assert out[0].r == "налог на хлеб"


def test_embedder_ranks_the_nearer_text_first(spark):
    run = models.EMBEDDERS["hashing"]()
    a, b, c = run(["срок уплаты налога", "налога срок новый", "погода летом"])
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    assert dot(a, b) > dot(a, c)


def test_failing_prompts_cost_no_other(spark):
    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "q string").coalesce(1)

    def chat(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    got = {r.q: (r.answer, r.answer_error) for r in models.chatted(rows, "q", chat).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no"), "c": ("C", None)}


def test_models_are_built_once_for_a_worker(spark):
    state = {"n": 0}

    def counted():
        state["n"] += 1
        return lambda queries, texts: [float(state["n"])] * len(queries)

    rows = spark.range(50).selectExpr("cast(id as string) as q", "'t' as t").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    models.RERANKERS["counted"] = counted
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # five batches
        assert {r.score_rerank for r in models.reranked(rows, "q", "t", "counted").collect()} == {1.0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        del models.RERANKERS["counted"]


def test_model_helpers():
    import numpy as np

    assert models.restored_order([(2, 0.5), (0, 0.1), (1, 0.3)], 3) == [0.1, 0.3, 0.5]
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (5, 2.0)]):
        with pytest.raises(ValueError):
            models.restored_order(bad, 2)
    pooled = models.mean_pooled(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(pooled, [[0.6, 0.8]])

    def broken():
        raise RuntimeError

    assert models.with_fallback(broken, models.EMBEDDERS["hashing"])()(["налог"])[0]


def test_generation_and_what_is_left_to_judge(spark):
    r = spark.createDataFrame([("1", "Q", "C")], "id string, query string, context string")
    out = models.generated(r, lambda ps: list(ps), "strict_citations").first()
    assert out.answer == "Cite every claim as [n].\n\nC\n\nQ" and out.prompt_variant == "strict_citations"
    j = spark.createDataFrame([("1", (("ok",), (None,))), ("2", None), ("3", (("ok_salvaged",), ("parse_failed",)))], "id string, judge struct<a: struct<status: string>, b: struct<status: string>>")
    left = lambda **k: sorted(tuple(x) for x in models.to_judge(j, ("a", "b"), **k).collect())
    assert left() == [("1", "b"), ("2", "a"), ("2", "b"), ("3", "b")] and len(left(force=True)) == 6
    t = spark.createDataFrame([("«Кто платит?»",), (' "x" ',)], "t string")
    assert [x[0] for x in t.select(models.unquoted(F.col("t"))).collect()] == ["Кто платит?", "x"]
    assert t.limit(1).select(models.required(F.col("t"), 3)).count() == 1
    with pytest.raises(Exception, match="too short"):
        t.select(models.required(F.col("t"), 100)).collect()


def test_reindex_replaces_documents(spark, tmp_path):
    from sievework.operators import matrices

    docs = spark.createDataFrame([(1, "s", "Срок уплаты налога. " * 100), (2, "s", "Налог на имущество."), (3, None, None)], "doc_id bigint, source string, text string")
    path = f"file://{tmp_path}/points"
    matrices.reindex(docs, None, path, 64)
    first = spark.read.parquet(path)
    assert {r.doc_id for r in first.collect()} == {1, 2} and first.filter("doc_id = 1").count() == 3
    matrices.reindex(docs.filter("doc_id = 1").withColumn("text", F.lit("Иной текст налога.")), spark.read.parquet(path), path, 64)
    again = {(r.doc_id, r.text) for r in spark.read.parquet(path).collect()}
    assert again == {(1, "Иной текст налога."), (2, "Налог на имущество.")}
    with pytest.raises(Exception, match="vector size"):
        matrices.reindex(docs, None, path, 128)


def test_judge_rates(spark):
    flags = ["should_abstain", "did_abstain", *sorted({c for c, _ in judging.RATES.values()} - {"should_abstain", "did_abstain", "abstention_aligned"})]
    rows = [[True, True, *[True] * (len(flags) - 2)], [True, False, *[False] * (len(flags) - 2)], [None] * len(flags)]
    r = judging.judge_rates(spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in flags))).first()
    assert (r.records, r.should_abstain_rate, r.did_abstain_rate, r.abstention_alignment_rate, r.unreadable_rate, r.raw_html_rate) == (3, 1.0, 0.5, 0.5, 0.5, 0.5)
