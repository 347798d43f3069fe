import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm.subjects import fit, score, subject_areas

AREAS = {"vat": "налог вычет счетфактура продавец ставка покупатель", "sport": "матч тренер стадион команда игрок турнир", "agro": "посев урожай ферма зерно трактор молоко"}


def text(rng, codes, sentences, mentions=()):
    plan = [c for c in codes for _ in range(sentences)] + list(mentions)
    out = []
    for c in plan:
        out.append(" ".join([*rng.choice(AREAS[c].split(), 5), *rng.choice(["филиал", "договор", "письмо", "срок"], 3)]) + ".")
    return " ".join(out) + " Ответ отправлен заявителю."


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    names, rows = list(AREAS), []
    for i in range(n):
        codes = list(rng.choice(names, 1 + (i % 4 == 0), replace=False))
        other = [c for c in names if c not in codes]
        rows.append((seed * 10_000 + i, text(rng, codes, 5, other[:1] if i % 3 == 0 else ()), codes))
    return rows


def test_held_out(spark):
    train, held = corpus(1, 400), corpus(2, 100)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in train + held] + [(1, None, "x"), (None, "матч.", "x"), (2, "", "x"), (3, "12 34", "x")], "doc_id bigint, text string, subject_code string")
    rng = np.random.default_rng(9)
    labels = [(d, c.upper() if rng.random() < 0.1 else c) for d, _, codes in train for c in codes if rng.random() > 0.05]
    labels += [(d, str(rng.choice(list(AREAS)))) for d, _, _ in train[:15]] + labels[:20] + [(None, "vat"), (train[0][0], None), (train[0][0], "odd")]
    areas = spark.createDataFrame([(c,) for c in AREAS] + [(None,)], "subject_code string")
    got = {(r.doc_id, r.subject_code) for r in subject_areas(docs, spark.createDataFrame(labels, "doc_id bigint, subject_code string"), areas).collect()}
    want = {(d, c) for d, _, codes in held for c in codes}
    mine = {x for x in got if x[0] // 10_000 == 2}
    assert len(mine & want) / len(mine) > 0.95 and len(mine & want) / len(want) > 0.95
    assert not {1, 2, 3, None} & {d for d, _ in got}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "матч.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject_code string")
    areas = spark.createDataFrame([("vat",)], "subject_code string")
    assert fit(docs, labels, areas) is None and subject_areas(docs, labels, areas).count() == 0


def test_too_many_areas_are_an_error(spark):
    docs = spark.createDataFrame([(1, "матч.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "a0")], "doc_id bigint, subject_code string")
    with pytest.raises(ValueError, match="more than 1000 subject areas"):
        fit(docs, labels, spark.createDataFrame([(f"a{i}",) for i in range(1001)], "subject_code string"))


def test_empty_documents(spark):
    rows = corpus(1, 60)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, c) for d, _, codes in rows for c in codes], "doc_id bigint, subject_code string")
    model = fit(docs, labels, spark.createDataFrame([(c,) for c in AREAS], "subject_code string"))
    assert score(docs.filter(F.lit(False)), model).count() == 0


def test_draw_is_bounded_and_of_both_scripts(spark):
    from sievework.llm.subjects import training_rows

    docs = spark.createDataFrame([(i, "english words only here" if i % 10 == 0 else "слова по-русски здесь") for i in range(200)] + [(7, "слова по-русски здесь")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "vat") for i in range(200)], "doc_id bigint, subject_code string")
    rows = training_rows(docs, labels, ["vat"], 30).collect()
    assert len(rows) == 30 and len({r.doc_id for r in rows}) == 30 and sum(r.doc_id % 10 == 0 for r in rows) == 10
