import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.leaks import FMIndex, leaked_items, leaked_spans, normal_word, suffix_array, without_leaks, words_of

EVAL = "id string, query string, source_chunk struct<text: string>"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120))
def test_suffix_array_and_search(seq):
    text = np.array(seq, np.int64)
    assert list(suffix_array(np.append(text + 1, 0))) == sorted(range(len(seq) + 1), key=lambda i: [*(x + 1 for x in seq[i:]), 0])
    index = FMIndex(text, 4, sample=3)
    patterns = np.array([[a, b] for a in range(1, 5) for b in range(1, 5)])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(seq) - 1) if (text[i : i + 2] == p).all()]


def vocabulary(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(1072 + c) for c in rng.integers(0, 32, 7)) for _ in range(n)]


QUERY = "Кто отвечает за ошибки, если ООО «Ромашка» подаёт уточнённую декларацию до 5 мая?"
PASSAGE = " ".join(vocabulary(1, 60))


def brute(doc, passage):
    """Most words of the passage in runs of six or more, in order, within twice its length."""
    d, p = ([normal_word(w) for w in words_of(x)] for x in (doc, passage))
    best = 0
    for start in range(len(d)):
        stop = min(len(d), start + 2 * len(p))
        score = np.zeros((stop - start + 1, len(p) + 1), int)
        for i in range(1, stop - start + 1):
            for j in range(1, len(p) + 1):
                score[i, j] = max(score[i - 1, j], score[i, j - 1])
                k = 0
                while k < min(i, j) and d[start + i - 1 - k] == p[j - 1 - k]:
                    k += 1
                    if k >= 6:
                        score[i, j] = max(score[i, j], score[i - k, j - k] + k)
        best = max(best, score[-1, -1])
        if best * 2 >= len(p):
            return True
    return False


def documents():
    w, noise = PASSAGE.split(), vocabulary(2, 400)
    half = noise[:20] + w[5:20] + noise[20:30] + w[30:46] + noise[30:50]
    swapped = w[30:46] + noise[:5] + w[0:15]  # not in the passage's order
    spread = w[0:16] + noise[:100] + w[40:56]
    short = noise[:30] + w[3:12] + noise[30:60]
    broken = [x if i % 5 else noise[i] for i, x in enumerate(w)]
    look = " ".join(w).upper().replace("А", "A").replace("О", "O").replace("Е", "E")
    texts = {1: " ".join(half), 2: " ".join(swapped), 3: " ".join(spread), 4: " ".join(short), 5: " ".join(broken), 6: f"Начало. {look} Конец", 7: f"x {QUERY.upper().replace('Ё', 'Е')} y", 8: QUERY[:60], 9: None, 10: "", 11: ", ".join(w[:31]), 12: " ".join(w[:29])}
    return texts


def test_found(spark):
    texts = documents()
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, PASSAGE)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", QUERY, (PASSAGE,)), ("b", None, None), ("c", "короткий вопрос", ("",)), (None, QUERY, (PASSAGE,)), ("a", QUERY, (PASSAGE,))], EVAL)
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()}
    want = {(d, "a") for d, t in texts.items() if t and brute(t, PASSAGE)} | {(7, "a")}
    assert got == want and {d for d, _ in got} == {1, 6, 7, 11}


def test_spans_are_cut(spark):
    texts = documents()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([("a", QUERY, (PASSAGE,))], EVAL)
    spans = leaked_spans(docs, items)
    out = {r.doc_id: r.text for r in without_leaks(docs, spans).collect()}
    assert out[6] == "Начало.  Конец" and out[7] == "x ? y"


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "Начало: какова СТАВКА налога? Конец"), (2, "какова ставка"), (3, "ставка налога"), (4, PASSAGE), (5, "ответ дан весной того года")], "doc_id bigint, text string")
    items = spark.createDataFrame([("s", "какова ставка налога", None), ("p", None, ("ответ дан весной",)), ("a", QUERY, (PASSAGE,))], EVAL)
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == {(1, "s"), (5, "p"), (4, "a")}


def test_items_in_blocks_and_null_questions(spark, monkeypatch):
    """Questions that are null count by their passages, and blocks of items change nothing."""
    from sievework.llm import leaks

    texts = documents()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([("a", QUERY, (PASSAGE,)), *((f"n{i}", None, (f"{PASSAGE} {i}",)) for i in range(5))], EVAL)
    whole = {tuple(r) for r in leaked_spans(docs, items).collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leaked_spans(docs, items).collect()} == whole and len({r[1] for r in whole}) == 6


def test_the_rest_stays_as_stored(spark):
    text = "При\u00adмер й é: " + PASSAGE + " — ко\u0301нец\u200b."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", QUERY, (PASSAGE,))], EVAL)
    assert [r.text for r in without_leaks(docs, leaked_spans(docs, items)).collect()] == [text.replace(PASSAGE, "")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, item_id string")
    assert leaked_items(docs, spark.createDataFrame([("a", QUERY, (PASSAGE,))], EVAL)).count() == 0
    full = spark.createDataFrame([(1, PASSAGE)], "doc_id bigint, text string")
    assert leaked_items(full, spark.createDataFrame([], EVAL)).count() == 0
