import re

from sievework.llm import queries
from sievework.llm.site_lines import LineCounts, cleaned_by_deltas, repeated_lines, without_lines
from sievework.sources import load
from tests.oracle import check

SCHEMA = "doc_id bigint, source_code string, text string"


def brute(rows, least=5, share=0.2):
    docs = {d: (s, t) for d, s, t in rows if d is not None}
    key = lambda x: "".join(c for c in x.lower().replace("ё", "е") if c.isalpha())
    size, held = {}, {}
    for d, (s, t) in docs.items():
        size[s] = size.get(s, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((s, k), set()).add(d)
    cases = {k for k, v in held.items() if len(v) >= least and len(v) >= share * size[k[0]]}
    return {(d, i) for d, (s, t) in docs.items() for i, x in enumerate((t or "").split("\n")) if (s, key(x)) in cases}


def corpus(n=40):
    rows = []
    for i in range(n):
        s = ["a", "b", None][i % 3]
        word = "".join(chr(1072 + (i * 7 + j) % 32) for j in range(9))
        rows.append((i, s, f"{word} {i}\nПоделитесь № {i}!\n" + ("Ещё строка\r\n" if i % 2 else "") + "  \n12345"))
    return rows + [(3, *corpus_row(rows, 3)), (900, "a", None), (901, "a", ""), (None, "a", "Поделитесь"), (902, "c", "x\n" * 3000)]


def corpus_row(rows, i):
    return rows[i][1:]


def got(df):
    return {(r.doc_id, r.line_no) for r in df.collect()}


def test_same_as_brute_force(spark):
    rows = corpus()
    # A null source is a source of its own here as there.
    assert got(repeated_lines(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(*r, 1, "k") for r in corpus()], SCHEMA + ", line_no int, key string")
    assert got(repeated_lines(df)) == brute(corpus())


def test_deltas_give_the_same(spark):
    rows = corpus(60)
    state = LineCounts(spark)
    for part in (rows[:20], rows[20:22], [], rows[15:50], rows[50:]):
        state.merge(spark.createDataFrame(part, SCHEMA))
        state = LineCounts.resume(spark, state.save())
    assert got(state.occurrences()) == brute(rows)
    state.drop()


def test_merge_names_what_must_be_rebuilt(spark):
    first = [(i, "s", "одно\nдругое" if i < 4 else f"стр{'аб'[i % 2] * i}") for i in range(10)]
    state = LineCounts(spark)
    assert state.merge(spark.createDataFrame(first, SCHEMA)).count() == 0
    moved = state.merge(spark.createDataFrame([(20, "s", "одно")], SCHEMA)).collect()
    # The fifth record makes the line a case in the four before it too.
    assert {r.doc_id for r in moved} == {0, 1, 2, 3, 20} and all(r.now and not r.was for r in moved)
    # Many records without the line take it below a fifth again.
    fall = state.merge(spark.createDataFrame([(100 + i, "s", "строка " + "в" * (i + 1)) for i in range(30)], SCHEMA)).collect()
    assert {r.doc_id for r in fall} == {0, 1, 2, 3, 20} and all(r.was and not r.now for r in fall)


def test_texts_without_lines(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    state = LineCounts(spark)
    state.merge(df)
    out = {r.doc_id: r.text for r in without_lines(df, state).collect()}
    assert out[900] is None and out[901] == "" and "Поделитесь" not in out[0] and re.search(r"\w+ 0", out[0])


def test_cleaned_by_deltas_is_as_cleaned_at_once(spark):
    rows = [r for n, r in enumerate(corpus(60)) if r[0] != 3 or n == 3] + [(2000 + i, "s", f"редкое\nстр{'аб'[i % 2] * i}" if i < 5 else "строка " + "в" * i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    state = LineCounts(spark)
    state.merge(df)
    want = sorted((r.doc_id, r.text or "") for r in without_lines(df, state).collect())
    for deltas in (1, 5):
        assert sorted((r.doc_id, r.text or "") for r in cleaned_by_deltas(df, deltas).collect()) == want


def test_changed_records_take_the_place_of_earlier_ones(spark):
    first = [(i, "s" if i < 8 else "t", "общая строка\nодин") for i in range(14)]
    later = [(0, "s", "совсем другое"), (1, "t", "общая строка\nодин"), (2, "s", "общая строка\nодин"), (3, None, None)]
    state = LineCounts(spark)
    for part in (first, later, later, [(3, "s", "один")]):
        state.merge(spark.createDataFrame(part, SCHEMA))
        state = LineCounts.resume(spark, state.save())
    rows = {r[0]: r for r in first} | {r[0]: r for r in later} | {3: (3, "s", "один")}
    assert got(state.occurrences()) == brute(list(rows.values()))
    assert state.records().count() == 14


def test_a_failed_merge_can_be_repeated(spark, monkeypatch):
    rows = corpus(60)
    state = LineCounts(spark)
    state.merge(spark.createDataFrame(rows[:30], SCHEMA))
    exists, calls = LineCounts._exists, []

    def failing(self, path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("lost")
        return exists(self, path)

    monkeypatch.setattr(LineCounts, "_exists", failing)
    try:
        state.merge(spark.createDataFrame(rows[30:], SCHEMA))
    except OSError:
        state.merge(spark.createDataFrame(rows[30:], SCHEMA))
    assert len(calls) > 1 and got(state.occurrences()) == brute(rows)


def test_by_key_beyond_the_limit(spark, monkeypatch):
    from sievework.llm import site_lines

    monkeypatch.setattr(site_lines, "FEW", 0)
    rows = [r for n, r in enumerate(corpus(60)) if r[0] != 3 or n == 3]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repeated_lines(df)) == brute(rows)
    by_key = {r.doc_id: r.text for r in cleaned_by_deltas(df).collect()}
    monkeypatch.setattr(site_lines, "FEW", 200_000)
    assert {r.doc_id: r.text for r in cleaned_by_deltas(df).collect()} == by_key


def test_p1_queries_merge_deltas(spark, sf, monkeypatch):
    sizes, merge = [], LineCounts.merge
    monkeypatch.setattr(LineCounts, "merge", lambda self, records: sizes.append(records.count()) or merge(self, records))
    for query in (queries.p1_found, queries.p1_cleaned):
        sizes.clear()
        query(spark, sf)
        assert len(sizes) > 1 and all(sizes) and sum(sizes) == load(spark, sf, "local_document").filter("doc_id is not null").count()


def test_queries_against_sql(spark, sf):
    for name in ("p1_found", "p1_cleaned", "p4_found"):
        check(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
