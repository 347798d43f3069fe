from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.splitting import Boundaries, cut, oversized, split_texts

text = st.text(alphabet="абв .!\n\r\té́𐍈", max_size=400)


@settings(max_examples=300, deadline=None)
@given(text, st.integers(1, 60), st.integers(0, 59))
def test_pieces(t, size, overlap):
    overlap %= size
    parts = cut(t, size, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(t)
    assert all(0 <= b - a <= size for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d
        if not overlap:
            assert c == b
        assert 0 <= b - c <= overlap


def test_natural_boundaries():
    t = ("Первое предложение здесь. Второе стоит рядом. " * 6 + "\n\n") * 8
    for a, b in cut(t, 400, 0)[:-1]:
        assert t[b - 1] in ".\n" or t[b - 1].isspace()


def test_edits_move_only_neighbours():
    import numpy as np

    rng = np.random.default_rng(1)
    words = ["слово" + str(i) for i in range(500)]
    t = " ".join(rng.choice(words, 6000)) + "."
    edited = t[:20000] + " вставка " + t[20000:]
    ends = {t[b - 40 : b] for _, b in cut(t, 600, 0)}
    again = {edited[b - 40 : b] for _, b in cut(edited, 600, 0)}
    assert len(ends - again) <= 12


def test_overlap_is_about_right():
    t = "слово и дело " * 2000
    parts = cut(t, 700, 100)
    assert all(80 <= b - c <= 100 for (_, b), (c, _) in zip(parts, parts[1:]))


def test_tables(spark):
    docs = spark.createDataFrame([(1, "а" * 25), (2, "б" * 10), (3, None), (None, "в" * 99), (4, ""), (1, "а" * 25), (5, "г " * 200_000)], "doc_id bigint, text string")
    confs = spark.createDataFrame([(1, 10, 3), (2, None, 1), (3, 10, 10), (4, 10, None), (5, 0, 0), (6, 10, -1), (None, 5, 1)], "config_id int, chunk_size int, chunk_overlap int")
    assert {(r.config_id, r.doc_id) for r in oversized(docs, confs).collect()} == {(1, 1), (1, 5), (4, 1), (4, 5)}
    pieces = split_texts(docs, confs).filter("doc_id = 4 or doc_id = 2").collect()
    assert sorted((r.config_id, r.doc_id, r.piece) for r in pieces) == [(1, 2, "б" * 10), (1, 4, ""), (4, 2, "б" * 10), (4, 4, "")]
    whole = "".join(r.piece for r in split_texts(docs.filter("doc_id = 5"), confs).filter("config_id = 4").orderBy("piece_no").collect())
    assert whole == "г " * 200_000
    assert split_texts(docs.limit(0), confs).count() == 0 and split_texts(docs, confs.limit(0)).count() == 0


def test_configurations_in_blocks(spark, monkeypatch):
    from sievework.llm import splitting

    docs = spark.createDataFrame([(i, "слово и дело. " * i) for i in range(20)], "doc_id bigint, text string")
    confs = spark.createDataFrame([(1, 10, 3), (2, 30, 1), (3, 50, 10)], "config_id int, chunk_size int, chunk_overlap int")
    whole = {tuple(r) for r in split_texts(docs, confs).collect()}
    monkeypatch.setattr(splitting, "CONFIGS", 1)
    assert {tuple(r) for r in split_texts(docs, confs).collect()} == whole


def test_invariants_against_sql(spark, sf):
    from sievework.llm import queries
    from tests.oracle import check

    for name in ("p4_invariants", "p6_invariants"):
        check(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_boundaries_of_nothing():
    b = Boundaries("")
    assert len(b.hashes) == 1
