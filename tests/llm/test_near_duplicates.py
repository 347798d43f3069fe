import re

import numpy as np
import pytest

from sievework.llm import near_duplicates
from sievework.llm.near_duplicates import connected, group_pairs, near_duplicate_groups

SCHEMA = "doc_id bigint, title string, text string"


def shingles(row, words):
    w = re.findall(r"[^\W_]+", f"{row[1] or ''}\n{row[2]}".lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, threshold, least=0, out=()):
    docs = {r[0]: shingles(r, words) for r in rows if r[0] is not None and r[2] is not None and len(r[2]) >= least and r[0] not in out}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(docs[a] | docs[b])
            if union and len(docs[a] & docs[b]) >= threshold * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for d in ids:
        groups.setdefault(find(d), []).append(d)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = [f"с{i}" for i in range(900)]
    out, n = [], 0
    for family in range(30):
        base = list(rng.choice(words, 90))
        for k in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(rng.integers(0, 9))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            out.append((n, f"Письмо {family}", " ".join(t)))
            n += 1
        # Chains: every member is like its neighbours only.
        if family % 10 == 0:
            t = list(base)
            for k in range(5):
                for j in range(3):
                    t[(k * 13 + j * 4) % 90] = f"нов{k}{j}"
                out.append((n, None, " ".join(t)))
                n += 1
    out += [(n, "x", "одно и то же " * 30), (n + 1, "x", "одно и то же " * 50), (n + 2, "x", "мало"), (n + 3, None, None), (None, "x", "одно и то же " * 30), (n, "x", "одно и то же " * 30)]
    return out


def pairs(df):
    return {(r.doc_id_a, r.doc_id_b) for r in df.collect()}


def test_same_as_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(group_pairs(near_duplicate_groups(df, 3, 0.5))) == brute(rows, 3, 0.5)


def test_five_words_and_exclusion(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", group_id int, body int")
    gone = spark.createDataFrame([(0,), (5,)], "doc_id bigint")
    assert pairs(group_pairs(near_duplicate_groups(df, 5, 0.8, 300, gone))) == brute(rows, 5, 0.8, 300, {0, 5})


def test_hot_group(spark):
    """A third of all rows is one group of near copies, half of them exact."""
    base = " ".join(f"слово{i}" for i in range(80))
    rows = [(i, "t", base + (f" хвост{i}" if i % 2 else "")) for i in range(300)] + [(1000 + i, "t", " ".join(f"в{i}с{j}" for j in range(60))) for i in range(600)]
    groups = near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 3, 0.5).collect()
    assert {r.group_id for r in groups if r.doc_id < 1000} == {0} and len({r.group_id for r in groups}) == 601


def test_bridges_of_a_hot_group(spark):
    """Records at the edge of a hot group, like one or two of its members and not like the rest."""
    rng = np.random.default_rng(11)
    base = np.array([f"w{i}" for i in range(200)])
    hot = [(i, None, " ".join(rng.choice(base, 160, replace=False))) for i in range(300)]
    edge = [(1000 + i, None, " ".join(rng.choice(base, 100, replace=False))) for i in range(40)]
    rows = hot + edge
    want = brute(rows, 1, 0.5)
    assert len({b for _, b in want if b >= 1000}) >= 10  # held by single links
    assert pairs(group_pairs(near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 1, 0.5))) == want


def test_star(spark):
    """One record of 300 words and 200 of 174 of its words each: all similar to it, not to each other."""
    rng = np.random.default_rng(3)
    base = np.array([f"w{i}" for i in range(300)])
    rows = [(0, None, " ".join(base))] + [(1 + i, None, " ".join(rng.choice(base, 174, replace=False))) for i in range(200)]
    groups = near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 1, 0.5).collect()
    assert len(groups) == 201 and {r.group_id for r in groups} == {0}


def test_large_bucket_of_unlike_members(spark):
    """Records that share two fifths of their words, so every bucket holds hundreds of unlike
    ones; among them pairs just above the threshold and chains.  Recall against exact links."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(80)]
    rows, want, n = [], [], 0
    for i in range(3000):
        own = [f"o{i}x{j}" for j in range(120)]
        rows.append((n, None, " ".join(rng.permutation(common + own))))
        n += 1
        if i % 10 == 0:  # a chain of three: 200 words, 35 own ones changed at each step
            for k in range(2):
                own = own[35:] + [f"o{i}y{k}x{j}" for j in range(35)]
                rows.append((n, None, " ".join(rng.permutation(common + own))))
                want.append((n - 1, n))
                n += 1
    group = {r.doc_id: r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 1, 0.5).collect()}
    held = sum(group[a] == group[b] for a, b in want)
    print(len(group), len(set(group.values())), held, len(want))
    assert held >= 0.98 * len(want)
    assert len(set(group.values())) >= 3000


def test_by_key_beyond_the_limit(spark, rows, monkeypatch):
    """Nothing is sent along: every join is by key, the groups are the same."""
    monkeypatch.setattr(near_duplicates, "FEW", 0)
    assert pairs(group_pairs(near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), 3, 0.5))) == brute(rows, 3, 0.5)


def test_blocks_meet_once(spark, monkeypatch):
    """Every two members of different roots meet in one cell, however the bucket is cut."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    members = [(b, 100 * b + d, 100 * b + (0 if d < 14 else d // 2)) for b in (1, 2) for d in range(14 if b == 1 else 30)] + [(1, 199, 199)]
    cells = {}
    for r in near_duplicates._blocks(spark.createDataFrame(members, "bucket bigint, doc_id bigint, root bigint")).collect():
        cells.setdefault((r.bucket, r.i, r.j), []).append(r)
    met = []
    for (_, i, j), rows in cells.items():
        met += [tuple(sorted((x.doc_id, y.doc_id))) for n, x in enumerate(rows) for y in rows[n + 1 :] if (i == j or x.side != y.side) and x.root != y.root]
    assert len(met) == len(set(met))
    assert set(met) == {tuple(sorted((x[1], y[1]))) for x in members for y in members if x[0] == y[0] and x[2] != y[2]}


def test_empty(spark):
    assert near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_connected_long_path(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(3, 1), (2, 3), (7, 7)]
    got = {(r.node, r.root) for r in connected(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(1, 1), (2, 1), (3, 1)}
