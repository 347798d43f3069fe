from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.packing import VOCABULARY, Tokenizer, first_fit_decreasing, packed

CONTAINERS = "container_id int, capacity_tokens int, separator_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    got, room, want = first_fit_decreasing(sizes, 20), [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        for k, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            k = len(room)
            room.append(20)
        room[k] -= sizes[i]
        want[i] = k
    assert list(got) == list(want)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer(Path(VOCABULARY).read_bytes())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="абв аяё.\n𐍈漢é​ 12", min_size=1, max_size=300), st.integers(4, 40))
def test_pieces_fit(tokenizer, text, capacity):
    tokens = np.array(tokenizer.encoding.encode_ordinary(text), np.int64)
    if len(tokens) <= capacity:
        return
    parts = tokenizer.pieces(text, tokens, capacity)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(tokenizer.count(text[a:b]) <= capacity and n <= capacity for a, b, n in parts)


def test_packed(spark, tokenizer):
    rng = np.random.default_rng(2)
    texts = [" ".join(["налог"] * int(n)) for n in rng.integers(1, 400, 150)] + ["", None, "длинный текст " * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, bin_no int")
    boxes = spark.createDataFrame([(1, 512, 2), (2, 256, None), (3, None, 1), (4, 0, 1)], CONTAINERS)
    rows = packed(docs, boxes, group_items=60).collect()
    for box, capacity, gap in ((1, 512, 2), (2, 256, 0)):
        bins, seen = {}, {}
        for r in (r for r in rows if r.container_id == box):
            bins.setdefault((r.group_no, r.bin_no), []).append(r.tokens)
            seen.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.stop))
        assert all(sum(b) + gap * (len(b) - 1) <= capacity for b in bins.values())
        for i, t in enumerate(texts):
            if t is None:
                assert i not in seen
                continue
            parts = sorted(seen[i])
            assert parts[0][1] == 0 and parts[-1][2] == len(t) and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
            assert len(parts) == 1 or tokenizer.count(t) > capacity
        used = sum(map(sum, bins.values()))
        assert used / (capacity * len(bins)) > 0.8
    assert {r.container_id for r in rows} == {1, 2}


def test_containers_in_blocks(spark, monkeypatch):
    from sievework.llm import packing

    docs = spark.createDataFrame([(i, "налог и сбор " * (i % 40)) for i in range(60)], "doc_id bigint, text string")
    boxes = spark.createDataFrame([(1, 128, 2), (2, 64, None), (3, 32, 1)], CONTAINERS)
    whole = {tuple(r) for r in packed(docs, boxes).collect()}
    monkeypatch.setattr(packing, "CONTAINERS", 1)
    assert {tuple(r) for r in packed(docs, boxes).collect()} == whole


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packed(docs, spark.createDataFrame([(1, 512, 2)], CONTAINERS)).count() == 0
