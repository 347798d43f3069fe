"""Evaluation items that stand in training documents.

The words of each shard of the corpus, as numbers of the items' vocabulary, are indexed as an
FM-index: Burrows-Wheeler transform, wavelet matrix for ranks, sampled suffix positions.  All
runs of six words of the items are searched backward at once, their occurrences are located,
and occurrences on one diagonal of item and document are merged to runs.  A document is a case
for an item if a run holds the whole question, or if runs in the passage's order hold half of
its words within a stretch at most twice as long.

A document lies in one shard with all its words, so nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import tune_arrow
from sievework.sources import with_columns

RUN = 6
#: Words indexed at once by a task (about 100 MB of index).
SHARD_WORDS = 600_000
#: Characters of items searched in one pass over the corpus; more items take further passes.
BLOCK_CHARS = 20_000_000
SAMPLE = 4

WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
# Letters of Latin and Greek that look like Cyrillic ones, in lower case.
LOOK_ALIKE = str.maketrans("abcehikmoptuxyαβεηικμνορτυχѕјіё", "авсенікмортихуавенікмиортухsjіе")


#: A word as stored: hidden and combining characters may stand within.
_STORED = re.compile(rf"[^\W_](?:{_HIDDEN.pattern}*[^\W_])*{_HIDDEN.pattern}*")


def normal_word(word: str) -> str:
    return word.lower().translate(LOOK_ALIKE)


def words_of(text: str) -> list[str]:
    """Words as written: runs of letters and digits; hidden and combining characters removed."""
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return WORD.findall(text)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling on the ranks still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(new) - 1]
    step = 1
    while True:
        # A rank is the first place of its group; groups of one are settled.
        size = np.diff(np.append(starts, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        places = np.flatnonzero(tied)
        part = order[places]
        after = part + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[part]
        by = np.lexsort((second, first))
        part, first, second = part[by], first[by], second[by]
        order[places] = part
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[part] = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        new[places] = fresh
        starts = np.flatnonzero(new)
        step *= 2


class FMIndex:
    """Over a sequence of small numbers, of which 0 separates; patterns do not contain 0.

    Inside, all numbers are one higher, and a 0 of its own ends the sequence.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text, symbols = np.append(text + 1, 0), symbols + 1
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.sample = n, sample
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros, self.first = [], [], None
        seq = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            b = bit.astype(bool)
            seq = np.concatenate((seq[~b], seq[b]))
        marked = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(marked, dtype=np.int32))).astype(np.int32)
        self.kept = order[marked]

    def _begin(self, symbol: np.ndarray) -> np.ndarray:
        """Where the symbol's stretch begins on the last level."""
        at = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            one = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before ``upto`` in the transform."""
        at, begin = upto.astype(np.int64), np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones = self.ones[k]
            one_at, one_begin = ones[at], ones[begin]
            at = np.where(bit == 1, self.zeros[k] + one_at, at - one_at)
            begin = np.where(bit == 1, self.zeros[k] + one_begin, begin - one_begin)
        return at - begin

    def _symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, symbol = place.astype(np.int64), np.zeros(len(place), np.int64)
        begin = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            ones = self.ones[k]
            one_at, one_begin = ones[at], ones[begin]
            bit = ones[at + 1] - one_at
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + one_at, at - one_at)
            begin = np.where(bit == 1, self.zeros[k] + one_begin, begin - one_begin)
        return symbol, at - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows at once: [low, high) in suffix order."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, k].astype(np.int64) + 1
            low[live] = self.below[s] + self.rank(s, low[live])
            high[live] = self.below[s] + self.rank(s, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the next sampled one."""
        out = np.empty(len(places), np.int64)
        at, open_, steps = places.astype(np.int64), np.arange(len(places)), 0
        while len(open_):
            there = self.marks[at + 1] > self.marks[at]
            out[open_[there]] = self.kept[self.marks[at[there]]] + steps
            at, open_ = at[~there], open_[~there]
            if len(open_):
                s, r = self._symbol_and_rank(at)
                at = self.below[s] + r
            steps += 1
        return out


class Items:
    """Questions and passages as numbers of their own vocabulary, and their runs.

    ``patterns[n]`` are the runs of n words that are searched: of ``run`` words from longer
    items, and items of fewer words whole.  ``uses[n]`` has, for each, its items and places.
    """

    def __init__(self, rows: list[tuple[str, str | None, str | None]], run: int = RUN):
        self.run, self.vocabulary, self.texts = run, {}, []
        runs: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for item, query, passage in rows:
            for kind, text in ((0, query), (1, passage)):
                seq = [self.vocabulary.setdefault(normal_word(w), len(self.vocabulary) + 1) for w in words_of(text or "")]
                if not seq:
                    continue
                at, n = len(self.texts), min(run, len(seq))
                self.texts.append((item, kind, len(seq)))
                for i in range(len(seq) - n + 1):
                    runs.setdefault(n, {}).setdefault(tuple(seq[i : i + n]), []).append((at, i))
        self.patterns = {n: np.array(list(found), np.int64).reshape(-1, n) for n, found in runs.items()}
        self.uses = {n: list(found.values()) for n, found in runs.items()}
        self.shortest = min(runs, default=run)
        self.known: dict[str, int] = {}

    def numbers(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > 1_000_000:
            known.clear()
        for w in words_of(text):
            n = known.get(w)
            if n is None:
                n = known[w] = self.vocabulary.get(normal_word(w), 0)
            out.append(n)
        return out


def kept_positions(seq: np.ndarray, run: int) -> np.ndarray:
    """Positions in stretches of at least ``run`` known words, each with the place after it."""
    known = np.concatenate(([0], (seq > 0).astype(np.int8), [0]))
    edge = np.diff(known)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= run
    if not long.any():
        return np.empty(0, np.int64)
    return np.concatenate([np.arange(x, y + 1) for x, y in zip(a[long], b[long])])


def best_cover(runs: list[tuple[int, int, int]], length: int, reach: int) -> tuple[int, int, int]:
    """(words, begin, end): the most words of the item that runs hold in its order, within
    ``reach`` words of the document.  ``runs``: (document position, item position, words)."""
    runs = sorted(runs)
    best = (0, 0, 0)
    for first in range(len(runs)):
        begin = runs[first][0]
        # state: words held with run j last, using only runs at or after ``first``
        held: list[tuple[int, int, int]] = []
        for d, i, w in runs[first:]:
            w = min(w, begin + reach - d)
            if w < RUN:
                continue
            top = w if d == begin else 0
            for words, d_end, i_end in held:
                skip = max(0, d_end - d, i_end - i)  # what the run before holds already
                if w - skip > 0:
                    top = max(top, words + w - skip)
            if top:
                held.append((top, d + w, i + w))
                if top > best[0]:
                    best = (top, begin, d + w)
        if best[0] >= length:
            break
    return best


def _occurrences(index: FMIndex, items: Items, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of ``n`` words stand in the index, and (item, place) of their uses there."""
    low, high = index.search(items.patterns[n])
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    if not len(which):
        return np.empty(0, np.int64), np.empty((0, 2), np.int64)
    rows = np.repeat(low, size) + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    at = index.locate(rows)
    # One row for each use of the run in an item.
    uses = np.array([len(u) for u in items.uses[n]])
    flat = np.array([x for u in items.uses[n] for x in u])
    first = np.cumsum(uses) - uses
    count = uses[which]
    again = np.repeat(np.arange(len(which)), count)
    return at[again], flat[np.repeat(first[which], count) + np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)]


def _search(docs: list[tuple[int, np.ndarray]], items: Items) -> list[tuple[int, str, str, int, int, int]]:
    """(doc_id, item_id, part, words, begin, end) of one shard; begin and end in words."""
    run, seqs, places, owner = items.run, [], [], []
    for k, (_, seq) in enumerate(docs):
        keep = kept_positions(seq, items.shortest)
        if len(keep):
            seqs.append(np.append(seq, 0)[keep])
            places.append(keep)
            owner.append(np.full(len(keep), k))
    if not seqs or not items.patterns:
        return []
    text = np.concatenate(seqs).astype(np.int64)
    place, doc = np.concatenate(places), np.concatenate(owner)
    index, out = FMIndex(text, len(items.vocabulary)), []
    for n in items.patterns:
        if n < run:  # short items, each found whole
            at, use = _occurrences(index, items, n)
            for k, (t, _) in zip(at, use):
                item, kind, words = items.texts[t]
                out.append((docs[doc[k]][0], item, "passage" if kind else "query", words, int(place[k]), int(place[k]) + words))
    if run not in items.patterns:
        return out
    at, use = _occurrences(index, items, run)
    if not len(at):
        return out
    d, p, t, i = doc[at], place[at], use[:, 0], use[:, 1]
    # Neighbours on one diagonal are one run.
    by = np.lexsort((p, p - i, t, d))
    d, p, t, i = d[by], p[by], t[by], i[by]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] - i[1:] != p[:-1] - i[:-1]) | (p[1:] != p[:-1] + 1)))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(d)))
    d, p, t, i, w = d[begin], p[begin], t[begin], i[begin], count + run - 1
    kind = np.array([x[1] for x in items.texts])
    length = np.array([x[2] for x in items.texts])
    for k in np.flatnonzero((kind[t] == 0) & (w == length[t])):
        item = items.texts[t[k]]
        out.append((docs[d[k]][0], item[0], "query", int(w[k]), int(p[k]), int(p[k] + w[k])))
    # Passages: only where all runs together could hold half of the words.
    pair = d * len(items.texts) + t
    edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    total = np.add.reduceat(w, edge)
    stop = np.append(edge[1:], len(pair))
    enough = (kind[t[edge]] == 1) & (2 * total >= length[t[edge]])
    for a, b in zip(edge[enough], stop[enough]):
        item, _, words = items.texts[t[a]]
        top, begin_, end = best_cover([(int(x), int(y), int(z)) for x, y, z in zip(p[a:b], i[a:b], w[a:b])], words, 2 * words)
        if 2 * top >= words:
            out.append((docs[d[a]][0], item, "passage", top, begin_, end))
    return out


_FOUND = "doc_id bigint, item_id string, part string, words int, begin int, stop int"


def leaked_spans(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(doc_id, item_id, part, words, begin, stop): where items stand in documents.

    ``documents``: ``doc_id, text``; ``evaluation``: ``id, query, source_chunk.text``; other
    columns are ignored.  ``begin`` and ``stop`` count words of the document (runs of letters
    and digits); ``part`` is ``query`` or ``passage``.  Letter case, punctuation, white space
    and look-alike letters do not matter.

    Null or empty texts and null ids have no rows; questions or passages of fewer than six
    words are searched whole by the same index.  Repeated rows of documents or items give the
    same rows again, as one.  Empty tables give an empty result.
    """
    spark = documents.sparkSession
    tune_arrow(spark, 500)
    held = evaluation.select(F.col("id").alias("item_id"), "query", F.col("source_chunk.text").alias("passage")).filter("item_id is not null").distinct()
    size = held.agg(F.sum(F.coalesce(F.length("query"), F.lit(0)) + F.coalesce(F.length("passage"), F.lit(0)) + F.length("item_id"))).first()[0] or 0
    blocks = -(-int(size) // BLOCK_CHARS) or 1
    texts = with_columns(documents, "doc_id", "text").filter("doc_id is not null and text is not null and text <> ''")
    out = None
    for k in range(blocks):
        rows = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = Items([tuple(r) for r in rows.collect()])  # BLOCK_CHARS bounds what comes here
        found = texts.mapInArrow(_runner(spark.sparkContext.broadcast(items)), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _runner(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        docs: list[tuple[int, np.ndarray]] = []
        words = 0

        def found() -> pa.RecordBatch:
            cols = list(zip(*_search(docs, items))) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "part", "words", "begin", "stop"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq = np.array(items.numbers(text.as_py()), np.int64)
                docs.append((doc, seq))
                words += len(seq)
                if words >= SHARD_WORDS:
                    yield found()
                    docs, words = [], 0
        if docs:
            yield found()

    return run


def leaked_items(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item's question or passage."""
    return leaked_spans(documents, evaluation).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, removed): the documents of ``spans`` without the merged stretches."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    texts = with_columns(documents, "doc_id", "text").join(per_doc, "doc_id")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, found) -> str:
            # Places in the text as stored, which stays as it is around the stretches.
            where = [m.span() for m in _STORED.finditer(t)]
            merged: list[list[int]] = []
            for b, s in sorted((x["begin"], x["stop"]) for x in found):
                if merged and b <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s)
                else:
                    merged.append([b, s])
            for b, s in reversed(merged):
                t = t[: where[b][0]] + t[where[s - 1][1] :]
            return t

        return pd.Series([one(t, f) for t, f in zip(text, spans)], dtype=object)

    return texts.select("doc_id", cut("text", "spans").alias("text"), F.size("spans").alias("removed"))
