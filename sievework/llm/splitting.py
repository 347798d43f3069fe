"""Cutting texts above a size at natural boundaries, by content.

A rolling hash over the characters before each place makes landmarks.  The end of a piece is
looked for between a least and the largest size: the landmark of the highest hash there is
snapped to the nearest end of a paragraph, else of a sentence, else of a word.  The places
chosen depend on the text around them, not on its beginning, so an edit moves only the pieces
next to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import tune_arrow
from sievework.sources import with_columns

#: Characters the rolling hash looks back.
WINDOW = 32
#: Configurations are sent to every task; more than so many take further passes.
CONFIGS = 10_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PARAGRAPH = re.compile(r"\r?\n(?:[ \t ]*\r?\n)*")
_SENTENCE = re.compile(r"[.!?…]+[»”\"')\]]*(?=\s)")
_SPACE = re.compile(r"\s+")
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have)
    return have[:n]


def landmark_hashes(code: np.ndarray) -> np.ndarray:
    """For each place 0..n the hash of the WINDOW characters before it."""
    n = len(code)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _power("b", _BASE, n), dtype=np.uint64)))
    begin = np.maximum(np.arange(n + 1) - WINDOW, 0)
    h = (total - total[begin]) * _power("i", _INVERSE, n + 1)[begin]
    h ^= h >> np.uint64(32)
    h *= _BASE
    return h ^ (h >> np.uint64(29))


class Boundaries:
    """Places where a text may be cut, by kind, best first."""

    def __init__(self, text: str):
        self.paragraphs = np.array([m.end() for m in _PARAGRAPH.finditer(text)], np.int64)
        self.sentences = np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)
        self.words = np.array([m.end() for m in _SPACE.finditer(text)], np.int64)
        # A sentence begins after the white space that follows the end of the one before.
        after = self.words.searchsorted(self.sentences, "right")
        self.starts = self.words[after[after < len(self.words)]]
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hashes = landmark_hashes(self.code)

    def end(self, low: int, high: int) -> int:
        """The end of a piece in [low, high]."""
        mark = low + int(self.hashes[low : high + 1].argmax())
        for places in (self.paragraphs, self.sentences, self.words):
            if (at := _nearest(places, mark, low, high)) >= 0:
                return at
        # An unbroken run: at the landmark, but not before a combining mark or within CR LF.
        at = mark
        while at > low and (0x300 <= self.code[at] <= 0x36F or self.code[at] == 10 and self.code[at - 1] == 13):
            at -= 1
        return at

    def begin(self, low: int, high: int) -> int:
        """The start of an overlap: the first one of a paragraph, sentence or word in
        [low, high], else ``low``."""
        for places in (self.paragraphs, self.starts, self.words):
            if (at := _nearest(places, low, low, high)) >= 0:
                return at
        return low


def _nearest(places: np.ndarray, mark: int, low: int, high: int) -> int:
    i = int(places.searchsorted(mark))
    best = -1
    if i < len(places) and low <= places[i] <= high:
        best = int(places[i])
    if i and low <= places[i - 1] <= high and (best < 0 or mark - places[i - 1] <= best - mark):
        best = int(places[i - 1])
    return best


def cut(text: str, size: int, overlap: int, bounds: Boundaries | None = None) -> list[tuple[int, int]]:
    """[start, stop) of the pieces, in code points; the whole text if it is not above ``size``.

    Every piece has at most ``size`` characters, all together cover the text, and each after
    the first begins at most ``overlap`` characters before the end of the one before, and at
    least four fifths of that: where a paragraph, a sentence or a word begins there, else
    ``overlap`` characters before it.
    """
    n = len(text)
    if n <= size:
        return [(0, n)]
    bounds = bounds or Boundaries(text)
    out, start, stop = [], 0, 0
    while True:
        high = start + size
        if high >= n:
            out.append((start, n))
            return out
        low = max(stop + 1, start + (size + overlap) // 2 + 1)
        stop = bounds.end(min(low, high), high)
        out.append((start, stop))
        start = stop
        if overlap:
            # A piece is longer than its overlap, so every piece gets further than the one before.
            start = bounds.begin(stop - overlap, stop - overlap + overlap // 5)


def split_texts(records: DataFrame, configs: DataFrame, with_text: bool = True) -> DataFrame:
    """(config_id, doc_id, piece_no, start, stop[, piece]) of every record and usable row.

    ``records``: ``doc_id, text``; ``configs``: ``config_id, chunk_size, chunk_overlap``; other
    columns are ignored.  A row is usable if its size is not null and above 0 and its overlap
    (null: 0) is at least 0 and below the size.  Sizes count code points.

    Null ids and null texts have no pieces; an empty text is one empty piece, and a text not
    above the size is one whole piece.  Repeated rows give their pieces once for each row.
    Empty tables give an empty result.
    """
    tune_arrow(records.sparkSession, 500)
    usable = with_columns(configs, "config_id", "chunk_size", "chunk_overlap").select("config_id", "chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("overlap")).filter("config_id is not null and chunk_size > 0 and overlap >= 0 and overlap < chunk_size").distinct()
    blocks, out = max(1, -(-usable.count() // CONFIGS)), None
    for k in range(blocks):
        part = usable if blocks == 1 else usable.filter(F.pmod(F.xxhash64("config_id", "chunk_size", "overlap"), F.lit(blocks)) == k)
        found = _split(records, [tuple(r) for r in part.collect()], with_text)
        out = found if out is None else out.unionByName(found)
    return out


def _split(records: DataFrame, rows: list[tuple[int, int, int]], with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            config, doc, number, start, stop, piece = [], [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                bounds = Boundaries(text) if any(len(text) > size for _, size, _ in rows) else None
                for c, size, overlap in rows:
                    for k, (a, b) in enumerate(cut(text, size, overlap, bounds)):
                        config.append(c)
                        doc.append(d)
                        number.append(k)
                        start.append(a)
                        stop.append(b)
                        if with_text:
                            piece.append(text[a:b])
            cols = [pa.array(config, pa.int32()), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (number, start, stop))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(piece, pa.string())] * with_text, names)

    names = ["config_id", "doc_id", "piece_no", "start", "stop"] + ["piece"] * with_text
    schema = "config_id int, doc_id bigint, piece_no int, start int, stop int" + ", piece string" * with_text
    return with_columns(records, "doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, schema)


def oversized(records: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, doc_id) of the records that are cut: those with a second piece."""
    return split_texts(records, configs, with_text=False).filter(F.col("piece_no") == 1).select("config_id", "doc_id").distinct()
