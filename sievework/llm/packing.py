"""Filling containers of fixed capacity with texts sized in tokens.

Texts are sized once with a public tokenizer; a text above a capacity is cut into pieces at
word boundaries.  Items are dealt into random groups of bounded size, and each group is packed
by itself with first-fit decreasing: a tournament tree over the room left in the bins finds
the first bin an item fits into in logarithmic time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.sources import with_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public vocabulary's tokenizer parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a group, on average; more room is left over the smaller groups are.
GROUP_ITEMS = 20_000
#: Containers are sent to every task; more than so many take further passes.
CONTAINERS = 1_000


class Tokenizer:
    """Byte-level pairs from a vocabulary of ranks; built where it is used."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.length, self.opens, self.whole = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
        for token, i in ranks.items():
            self.length[i] = len(token)
            self.opens[i] = token[:1] in (b" ", b"\n", b"\t", b"\r")
            self.whole[i] = not 0x80 <= token[0] < 0xC0

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def pieces(self, text: str, tokens: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
        """(start, stop, tokens) in code points: cuts of a text with more tokens than fit."""
        whole = np.flatnonzero(self.whole[tokens])
        words = np.flatnonzero(self.opens[tokens])
        offset = np.concatenate(([0], np.cumsum(self.length[tokens])))
        raw = text.encode()
        # Code points before each byte: a byte that does not continue one begins one.
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        points = np.concatenate(([0], np.cumsum(first)))
        out, a, n = [], 0, len(tokens)
        while a < n:
            if n - a <= capacity:
                b, safe = n, True
            else:
                i = int(words.searchsorted(a + capacity, "right")) - 1
                safe = i >= 0 and words[i] > a + capacity // 2
                if not safe:
                    i = int(whole.searchsorted(a + capacity, "right")) - 1
                    safe_cut = i >= 0 and whole[i] > a
                b = int(words[i] if safe else whole[i] if safe_cut else a + capacity)
            start, stop = int(points[offset[a]]), int(points[offset[b]])
            size = b - a
            # Within a word the pieces' own tokens may differ from those of the whole.
            while not safe and (size := self.count(text[start:stop])) > capacity:
                stop -= max(1, (stop - start) // 50)
            if not safe:
                b = int(offset.searchsorted(len(text[:stop].encode())))
                if offset[b] != len(text[:stop].encode()):  # not at a token: the rest is sized anew
                    out.append((start, stop, size))
                    rest = np.array(self.encoding.encode_ordinary(text[stop:]), np.int64)
                    return out + ([(stop, len(text), len(rest))] if len(rest) <= capacity else [(stop + x, stop + y, z) for x, y, z in self.pieces(text[stop:], rest, capacity)])
            out.append((start, stop, size))
            a = b
        return out


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items are taken from the largest, ties in the given order."""
    n = len(sizes)
    width = 1
    while width < n:
        width *= 2
    tree = [0] * (2 * width)  # the most room of any bin below
    bins, used = np.zeros(n, np.int64), 0
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        if tree[1] < size or not used:
            spot, room = used, capacity
            used += 1
            node = spot + width
        else:
            node = 1
            while node < width:
                node *= 2
                if tree[node] < size:
                    node += 1
            spot, room = node - width, tree[node]
        bins[item] = spot
        tree[node] = room - size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left >= right else right
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins


def sized_items(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece_no, start, stop, tokens): what must be placed."""
    tune_arrow(documents.sparkSession, 500)
    ranks = Path(vocabulary).read_bytes()  # under 1 MB; executors need no file of their own
    usable = with_columns(containers, "container_id", "capacity_tokens").filter("container_id is not null and capacity_tokens > 0").dropDuplicates(["container_id"])
    blocks, out = max(1, -(-usable.count() // CONTAINERS)), None
    for k in range(blocks):
        part = usable if blocks == 1 else usable.filter(F.pmod(F.xxhash64("container_id"), F.lit(blocks)) == k)
        found = _sized(documents, [tuple(r) for r in part.collect()], ranks)
        out = found if out is None else out.unionByName(found)
    return out


def _sized(documents: DataFrame, capacities: list[tuple[int, int]], ranks: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                tokens = tokenizer.encoding.encode_ordinary(text)
                array = None
                for container, capacity in capacities:
                    if len(tokens) <= capacity:
                        cuts = [(0, len(text), len(tokens))]
                    else:
                        array = np.array(tokens, np.int64) if array is None else array
                        cuts = tokenizer.pieces(text, array, capacity)
                    for k, (a, b, size) in enumerate(cuts):
                        for column, x in zip(out, (container, doc, k, a, b, size)):
                            column.append(x)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["container_id", "doc_id", "piece_no", "start", "stop", "tokens"])

    texts = with_columns(documents, "doc_id", "text").filter("doc_id is not null and text is not null")
    return texts.mapInArrow(run, "container_id int, doc_id bigint, piece_no int, start int, stop int, tokens int")


def packed(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """(container_id, group_no, bin_no, doc_id, piece_no, start, stop, tokens).

    For each container every text is placed exactly once: whole if it fits into the capacity,
    else in pieces ``start`` to ``stop`` (code points) that each fit.  Between two items of a
    bin ``separator_tokens`` (null: 0) are spent.  ``bin_no`` counts within the group.

    ``documents``: ``doc_id, text``, doc_id unique: a repeated row is placed again.  Null ids
    and null texts are not placed; an empty text is an item without tokens.  Containers without
    a positive capacity are left out.  Empty tables give an empty result.
    """
    items = durable(sized_items(documents, containers, vocabulary), "items")
    sizes = with_columns(containers, "container_id", "capacity_tokens", "separator_tokens").filter("capacity_tokens > 0").dropDuplicates(["container_id"])
    counts = items.groupBy("container_id").agg(F.count("*").alias("n"))
    plan = sizes.join(counts, "container_id").select("container_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"), F.ceil(F.col("n") / group_items).alias("groups"))
    # Pieces are dealt one by one, so a text of many pieces does not fill one group.
    dealt = items.join(F.broadcast(plan) if plan.limit(CONTAINERS + 1).count() <= CONTAINERS else plan, "container_id").withColumn("group_no", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(seed)), "groups").cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece_no"], kind="stable")
        gap = int(frame.separator_tokens.iloc[0])
        room = int(frame.capacity_tokens.iloc[0]) + gap
        frame["bin_no"] = first_fit_decreasing(frame.tokens.to_numpy() + gap, room)
        return frame[["container_id", "group_no", "bin_no", "doc_id", "piece_no", "start", "stop", "tokens"]]

    return dealt.groupBy("container_id", "group_no").applyInPandas(pack, "container_id int, group_no int, bin_no int, doc_id bigint, piece_no int, start int, stop int, tokens int")
