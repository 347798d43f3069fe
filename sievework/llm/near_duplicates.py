"""Groups of records that differ by small edits.

Minima of universal hash functions over each record's distinct word shingles are cut into
bands; records that share a band meet in a bucket.  In each bucket one member leads first and
every other member is compared with it by sketch (and by its shingles where the sketch is not
certain).  The links found are joined into groups by alternating large-star and small-star;
then every pair of a bucket whose members are in different groups still is compared, in
blocks of the bucket, and the links are joined again.  So no pair that shares a band is left
uncompared unless its records are in one group already.

No bucket is gathered into one task: a large one is cut into blocks that meet pair by pair.
Records with the same set of shingles form one class before anything is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.sources import with_columns

WORD = re.compile(r"[^\W_]+")
#: Bands and hash functions per band: at a similarity of 0.5 a pair shares a band with
#: probability 0.983, at 0.6 with 0.99996; unlike pairs at 0.1 do so once in 800.
BANDS, ROWS = 128, 5
#: One byte of so many minima travels with a candidate; its estimate has a standard error of
#: 0.031 at 0.5, and pairs nearer than CERTAIN to the threshold are compared by shingles.
SKETCH, CERTAIN = 256, 0.17
#: Members of a bucket are compared in blocks of about so many.
BLOCK = 2000
#: Rows of up to three numbers that are sent to every executor instead of being joined by key.
FEW = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    """Digest of each word, worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct hashed word shingles of a text, as sorted uint64."""

    def __init__(self, words: int):
        self.words, self.known = words, _Digests()

    def __call__(self, text: str) -> np.ndarray:
        tokens = WORD.findall(text.lower())
        if len(tokens) < max(2, self.words):
            return np.empty(0, np.uint64)
        x = np.array(itemgetter(*tokens)(self.known), np.uint64)
        n = len(x) - self.words + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.words):
            out = (out ^ x[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


class MinHasher:
    """Minima of strongly universal hash functions: the high half of a*x + b in 64 bits."""

    def __init__(self, bands: int, rows: int, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a, self.b = (rng.integers(0, 2**64, (k, 1), dtype=np.uint64) for _ in range(2))
        self.mix = rng.integers(0, 2**63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32))[None, :]
        out = np.empty(len(self.a), np.uint64)
        step = min(len(out), max(1, 20_000 // x.shape[1]))  # a block of the table stays in the cache
        block = np.empty((step, x.shape[1]), np.uint64)
        for i in range(0, len(out), step):
            h = block[: len(out) - i]
            np.multiply(self.a[i : i + step], x, out=h)
            np.add(h, self.b[i : i + step], out=h)
            h.min(axis=1, out=out[i : i + step])
        return (out >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        h = (m * self.mix).sum(axis=1, dtype=np.uint64) ^ self.salt
        h ^= h >> np.uint64(31)
        h *= _MIX
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def sketch(self, minima: np.ndarray) -> bytes:
        return ((minima[:SKETCH] * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sketches(records: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, class_key, sketch, keys) of (doc_id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hasher = Shingler(words), MinHasher(bands, rows)
        for batch in batches:
            ids, classes, sketches, keys = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle(body.as_py())
                if not len(s):
                    continue
                m = hasher.minima(s)
                ids.append(doc)
                classes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                sketches.append(hasher.sketch(m))
                keys.append(hasher.band_keys(m))
            if ids:
                flat = np.concatenate(keys)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary()), lists], ["doc_id", "class_key", "sketch", "keys"])

    return records.mapInArrow(run, "doc_id bigint, class_key bigint, sketch binary, keys array<bigint>")


def _estimated(pairs: DataFrame) -> DataFrame:
    """Adds ``alike``: the similarity that two sketches let expect."""

    @F.pandas_udf("double")
    def alike(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=float)
        n = len(x.iloc[0])
        same = (np.frombuffer(b"".join(x), np.uint8) == np.frombuffer(b"".join(y), np.uint8)).reshape(-1, n).mean(axis=1)
        return pd.Series((same - 1 / 256) / (1 - 1 / 256))

    return pairs.withColumn("alike", alike("sketch_a", "sketch_b"))


def _exact(pairs: DataFrame, words: int) -> DataFrame:
    """Adds ``alike``: the shared part of the shingles of ``body_a`` and ``body_b``."""

    @F.pandas_udf("double")
    def alike(x, y):
        import pandas as pd

        shingle = Shingler(words)

        def one(a: str, b: str) -> float:
            s, t = shingle(a), shingle(b)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            return shared / max(1, len(s) + len(t) - shared)

        return pd.Series([one(a, b) for a, b in zip(x, y)], dtype=float)

    return pairs.withColumn("alike", alike("body_a", "body_b"))


def _verified(pairs: DataFrame, sketches: DataFrame, records: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) at or above the threshold, written to a table."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    s = sketches.select("doc_id", "sketch").join(hinted(need), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    judged = durable(_estimated(both).filter(F.col("alike") >= threshold - CERTAIN).select("a", "b", "alike"), "judged")
    return _settled(judged, records, words, threshold)


def _settled(judged: DataFrame, records: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs of a table (a, b, alike) at or above the threshold; the unsure ones by their shingles."""
    unsure = judged.filter(F.col("alike") < threshold + CERTAIN).select("a", "b")
    sure = judged.filter(F.col("alike") >= threshold + CERTAIN).select("a", "b")
    if unsure.isEmpty():
        return sure
    # The texts of the unsure pairs alone are fetched.
    need = unsure.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bodies = records.join(hinted(need), "doc_id", "left_semi").select("doc_id", "body").dropDuplicates(["doc_id"])
    texts = unsure.join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a").join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b")
    return durable(sure.unionByName(_exact(texts, words).filter(F.col("alike") >= threshold).select("a", "b")), "links")


def _blocks(members: DataFrame) -> DataFrame:
    """``members (bucket, doc_id, root)`` laid out in cells (bucket, i, j) of one or two blocks.

    Any two members of a bucket with different roots meet in exactly one cell, from its sides
    0 and 1 or, where i = j, both on side 0.  Members of a bucket's largest group, which need
    not meet each other, are numbered below zero.
    """
    groups = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).filter(F.col("top.n") < F.col("all"))
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = durable(sizes.select("bucket", F.col("top.root").alias("top"), parts(F.col("top.n")).alias("t"), parts(F.col("all") - F.col("top.n")).alias("r")), "sizes")
    big = F.col("root") == F.col("top")
    placed = members.join(hinted(sizes), "bucket").withColumn("k", F.pmod(F.xxhash64("doc_id", "bucket"), F.when(big, F.col("t")).otherwise(F.col("r"))).cast("int"))
    cell = lambda i, j, side: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), side.cast("int").alias("side"))
    cells = "array<struct<i:int,j:int,side:int>>"
    rest = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda o: F.when(big, cell(-1 - F.col("k"), o, F.lit(0))).otherwise(cell(F.col("k"), o, F.col("k") > o)))
    top = F.when(big, F.array().cast(cells)).otherwise(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda o: cell(-1 - o, F.col("k"), F.lit(1))))
    return placed.select("bucket", "doc_id", "root", F.explode(F.concat(rest.cast(cells), top.cast(cells))).alias("c")).select("bucket", "c.i", "c.j", "c.side", "doc_id", "root")


def _apart(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(a, b, alike): pairs of a bucket with different roots that may reach the threshold.

    ``members (bucket, doc_id, root)``, ``sketches (doc_id, sketch)``, one row each.
    """

    def compared(i, j, side, doc, root, sketch):
        """Indices and similarity of the pairs of one cell."""
        if i == j:
            xs, ys = np.arange(len(doc)), np.arange(len(doc))
        else:
            xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(xs) > len(ys):
                xs, ys = ys, xs
        theirs, roots = sketch[ys], root[ys]
        for n, x in enumerate(xs):
            since = n + 1 if i == j else 0
            same = (theirs[since:] == sketch[x]).mean(axis=1)
            alike = (same - 1 / 256) / (1 - 1 / 256)
            for y in np.flatnonzero((alike >= threshold - CERTAIN) & (roots[since:] != root[x])):
                a, b = int(doc[x]), int(doc[ys[since + y]])
                yield min(a, b), max(a, b), float(alike[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(columns, cuts):
            rows = {pair for lo, hi in zip(cuts, cuts[1:]) for pair in compared(columns[1][lo], columns[2][lo], *(c[lo:hi] for c in columns[3:]))}
            if rows:
                a, b, alike = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], ["a", "b", "alike"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            columns.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            bucket, i, j = columns[:3]
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1)]
            yield from out(columns, cuts)
            held = [c[cuts[-1] :] for c in columns]  # the last cell may go on in the next batch
        if held is not None:
            yield from out(held, [0, len(held[0])])

    cells = _blocks(members).join(sketches, "doc_id").select("bucket", "i", "j", "side", "doc_id", "root", "sketch")
    sorted_ = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sorted_.mapInArrow(run, "a bigint, b bigint, alike double").dropDuplicates(["a", "b"])


def _masked(doc: Column, bucket: Column) -> Column:
    """Reversible: each bucket orders its members in its own way."""
    return doc.bitwiseXOR(F.xxhash64(bucket))


def few(df: DataFrame) -> bool:
    """Whether a table of numbers is small enough to be sent to every executor (12 MB)."""
    return df.limit(FEW + 1).count() <= FEW


def hinted(df: DataFrame) -> DataFrame:
    """For joins: broadcast where the rows are few by count, else by key."""
    return F.broadcast(df) if few(df) else df


def similar_links(records: DataFrame, words: int, threshold: float, exclude: DataFrame | None = None, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and the classes.

    ``records``: (doc_id, body).  Returns ``links (a, b)`` and ``classes (doc_id, class_key,
    rep)``; rep is the smallest doc_id of the class.  Of rows with one doc_id and different
    bodies the one with the smallest class key counts.  Texts are read where they lie: ids to
    leave out and repeated ids are dealt with on the sketches.
    """
    tune_arrow(records.sparkSession)
    sketches = durable(_sketches(records.select("doc_id", "body"), words, bands, rows), "sketches")
    ids = sketches.groupBy("doc_id").agg(F.min("class_key").alias("class_key"))
    if exclude is not None:
        ids = ids.join(exclude.select("doc_id"), "doc_id", "left_anti")
    ids = durable(ids, "ids")
    reps = ids.groupBy("class_key").agg(F.min("doc_id").alias("rep"))
    classes = durable(ids.join(reps, "class_key").select("doc_id", "class_key", "rep"), "classes")
    # Most records are the first of their class: the others are fewer to send, or to join by key.
    first = classes.filter("doc_id = rep").select("doc_id", "class_key")
    others = durable(sketches.select("doc_id", "class_key").distinct().join(first, ["doc_id", "class_key"], "left_anti"), "others")
    own = sketches.join(hinted(others), ["doc_id", "class_key"], "left_anti")
    rows_ = own.select(F.explode("keys").alias("bucket"), F.col("doc_id").alias("m")).select("bucket", _masked(F.col("m"), F.col("bucket")).alias("m"))
    unmask = lambda c: _masked(F.col(c), F.col("bucket"))
    # The first meeting, of all buckets: minimum and maximum are found by partial aggregation,
    # and buckets of two, which are most, need no join and are done with.
    heads = durable(rows_.groupBy("bucket").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("*").alias("n")).filter("lo < hi"), "heads")
    larger = heads.filter("n > 2").select("bucket", "lo", "hi")
    every = heads.select("bucket", "lo", F.col("hi").alias("m")).unionByName(rows_.join(hinted(larger), "bucket").filter("m <> lo and m <> hi").select("bucket", "lo", "m"))
    met = durable(every.select("bucket", unmask("lo").alias("x"), unmask("m").alias("y")).select("bucket", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "met")
    links = _verified(met.select("a", "b").distinct(), sketches, records, words, threshold)
    # Then every pair of a larger bucket that the links leave in different groups.
    roots = hinted(connected(links))
    members = met.join(hinted(larger.select("bucket")), "bucket", "left_semi").select("bucket", F.col("y").alias("doc_id")).unionByName(larger.select("bucket", unmask("lo").alias("doc_id")))
    rooted = members.join(roots, members.doc_id == roots.node, "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("bucket")
    open_ = durable(rooted.join(hinted(durable(split, "split")), "bucket", "left_semi").distinct(), "open")
    if not open_.isEmpty():
        need = own.join(hinted(open_.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "sketch").dropDuplicates(["doc_id"])
        near = durable(_apart(open_, durable(need, "needed"), threshold), "near")
        known = met.select("a", "b").join(hinted(near.select("a", "b")), ["a", "b"], "left_semi").distinct()
        links = links.unionByName(_settled(durable(near.join(hinted(known), ["a", "b"], "left_anti"), "judged"), records, words, threshold))
    return links.distinct(), classes


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``links (a, b)`` is connected with.

    Alternating large-star and small-star; every pass is written to the shared folder, and
    the passes end when one leaves the links as they were.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = durable(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(records: DataFrame, words: int = 5, threshold: float = 0.8, min_chars: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id): one row per record that takes part and has shingles.

    ``records``: ``doc_id, title, text``; other columns are ignored.  Two records are alike if
    the distinct sequences of ``words`` words over title, a line break and text, lower-cased
    and read as runs of letters and digits, have at least ``threshold`` of their union in
    common.  ``group_id`` is the smallest doc_id of all records linked directly or through
    others; a record like no other is its own group.

    Nulls: records with a null doc_id or text take no part, a null title is empty.  Repeated
    rows of a doc_id count once (of different texts under one id one counts).  Texts below ``min_chars`` characters and the records of
    ``exclude (doc_id)`` take no part, nor do records with fewer than ``words`` words.
    An empty table gives an empty result.
    """
    use = with_columns(records, "doc_id", "title", "text").filter("doc_id is not null and text is not null").filter(F.length("text") >= min_chars)
    body = use.select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text")).alias("body"))
    links, classes = similar_links(body, words, threshold, None if exclude is None else durable(exclude.select("doc_id"), "exclude"))
    roots = connected(links)
    return classes.join(roots, classes.rep == roots.node, "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): every pair of a group, smaller id first."""
    shared = groups.groupBy("group_id").count().filter("count > 1").select("group_id")
    members = durable(groups.join(shared, "group_id", "left_semi"), "members")
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
