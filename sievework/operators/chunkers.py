"""Chunkers: texts to rows of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.durable import tune_arrow
from sievework.functions.text import strip, uuid5

METHODS = ("token", "sentence", "recursive", "recursive_legal", "semantic", "ingest", "parent_child")
# The delimiters of legal texts, strongest first; each stays with the piece before.
LEGAL_DELIMITERS = (
    "\n\n", "\nРаздел ", "\nГлава ", "\nСтатья ", "\nПункт ", "\nПодпункт ", "\nПриложение ", "\nПисьмо ", "\nПриказ ",
    "\n1. ", "\n2. ", "\n3. ", "\nа) ", "\nб) ", "; ", ". ",
)
LEVELS = (("\n\n",), ("\n",), (". ", "! ", "? "), ("; ", ", "), (" ",))
# The levels of legal texts; below the last a text is cut anywhere.
LEGAL_LEVELS = (LEGAL_DELIMITERS, (". ", "! ", "? ", "\n"), (":", ";", ",", " - ", " -"), (" ",))


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of ``size`` characters, each beginning ``size - overlap`` after
    the one before; the last is the one that reaches the end."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be at least 1 and overlap between 0 and size - 1")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def token_chunks(corpus: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_i, text): windows of characters, by built-in functions alone."""
    return corpus.filter(F.col(text).isNotNull()).select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_i", "text"))


def with_previous_tail(chunks: DataFrame, overlap: int, key: str = "doc_id") -> DataFrame:
    """Each chunk after the first begins with the end of the original one before it."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("chunk_i"))
    return chunks.withColumn("text", F.when(before.isNotNull() & (before != "") & F.lit(overlap > 0), strip(F.concat(F.right(before, F.lit(overlap)), F.lit("\n"), F.col("text")))).otherwise(F.col("text")))


_SENTENCE = re.compile(r".+?(?:[.!?…]+[»”\"')\]]*(?=\s)\s*|\n+|$)", re.S)


def sentences(text: str, least: int = 12) -> list[str]:
    """Pieces that end with a sentence; ones shorter than ``least`` join the piece before."""
    out: list[str] = []
    for m in _SENTENCE.finditer(text):
        if out and (len(m.group().strip()) < least or len(out[-1].strip()) < least):
            out[-1] += m.group()
        else:
            out.append(m.group())
    return out


def pack_sentences(text: str, size: int, overlap: int, least_sentences: int = 1, least_chars: int = 12) -> list[str]:
    """Whole sentences up to ``size``; at least so many per chunk if they fit; each chunk after
    the first repeats the last sentences of the one before, up to ``overlap`` characters.  A
    sentence above the size is cut into windows."""
    parts: list[str] = []
    for s in sentences(text, least_chars):
        parts += [s[i : i + size] for i in range(0, len(s), size)] if len(s) > size else [s]
    out, i = [], 0
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and (n + len(parts[j]) <= size or j == i):
            n += len(parts[j])
            j += 1
        out.append("".join(parts[i:j]))
        if j == len(parts):
            break
        k, back = j, 0
        while k - 1 > i and back + len(parts[k - 1]) <= overlap and j - k < max(1, j - i - least_sentences + 1):
            k -= 1
            back += len(parts[k])
        i = k
    return [c for c in out if c.strip()]


def recursive(text: str, size: int, levels: tuple[tuple[str, ...], ...] = LEVELS, least: int = 24) -> list[str]:
    """Split at the strongest delimiters, merge neighbours up to ``size``, and split what is
    still above it at the next; delimiters stay with the piece before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if not levels:
        return [text[i : i + size] for i in range(0, len(text), size)]
    pattern = "|".join(re.escape(d) for d in levels[0])
    parts, at = [], 0
    for m in re.finditer(pattern, text):
        # A break before a heading belongs to the piece before, the heading's words do not.
        end = m.start() + 1 if m.group()[0] == "\n" and m.group().strip() else m.end()
        parts.append(text[at:end])
        at = end
    parts.append(text[at:])
    merged: list[str] = []
    for p in parts:
        if merged and (len(merged[-1]) + len(p) <= size and (len(p) < least or len(merged[-1]) < size)):
            merged[-1] += p
        elif p:
            merged.append(p)
    return [c for p in merged for c in recursive(p, size, levels[1:], least)]


def semantic(text: str, size: int, threshold: float = 0.8, window: int = 3) -> list[str]:
    """Sentences in order, cut where the words of the sentences before and after agree less
    than ``threshold`` of the text's usual agreement, and at ``size``."""
    parts = sentences(text)
    words = [set(re.findall(r"\w{4,}", p.lower())) for p in parts]

    def near(i: int) -> float:
        a, b = set().union(*words[max(0, i - window) : i]), set().union(*words[i : i + window])
        return len(a & b) / max(1, min(len(a), len(b)))

    ties = [near(i) for i in range(1, len(parts))]
    usual = sum(ties) / len(ties) if ties else 0.0
    out: list[str] = []
    for i, p in enumerate(parts):
        if out and len(out[-1]) + len(p) <= size and ties[i - 1] >= threshold * usual:
            out[-1] += p
        else:
            out += [p[k : k + size] for k in range(0, len(p), size)] if len(p) > size else [p]
    return [c for c in out if c.strip()]


def chunk_text(text: str, method: str, size: int, overlap: int = 0, least_sentences: int = 1, least_chars: int = 12) -> list[str]:
    if method == "token":
        step = size - overlap
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)] if text else []
    if method == "sentence":
        return pack_sentences(text, size, overlap, least_sentences, least_chars)
    if method in ("recursive", "recursive_legal", "ingest"):
        parts = recursive(text, size, LEGAL_LEVELS if method == "recursive_legal" else LEVELS)
        return [p if not i or not overlap else f"{parts[i - 1][-overlap:]}\n{p}".strip() for i, p in enumerate(parts)]
    if method == "semantic":
        return semantic(text, size)
    raise ValueError(f"Unsupported chunk_method={method!r}")


def chunks(corpus: DataFrame, method: str, size: int, overlap: int = 0, least_sentences: int = 1, least_chars: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_i, text, chunk_start, chunk_end) by any method but ``parent_child``.

    ``chunk_start`` is where the chunk's first 80 characters stand at or after the chunk before.
    """
    if method not in METHODS or method == "parent_child":
        raise ValueError(f"Unsupported chunk_method={method!r}")
    tune_arrow(corpus.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["text"]):
                cursor = 0
                for i, c in enumerate(chunk_text(t, method, size, overlap, least_sentences, least_chars)):
                    at = t.find(c[:80], cursor)
                    at = cursor if at < 0 else at
                    out.append((k, i, c, at, at + len(c)))
                    cursor = at
            yield pd.DataFrame(out, columns=["key", "chunk_i", "text", "chunk_start", "chunk_end"])

    rows = corpus.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    out = rows.mapInPandas(run, "key string, chunk_i int, text string, chunk_start int, chunk_end int")
    return out.withColumn("key", F.col("key").cast(corpus.schema[key].dataType)).withColumnRenamed("key", key)


def parent_child_chunks(corpus: DataFrame, parent: int, child: int, parent_overlap: int = 0, child_overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, parent_i, child_i, parent_text, child_text): windows within windows; child_i counts
    through the document."""
    parents = corpus.filter(F.col(text).isNotNull()).select(key, F.transform(windows(F.col(text), parent, parent_overlap), lambda p, i: F.struct(i.alias("parent_i"), p.alias("parent_text"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: F.transform(windows(p["parent_text"], child, child_overlap), lambda c: F.struct(p["parent_i"].alias("parent_i"), p["parent_text"].alias("parent_text"), c.alias("child_text")))))
    return parents.select(key, F.posexplode(flat).alias("child_i", "c")).select(key, "c.parent_i", "child_i", "c.parent_text", "c.child_text")


def nested_chunks(corpus: DataFrame, parent: tuple[str, int], child: tuple[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``parent_child_chunks``, parents and children each by a method and size of their own
    (without overlap), such as legal parents with sentence children."""
    for method, _ in (parent, child):
        if method not in METHODS or method == "parent_child":
            raise ValueError(f"no chunk method {method!r}")
    tune_arrow(corpus.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["text"]):
                n = 0
                for i, whole in enumerate(chunk_text(t, *parent)):
                    for part in chunk_text(whole, *child):
                        out.append((k, i, n, whole, part))
                        n += 1
            yield pd.DataFrame(out, columns=["key", "parent_i", "child_i", "parent_text", "child_text"])

    rows = corpus.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    out = rows.mapInPandas(run, "key string, parent_i int, child_i int, parent_text string, child_text string")
    return out.withColumn("key", F.col("key").cast(corpus.schema[key].dataType)).withColumnRenamed("key", key)


def point_id(source: Column, external: Column, method: Column, size: Column, overlap: Column, number: Column) -> Column:
    """The stable id of a chunk."""
    return uuid5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("None")) for c in (source, external, method, size, overlap, number))))


def split_message(text: str, limit: int = 4096, window: int = 3800, least: int = 1000) -> list[str]:
    """As it is up to the limit, else windows cut at their last line break, if it is far enough."""
    if len(text) <= limit:
        return [text]
    out = []
    while text:
        cut = text.rfind("\n", 0, window) if len(text) > window else -1
        cut = cut if cut > least else window
        out.append(text[:cut])
        text = text[cut:].lstrip("\n")
    return out
