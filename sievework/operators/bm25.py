"""Lexical retrieval: Okapi BM25 over terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.functions.text import FOLDED_TERM, terms

K1, B = 1.5, 0.75
#: Queries scored in one pass.
BLOCK = 2048


def corpus_stats(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (n_docs, avgdl) over the documents with at least one term."""
    dl = F.nullif(F.size(terms(F.col(text))), F.lit(0))
    return corpus.select(dl.alias("dl")).agg(F.count("dl").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_frequencies(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df): the number of documents that hold each term."""
    return corpus.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def top_per_query(scored: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Adds ``rank``: the k best of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_WORD = re.compile(FOLDED_TERM)


def _folded_terms(text: str) -> list[str]:
    """As ``terms`` gives them, in a worker."""
    return _WORD.findall(text.lower().replace("ё", "е"))


def _statistics(corpus: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, df, dl): documents that hold each wanted term (None: all); the row without a term
    counts the documents with any and the sum of their lengths.  One pass, summed map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = length = 0
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = _folded_terms(text.as_py())
                docs += bool(found)
                length += len(found)
                held = set(found)
                df.update(held if wanted is None else held & wanted)
                if len(df) > 1_000_000:  # of all terms: pass them on
                    yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(df.values(), pa.int64()), pa.array([0] * len(df), pa.int64())], ["term", "df", "dl"])
                    df.clear()
        names, counts = [None, *df], [docs, *df.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array([length] + [0] * len(df), pa.int64())], ["term", "df", "dl"])

    texts = corpus.select("text").filter("text is not null")
    return texts.mapInArrow(run, "term string, df bigint, dl bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank).

    Common terms pair nearly every query with nearly every document, so neither postings nor
    pairs are shuffled: a first pass counts the documents of the queries' terms, a second adds
    up, for each document where it lies, the weights of its terms over the lists of queries
    that hold them, and each task keeps its own k best for each query.  Queries pass in blocks;
    a task is sent the terms and frequencies of one block.
    """
    spark = corpus.sparkSession
    tune_arrow(spark, 1000)
    asked = durable(query_terms(queries), "asked")
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, doc_id bigint, score double"
    blocks, out = max(1, -(-asked.select("query_id").distinct().count() // block)), None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        lists: dict[str, list[int]] = {}
        at: dict = {}
        for query, term in part.orderBy("query_id", "term").collect():  # the terms of about ``block`` queries
            lists.setdefault(term, []).append(at.setdefault(query, len(at)))
        if not lists:
            continue
        counted = {r.term: (r.df, r.dl) for r in _statistics(corpus, set(lists)).collect()}
        n, length = counted.pop(None, (0, 0))
        if not n:
            continue
        weight = {t: (log(1 + (n - df + 0.5) / (df + 0.5)), np.array(lists[t])) for t, (df, _) in counted.items()}
        sent = spark.sparkContext.broadcast((list(at), weight, length / n))
        found = corpus.select("doc_id", "text").filter("text is not null").mapInPandas(_ranker(sent, k), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_per_query(out, k)


def _ranker(sent, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, weight, average = sent.value
        best_s, best_d = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        at_once = max(1, min(512, 4_000_000 // len(ids)))
        rows, names = [], []

        def merge() -> None:
            nonlocal best_s, best_d
            s = np.round(np.array(rows).T, 6)
            s[s <= 0] = -np.inf
            s, d = np.concatenate((best_s, s), 1), np.concatenate((best_d, np.broadcast_to(np.array(names, np.int64), s.shape)), 1)
            order = np.lexsort((d, -s))[:, :k]
            best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            rows.clear()
            names.clear()

        for frame in frames:
            for doc, text in zip(frame.doc_id, frame.text):
                found = _folded_terms(text)
                held = [(weight[t], tf) for t, tf in Counter(found).items() if t in weight]
                if not held:
                    continue
                norm = K1 * (1 - B + B * len(found) / average)
                values = [idf * tf * (K1 + 1) / (tf + norm) for (idf, _), tf in held]
                sizes = [len(q) for (_, q), _ in held]
                rows.append(np.bincount(np.concatenate([q for (_, q), _ in held]), np.repeat(values, sizes), len(ids)))
                names.append(doc)
                if len(rows) >= at_once:
                    merge()
        if rows:
            merge()
        n = best_s.shape[1]
        if n:
            keep = np.isfinite(best_s.ravel())
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=object), n)[keep], "doc_id": best_d.ravel()[keep], "score": best_s.ravel()[keep]})

    return run
