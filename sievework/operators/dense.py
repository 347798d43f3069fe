"""Dense retrieval: exact cosine top-k of a query set against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import tune_arrow
from sievework.operators.bm25 import top_per_query

#: Queries multiplied with the corpus in one pass: a block of 4096 x 1024 floats has 16 MB.
BLOCK = 4096


def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def dense_topk(points: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine.

    ``points``: ``doc_id, vector``; ``queries``: ``query_id, vector``, all of one size; rows
    with a null id or vector take no part.  The queries pass over the corpus in blocks; each
    task keeps its own k best for each query, and only those are shuffled.
    """
    tune_arrow(points.sparkSession, 4096)
    ask = queries.filter("query_id is not null and vector is not null").select("query_id", "vector")
    number = ask.count()
    blocks = max(1, -(-number // block))
    every = points.filter("doc_id is not null and vector is not null").select("doc_id", "vector")
    out = None
    for b in range(blocks):
        part = ask if blocks == 1 else ask.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()  # about ``block`` rows
        if not rows:
            continue
        ids, matrix = [r[0] for r in rows], _matrix([r[1] for r in rows])

        def run(frames: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            best_s = np.full((len(ids), 0), -np.inf)
            best_d = np.zeros((len(ids), 0), np.int64)
            for frame in frames:
                s = np.round(matrix @ _matrix(frame.vector).T, 6)
                d = np.broadcast_to(frame.doc_id.to_numpy(np.int64), s.shape)
                s, d = np.concatenate((best_s, s), 1), np.concatenate((best_d, d), 1)
                order = np.lexsort((d, -s))[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            n = best_s.shape[1]
            if n:
                yield pd.DataFrame({"query_id": np.repeat(ids, n), "doc_id": best_d.ravel(), "score": best_s.ravel()})

        found = every.mapInPandas(run, "query_id bigint, doc_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = points.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top_per_query(out, k)


def above(ranked: DataFrame, threshold: float) -> DataFrame:
    """The threshold applies to what the limit let through."""
    return ranked.filter(F.col("score") >= threshold)


def prefix_filtered(ranked: DataFrame, group: str, prefix: str, k: int) -> DataFrame:
    """The k best whose ``group`` begins with the prefix; queries without any keep all.

    ``ranked`` holds more candidates than k.
    """
    from pyspark.sql import Window

    hit = F.coalesce(F.col(group).startswith(prefix), F.lit(False))
    any_hit = F.max(hit).over(Window.partitionBy("query_id"))
    kept = ranked.withColumn("_any", any_hit).filter(hit | ~F.col("_any")).drop("_any", "rank")
    return top_per_query(kept, k)
