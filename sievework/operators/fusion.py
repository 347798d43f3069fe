"""Combining ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.numbers import rrf_term
from sievework.functions.text import overlap_coefficient, terms
from sievework.operators.bm25 import top_per_query


#: Candidate ids that are sent to every executor; more are joined by key.
FEW = 500_000


def rrf(dense: DataFrame, lexical: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, doc_id, score, rank).

    (query_id, doc_id, score, rank, score_dense, rank_dense, score_bm25, rank_bm25).
    """
    d = dense.select("query_id", "doc_id", F.col("score").alias("score_dense"), F.col("rank").alias("rank_dense"))
    s = lexical.select("query_id", "doc_id", F.col("score").alias("score_bm25"), F.col("rank").alias("rank_bm25"))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    return top_per_query(both.withColumn("score", F.round(rrf_term(F.col("rank_dense"), constant) + rrf_term(F.col("rank_bm25"), constant), 9)), k)


def rerank_by_overlap(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Candidates re-sorted by the terms they share with the query; ties keep their order.

    The text is fetched for candidates only.
    """
    want = ranked.select("query_id", "doc_id", F.col("rank").alias("rank_before"), F.col("score").alias("score_before"))
    # Terms are made of the candidates' texts only: a semi-join on ids comes first.
    ids = ranked.select("doc_id").distinct()
    if ids.limit(FEW + 1).count() <= FEW:
        ids = F.broadcast(ids)
    texts = corpus.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("doc_id", terms(F.col("text")).alias("doc_terms"))
    asked = queries.select("query_id", terms(F.col("query")).alias("query_terms"))
    scored = want.join(texts, "doc_id").join(asked, "query_id").withColumn("score", F.round(overlap_coefficient(F.col("query_terms"), F.col("doc_terms")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank_before")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "rank_before")


def best_child_per_parent(ranked: DataFrame, k: int) -> DataFrame:
    """One row per parent, its best child's; items without a parent pass.

    ``ranked``: ``query_id, item, parent_id, score, rank`` -> the same, ranked again.
    """
    parent = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.concat(F.lit("\u0000"), F.col("item")))
    order = Window.partitionBy("query_id", parent).orderBy(F.col("score").desc(), "rank")
    best = ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    again = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return best.withColumn("new_rank", F.row_number().over(again)).filter(F.col("new_rank") <= k)
