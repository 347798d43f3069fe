"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.numbers import cosine, dot, sigmoid, unit
from sievework.functions.text import terms
from sievework.operators import bm25, dense, fusion
from sievework.durable import durable
from sievework.sources import load, spread


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "eval_record").select(F.col("id").alias("query_id"), "query")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


def bm25_corpus_stats(spark, sf):
    return bm25.corpus_stats(load(spark, sf, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_term_df(spark, sf):
    return bm25.term_frequencies(load(spark, sf, "documents"))


def bm25_topk(spark, sf):
    return bm25.bm25_topk(_corpus(spark, sf), _questions(spark, sf), 10)


def _points(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, sf):
    """The query set: every vector whose id is divisible by 100."""
    return _points(spark, sf).filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


def dense_topk(spark, sf):
    return dense.dense_topk(_points(spark, sf), _vector_queries(spark, sf), 10)


def dense_threshold(spark, sf):
    return dense.above(dense_topk(spark, sf), 0.3)


def dense_prefix_filter(spark, sf):
    ranked = dense.dense_topk(_points(spark, sf), _vector_queries(spark, sf), 40)
    labels = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"))
    return dense.prefix_filtered(ranked.join(labels, "doc_id"), "label", "3", 5).select("query_id", "doc_id", "score", "label", "rank")


def vector_math(spark, sf):
    v, w = F.col("embedding"), F.reverse("embedding")
    return load(spark, sf, "embeddings").select("vec_id", F.round(dot(v, w), 6).alias("dot"), F.round(cosine(v, w), 6).alias("cosine"), F.round(sigmoid(dot(v, w) * 10), 6).alias("sigmoid"), F.round(F.get(unit(v), F.lit(0)), 6).alias("first"))


def _titled(spark, sf):
    """Documents with a vector whose id is divisible by 100, asked for by their title."""
    return load(spark, sf, "documents").filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def hybrid_rrf(spark, sf):
    lexical = bm25.bm25_topk(_corpus(spark, sf), _titled(spark, sf), 50)
    near = dense.dense_topk(_points(spark, sf), _vector_queries(spark, sf), 50)
    return fusion.rrf(near, lexical, 10).select("query_id", "doc_id", "score", "rank", "rank_dense", "rank_bm25")


def rerank_overlap(spark, sf):
    documents, questions = _corpus(spark, sf), _questions(spark, sf)
    # The candidates are read twice, so they are ranked once.
    return fusion.rerank_by_overlap(durable(bm25.bm25_topk(documents, questions, 50), "candidates"), questions, documents, 5)


def _retrieved(spark, sf):
    records = load(spark, sf, "generation_record").select("id", "query", "method", "dataset", "retrieved").distinct()
    return records.select(F.col("id").alias("query_id"), "query", "method", "dataset", F.explode("retrieved").alias("r")).select("query_id", "query", "method", "dataset", "r.*")


def parent_child_group(spark, sf):
    r = _retrieved(spark, sf)
    item = F.concat_ws(":", "source_code", "external_id", "chunk_i")
    rows = r.select("query_id", F.concat_ws("#", item, F.col("rank").cast("string")).alias("item"), "parent_id", F.round("score", 6).alias("score"), "rank")
    return fusion.best_child_per_parent(rows, 3).select("query_id", "item", "score", "rank", "new_rank")


def overlap_scores(spark, sf):
    """Term overlap of every question with its own passage."""
    e = load(spark, sf, "eval_record")
    from sievework.functions.text import overlap_coefficient

    return e.select("id", F.round(overlap_coefficient(terms(F.col("query")), terms(F.col("source_chunk.text"))), 6).alias("overlap"))


_TERMS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9A-Za-zА-Яа-яЁё]{{3,}}'), lambda x: replace(lower(x), 'ё', 'е'))"


def sql_terms(column: str) -> str:
    return _TERMS.format(column)


def _bm25_sql(questions: str, k: int) -> str:
    """CTEs that end in ``bm25(query_id, doc_id, score, rank)``."""
    return f"""
docs as (select doc_id, tokens, len(tokens) as dl from (select doc_id, {sql_terms('text')} as tokens from documents) where len(tokens) > 0),
post as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(tokens) as term from docs) group by all),
freq as (select term, count(*) as df from post group by term),
stat as (select count(*) as n, avg(dl) as avgdl from docs),
ask as (select distinct query_id, unnest({sql_terms('query')}) as term from ({questions})),
scored as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from ask join post using (term) join freq using (term), stat group by query_id, doc_id),
bm25 as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from scored where score > 0 qualify rank <= {k})"""


_DENSE = """
pair as (select q.vec_id as query_id, p.vec_id as doc_id, p.label, round(list_cosine_similarity(cast(q.embedding as double[]), cast(p.embedding as double[])), 6) as score
  from embeddings q, embeddings p where q.vec_id % 100 = 0),
dense as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from pair)"""

_QUESTIONS = "select id as query_id, query from eval_record"
_RETRIEVED = "select id as query_id, query, method, dataset, unnest(retrieved, max_depth := 2) from (select distinct id, query, method, dataset, retrieved from generation_record)"

SQL = {
    "bm25_corpus_stats": f"with docs as (select len({sql_terms('text')}) as dl from documents) select count(*) as n_docs, round(avg(dl), 6) as avgdl from docs where dl > 0",
    "bm25_term_df": f"select term, count(*) as df from (select distinct doc_id, unnest({sql_terms('text')}) as term from documents) group by term",
    "bm25_topk": f"with {_bm25_sql(_QUESTIONS, 10)} select query_id, doc_id, score, rank from bm25",
    "dense_topk": f"with {_DENSE} select query_id, doc_id, score, rank from dense where rank <= 10",
    "dense_threshold": f"with {_DENSE} select query_id, doc_id, score, rank from dense where rank <= 10 and score >= 0.3",
    "dense_prefix_filter": f"""with {_DENSE},
wide as (select *, starts_with(cast(label as varchar), '3') as hit, bool_or(starts_with(cast(label as varchar), '3')) over (partition by query_id) as any_hit from dense where rank <= 40)
select query_id, doc_id, score, cast(label as varchar) as label, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
from wide where hit or not any_hit qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5""",
    "vector_math": """
with v as (select vec_id, cast(embedding as double[]) as a, list_reverse(cast(embedding as double[])) as b from embeddings),
m as (select vec_id, a, list_dot_product(a, b) as d, sqrt(list_dot_product(a, a)) as na, sqrt(list_dot_product(b, b)) as nb from v)
select vec_id, round(d, 6) as dot, round(d / (na * nb), 6) as cosine, round(1 / (1 + exp(-d * 10)), 6) as sigmoid, round(a[1] / na, 6) as first from m""",
    "hybrid_rrf": f"""with {_bm25_sql("select doc_id as query_id, title as query from documents where doc_id % 100 = 0 and title is not null", 50)}, {_DENSE},
fused as (select coalesce(d.query_id, b.query_id) as query_id, coalesce(d.doc_id, b.doc_id) as doc_id, d.rank as rank_dense, b.rank as rank_bm25,
  round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) as score
  from (select * from dense where rank <= 50) d full outer join bm25 b on d.query_id = b.query_id and d.doc_id = b.doc_id)
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank, rank_dense, rank_bm25 from fused
qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10""",
    "rerank_overlap": f"""with {_bm25_sql(_QUESTIONS, 50)},
sets as (select b.query_id, b.doc_id, b.rank as rank_before, list_distinct({sql_terms('e.query')}) as x, list_distinct({sql_terms('d.text')}) as y
  from bm25 b join eval_record e on e.id = b.query_id join documents d on d.doc_id = b.doc_id),
s as (select query_id, doc_id, rank_before, case when least(len(x), len(y)) > 0 then round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) else 0 end as score from sets)
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, rank_before) as integer) as rank, rank_before from s
qualify row_number() over (partition by query_id order by score desc, rank_before) <= 5""",
    "parent_child_group": f"""with r as ({_RETRIEVED}),
i as (select query_id, concat_ws('#', concat_ws(':', source_code, external_id, chunk_i), cast(rank as varchar)) as item, nullif(parent_id, '') as parent_id, round(score, 6) as score, rank from r),
b as (select * from i qualify row_number() over (partition by query_id, coalesce(parent_id, 'x' || item) order by score desc, rank) = 1)
select query_id, item, score, rank, cast(row_number() over (partition by query_id order by score desc, rank) as integer) as new_rank from b
qualify row_number() over (partition by query_id order by score desc, rank) <= 3""",
    "overlap_scores": f"""with s as (select id, list_distinct({sql_terms('query')}) as x, list_distinct({sql_terms('source_chunk.text')}) as y from eval_record)
select id, case when least(len(x), len(y)) > 0 then round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) else 0.0 end as overlap from s""",
}

QUERIES = {f.__name__: f for f in (bm25_corpus_stats, bm25_term_df, bm25_topk, dense_topk, dense_threshold, dense_prefix_filter, vector_math, hybrid_rrf, rerank_overlap, parent_child_group, overlap_scores)}
