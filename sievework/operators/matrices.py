"""Experiment matrices and the offline reindex: one plan with the variant as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import overlap_coefficient, terms
from sievework.operators import bm25, chunkers, cleaning, dense, fusion, models, registry
from sievework.sources.files import swap_table


def union(parts: dict[str, DataFrame], column: str = "variant") -> DataFrame:
    """The rows of all variants, each with its name."""
    out = None
    for name, rows in parts.items():
        named = rows.select(F.lit(name).alias(column), "*")
        out = named if out is None else out.unionByName(named)
    return out


def self_retrieval(ranked: DataFrame, gold: Column, column: str = "variant") -> DataFrame:
    """(variant, queries, hit, mrr) of ranked lists whose relevant rows ``gold`` tells."""
    per = ranked.groupBy(column, "query_id").agg(F.max(gold.cast("int")).alias("hit"), F.coalesce(F.max(F.when(gold, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"))
    return per.groupBy(column).agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"))


def _dense(corpus: DataFrame, queries: DataFrame, embedder: str, k: int) -> DataFrame:
    """Top k by cosine of a registered embedder; texts without terms have no vector."""
    has = lambda c: F.size(terms(F.col(c))) > 0
    points = models.embedded(corpus.filter(has("text")), "text", embedder).select("doc_id", "vector")
    asked = models.embedded(queries.filter(has("query")), "query", embedder).select("query_id", "vector")
    return dense.dense_topk(points, asked, k)


def retrieval_matrix(corpus: DataFrame, queries: DataFrame, k: int = 10, depth: int = 50, embedder: str = "hashing") -> DataFrame:
    """Ranked lists of dense, lexical and fused retrieval over one corpus."""
    near, lexical = _dense(corpus, queries, embedder, depth), bm25.bm25_topk(corpus, queries, depth)
    cut = lambda rows: rows.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    return union({"dense": cut(near), "bm25": cut(lexical), "hybrid": cut(fusion.rrf(near, lexical, k))})


def embedder_matrix(corpus: DataFrame, queries: DataFrame, embedders: tuple[str, ...], k: int = 10) -> DataFrame:
    """Ranked lists of dense retrieval, by embedder."""
    return union({name: _dense(corpus, queries, name, k).select("query_id", "doc_id", "rank") for name in embedders})


def chunking_matrix(corpus: DataFrame, queries: DataFrame, sizes: tuple[tuple[int, int], ...], k: int = 10) -> DataFrame:
    """(variant, query_id, doc_id, chunk_i, rank): lexical retrieval of chunks, by their size
    and overlap."""
    parts = {}
    for size, overlap in sizes:
        chunks = chunkers.token_chunks(corpus, size, overlap)
        keyed = chunks.select((F.col("doc_id") * 1_000_000 + F.col("chunk_i")).alias("doc_id"), "text")
        found = bm25.bm25_topk(keyed, queries, k)
        parts[f"token_{size}_{overlap}"] = found.select("query_id", F.floor(F.col("doc_id") / 1_000_000).alias("doc_id"), (F.col("doc_id") % 1_000_000).cast("int").alias("chunk_i"), "rank")
    return union(parts)


def reranker_matrix(ranked: DataFrame, rerankers: tuple[str, ...] = ("none", "overlap")) -> DataFrame:
    """Lists (query_id, query, text, rank, ...) in the order of each reranker; ties keep theirs."""
    parts = {}
    for name in rerankers:
        if name == "none":
            parts[name] = ranked
            continue
        score = F.round(overlap_coefficient(terms(F.col("query")), terms(F.col("text"))), 6) if name == "overlap" else None
        rows = ranked.withColumn("score_rerank", score) if score is not None else models.reranked(ranked, "query", "text", name)
        order = Window.partitionBy("query_id").orderBy(F.col("score_rerank").desc(), "rank")
        parts[name] = rows.withColumn("rank", F.row_number().over(order)).drop("score_rerank")
    return union(parts)


def cleaning_matrix(corpus: DataFrame, profiles: tuple[str, ...]) -> DataFrame:
    """The summary of each cleaning profile."""
    return union({p: cleaning.summary(cleaning.with_report(cleaning.cleaned(corpus, p))) for p in profiles}, "profile")


def chunk_tag(method: Column, size: Column, overlap: Column) -> Column:
    """``method_size_overlap``, or ``parentN_childN`` with the two sizes."""
    return F.when(method == "parent_child", F.format_string("parent%d_child%d", size, overlap)).otherwise(F.format_string("%s_%d_%d", method, size, overlap))


def collection_name(model: Column, tag: Column, prefix: str = "rag_chunks") -> Column:
    """The collection of an embedder's points; of a model's path the last part counts."""
    short = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(model, "/"), -1)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", F.lit(prefix), short, tag)


def points(corpus: DataFrame, profile: str = "clean_legal", size: int = 1024, overlap: int = 128, embedder: str = "hashing") -> DataFrame:
    """The points of a reindex: texts cleaned, cut, embedded and named.

    ``corpus``: ``doc_id, source, text``.  (doc_id, source, chunk_i, point_id, text, vector,
    removed_ratio, collection); what cleaning removed travels with each chunk.
    """
    clean = cleaning.with_report(cleaning.cleaned(corpus.select(F.struct("doc_id", "source").alias("doc"), "text"), profile, "doc"))
    cut = clean.select("doc.doc_id", "doc.source", "removed_ratio", F.posexplode(chunkers.windows(F.col("text"), size, overlap)).alias("chunk_i", "text")).filter(F.trim("text") != "")
    named = cut.withColumn("point_id", chunkers.point_id(F.col("source"), F.col("doc_id"), F.lit("token"), F.lit(size), F.lit(overlap), F.col("chunk_i")))
    named = named.withColumn("collection", collection_name(F.lit(embedder), chunk_tag(F.lit("token"), F.lit(size), F.lit(overlap))))
    return models.embedded(named, "text", embedder)


def reindex(corpus: DataFrame, old: DataFrame | None, path: str, dimension: int, **how) -> None:
    """Write the points of a corpus to a collection: those of its documents are replaced, others
    stay.  ``old`` is the collection so far (None: it is made); vectors of another size are an
    error before anything is replaced."""
    fresh = registry.assert_dimension(points(corpus, **how), dimension)
    if old is not None:
        fresh = old.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)
    swap_table(fresh, path)


def marked_indexed(rows: DataFrame, indexed: DataFrame, now: Column) -> DataFrame:
    """Registry rows with the index time of the ids in ``indexed (id)``."""
    ids = indexed.select("id", F.lit(True).alias("_hit")).distinct()
    return rows.join(ids, "id", "left").withColumn("indexed_at", F.when(F.col("_hit"), now).otherwise(F.col("indexed_at"))).drop("_hit")


def previews(cleaned_texts: DataFrame, n: int = 20) -> DataFrame:
    """The first documents by key with their text before and after cleaning, to look at."""
    return cleaned_texts.orderBy(cleaned_texts.columns[0]).limit(n)


# How a judge is shown what was retrieved.
NO_CONTEXT, NO_LABELS = "Найденный контекст отсутствует.", "Метки эталонной релевантности недоступны для этого JSONL."


def judge_context(retrieved: Column, labels: bool = True) -> Column:
    """The retrieved chunks with their labels, as a judge reads them; without ``labels`` in the
    records a note says so first."""
    label = lambda r: F.coalesce(r["relevance_label"], F.when(r["is_gold_relevant"], "gold_relevant").otherwise("unknown"))
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def part(r: Column, i: Column) -> Column:
        return F.concat(
            F.lit("[Чанк "), (i + 1).cast("string"), F.lit("]\nЭталонная релевантность: "), label(r), F.lit("\nУровень совпадения: "), F.coalesce(F.nullif(r["relevance_match_level"], F.lit("")), F.lit("none")),
            F.lit("\nИсточник: source_code="), none(r["source_code"]), F.lit(", external_id="), none(r["external_id"]), F.lit(", chunk_i="), none(r["chunk_i"]), F.lit("\nТекст:\n"), F.trim(F.coalesce(r["text"], F.lit(""))),
        )

    parts = F.array_join(F.transform(retrieved, part), "\n\n")
    return F.when(F.size(F.coalesce(retrieved, F.array())) == 0, NO_CONTEXT).otherwise(parts if labels else F.concat(F.lit(f"{NO_LABELS}\n\n"), parts))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax over the logits of two answers."""
    return 1 / (1 + F.exp(no - yes))


def valid_reports(metrics: DataFrame, retrieved: DataFrame, keys: list[str], required: tuple[str, ...]) -> DataFrame:
    """(keys, valid): reports that have every required metric, some of it above 0, and at least
    one query that retrieved something.  ``retrieved``: keys and ``n`` for each query."""
    values = F.array(*(F.col(c).cast("double") for c in required))
    whole = metrics.groupBy(*keys).agg(F.bool_and(F.forall(values, lambda x: x.isNotNull())).alias("_all"), F.bool_or(F.exists(values, lambda x: x != 0)).alias("_some"))
    some = retrieved.groupBy(*keys).agg(F.bool_or(F.coalesce("n", F.lit(0)) > 0).alias("_found"))
    return whole.join(some, keys, "left").select(*keys, (F.col("_all") & F.coalesce("_some", F.lit(False)) & F.coalesce("_found", F.lit(False))).alias("valid"))
