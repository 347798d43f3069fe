"""The document registry: change detection, merge, schedule, points of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.numbers import backoff_days, days_after


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in the order given (put ties into the order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_values(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As ``latest`` in descending order, by partial aggregation: for keys that hold a large
    part of all rows nothing is sorted and only one row of each task is shuffled."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_v"))
    return best.select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def once(log: DataFrame, same: list[str]) -> DataFrame:
    """Log rows without the second of double writes: same content under a later id."""
    return log.groupBy(*same).agg(F.min("id").alias("id"))


def change_status(fetched: DataFrame, registry: DataFrame) -> DataFrame:
    """(key columns, status) of each fetched document.

    ``fetched``: ``source_code, external_id, sha, not_modified``; ``registry``:
    ``source_code, external_id, content_sha256``.
    """
    known = registry.select("source_code", "external_id", "content_sha256", F.lit(True).alias("known"))
    joined = fetched.join(known, ["source_code", "external_id"], "left")
    status = (
        F.when(F.coalesce("not_modified", F.lit(False)), "SKIP_NOT_MODIFIED").when(F.col("known").isNull(), "INGESTED").when(F.col("content_sha256") == F.col("sha"), "SKIP_UNCHANGED").otherwise("UPDATED")
    )
    return joined.withColumn("status", status)


def insert_missing(registry: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The registry with the rows whose keys it does not have; existing ones stay as they are."""
    fresh = rows.dropDuplicates(keys).join(registry.select(*keys), keys, "left_anti")
    return registry.unionByName(fresh, allowMissingColumns=True)


def merged_content(registry: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Registry rows after fetches: ``changes (id, sha, etag, last_mod, freq, status)``.

    Changed content gets its hash, the next revision and no index time; all fetched rows get a
    new check time, the validators that came (else the old ones stay) and no errors.
    """
    r, c = registry.alias("r"), changes.alias("c")
    joined = r.join(c, F.col("r.id") == F.col("c.id"), "left")
    hit, changed = F.col("c.id").isNotNull(), F.coalesce(F.col("c.status").isin("INGESTED", "UPDATED"), F.lit(False))
    new = {
        "content_sha256": F.when(changed, F.col("c.sha")).otherwise(F.col("r.content_sha256")),
        "qdrant_revision": F.when(changed, F.coalesce("r.qdrant_revision", F.lit(0)) + 1).otherwise(F.col("r.qdrant_revision")),
        "indexed_at": F.when(~changed, F.col("r.indexed_at")),
        "http_etag": F.when(hit, F.coalesce("c.etag", "r.http_etag")).otherwise(F.col("r.http_etag")),
        "http_last_mod": F.when(hit, F.coalesce("c.last_mod", "r.http_last_mod")).otherwise(F.col("r.http_last_mod")),
        "next_check_at": F.when(hit, days_after(now, F.coalesce("c.freq", F.lit(7)))).otherwise(F.col("r.next_check_at")),
        "last_fetch_at": F.when(hit, now).otherwise(F.col("r.last_fetch_at")),
        "error_count": F.when(hit, F.lit(0)).otherwise(F.col("r.error_count")),
        "last_error": F.when(~hit, F.col("r.last_error")),
    }
    return joined.select(*(new[n].alias(n) if n in new else F.col(f"r.{n}") for n in registry.columns))


def marked_errors(registry: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """One more error on the rows of ``errors (id, message, freq)``, and a later next check."""
    joined = registry.alias("r").join(errors.alias("e"), F.col("r.id") == F.col("e.id"), "left")
    hit, count = F.col("e.id").isNotNull(), F.coalesce("r.error_count", F.lit(0)) + 1
    new = {
        "error_count": F.when(hit, count).otherwise(F.col("r.error_count")),
        "last_error": F.when(hit, F.left("e.message", F.lit(500))).otherwise(F.col("r.last_error")),
        "next_check_at": F.when(hit, days_after(now, backoff_days(F.coalesce("e.freq", F.lit(7)), count))).otherwise(F.col("r.next_check_at")),
    }
    return joined.select(*(new[n].alias(n) if n in new else F.col(f"r.{n}") for n in registry.columns))


def due(registry: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Active documents never checked or due, those never checked first."""
    rows = registry.filter((F.lower("status") == "active") & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))).orderBy(F.col("next_check_at").asc_nulls_first(), "id")
    return rows.limit(limit) if limit else rows


def upserted(points: DataFrame, fresh: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with the fresh ones in place of those of the same id; of repeated ids the row with
    the highest ``seq`` stays."""
    return points.join(fresh.select(key), key, "left_anti").unionByName(latest(fresh, [key], F.col("seq").desc()).drop("seq"))


def without_documents(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points without those of the given documents."""
    return points.join(documents.select("source_code", "external_id").distinct(), ["source_code", "external_id"], "left_anti")


def assert_dimension(points: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """The points; reading one whose vector has another size raises an error."""
    fine = F.expr(f"if(size({vector}) = {size}, true, raise_error('vector size mismatch'))")
    return points.filter(F.col(vector).isNull() | fine)


def task_queue(tasks: DataFrame) -> DataFrame:
    """The one task of each document that may run: the lowest priority number, then the oldest."""
    return latest(tasks.filter(F.col("status").isin("pending", "running")), ["doc_id"], F.when(F.col("status") == "running", 0).otherwise(1), "priority", "id")
