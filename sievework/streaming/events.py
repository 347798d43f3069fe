"""Streams over logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.durable import drop_path, durable, new_path
from sievework.operators import registry


def table_stream(spark: SparkSession, folder: str, table: str, files: int = 8) -> DataFrame:
    """The files of a table as a stream, some at a time."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # As a pattern the path may be one file or a folder of files.
    pattern = f"{folder}/{table[:-1]}[{table[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def event_windows(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, group, n): counts per window; rows later than the watermark are dropped."""
    # A time without zone is taken as one of the session's zone; watermarks need it so.
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All there is now, run through the stream, as a table."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that comes again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return rows.drop("batch") if mode != "complete" else rows


#: Parts by hash of the key in which a streamed table is kept.
PARTS = 16


class Versions:
    """A table in parts whose versions are the numbers of micro-batches.

    A batch writes the parts its rows fall into as ``v<number>/part=<p>``; the table is the
    latest version of each part.  What is current is read from the folder, not kept by the
    driver, so a stream that starts again on the same root goes on where it was; a batch that
    comes again replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _names(self, path: str, prefix: str) -> list[int]:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(target):
            return []
        names = [f.getPath().getName() for f in files.listStatus(target)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _whole(self, version: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def current(self, before: int | None = None) -> dict[int, int]:
        """The version of each part, of batches below ``before``."""
        out: dict[int, int] = {}
        for v in self._names(self.root, "v"):
            if (before is None or v < before) and self._whole(v):
                out |= {p: v for p in self._names(f"{self.root}/v{v}", "part=")}
        return out

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        held = self.current(before)
        paths = [f"{self.root}/v{v}/part={p}" for p, v in held.items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(PARTS)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts rows fall into: at most PARTS numbers."""
        return sorted(r[0] for r in rows.select(self.part().alias("p")).distinct().collect())

    def write(self, rows: DataFrame, number: int) -> None:
        """The new version of the parts of ``rows``; of each part the one before is kept, as the
        batch may come again, older ones are removed."""
        held = self.current(number)
        rows.select("*", self.part().alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/v{number}")
        for v in self._names(self.root, "v"):
            if v < number:
                parts = self._names(f"{self.root}/v{v}", "part=")
                for p in parts:
                    if held.get(p, v) > v:
                        drop_path(self.spark, f"{self.root}/v{v}/part={p}")
                if all(held.get(p, v) > v for p in parts):
                    drop_path(self.spark, f"{self.root}/v{v}")


class Refresh:
    """Last content hash of each document, kept up to date by micro-batches.

    Out-of-order and repeated fetches change nothing: of each document the row with the latest
    ``fetched_at`` (then ``id``) stays, whatever batch it comes in.
    """

    _SCHEMA = "doc_id bigint, fetched_at timestamp, id bigint, body_sha256 string"

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or new_path(spark, "refresh")
        self.table = Versions(spark, f"{self.root}/state", self._SCHEMA, "doc_id")

    def state(self) -> DataFrame:
        return self.table.read()

    def merge(self, batch: DataFrame, number: int) -> None:
        full = batch.filter("doc_id is not null and body_sha256 is not null").select("doc_id", "fetched_at", "id", "body_sha256")
        old = self.table.read(number, self.table.touched(full))
        kept = old.unionByName(full).groupBy("doc_id").agg(F.max(F.struct("fetched_at", "id", "body_sha256")).alias("v")).select("doc_id", "v.*")
        self.table.write(kept, number)

    def run(self, fetches: DataFrame, once: bool = True, every: str = "24 hours") -> StreamingQuery:
        trigger = {"availableNow": True} if once else {"processingTime": every}
        return fetches.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/progress").trigger(**trigger).start()


class RegistryRefresh:
    """The registry and the points of its documents, kept up to date by micro-batches of fetches.

    A batch takes the latest answer of each document, tells whether its content changed, merges
    hash, revision and schedule into the registry, and replaces the points of the documents
    that changed.  ``make_points(changed)`` gives the points (``point_id, doc_id`` and what
    else ``points_schema`` has) of ``changed (doc_id, sha)``.
    """

    def __init__(self, spark: SparkSession, registry_rows: DataFrame, make_points, points_schema: str, now: Column, root: str | None = None):
        self.spark, self.root = spark, root or new_path(spark, "registry-refresh")
        self.now, self.make_points = now, make_points
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in registry_rows.schema)
        self.rows = Versions(spark, f"{self.root}/registry", schema, "id")
        self.points = Versions(spark, f"{self.root}/points", points_schema, "doc_id")
        if not self.rows.current():
            self.rows.write(registry_rows, 0)

    def merge(self, batch: DataFrame, number: int) -> None:
        number += 1  # version 0 is the registry the stream began with
        answers = batch.filter("doc_id is not null and status_code in (200, 304)")
        last = registry.latest_values(answers, ["doc_id"], ["fetched_at", "id"], ["status_code", "body_sha256", "resp_etag", "resp_last_mod"])
        fetched = durable(last.withColumnRenamed("doc_id", "id"), "fetched")
        old = self.rows.read(number, self.rows.touched(fetched))
        keyed = fetched.join(old.select("id", "source_code", "external_id"), "id")
        status = registry.change_status(keyed.select("id", "source_code", "external_id", F.col("body_sha256").alias("sha"), (F.col("status_code") == 304).alias("not_modified"), "resp_etag", "resp_last_mod"), old.filter("external_id is not null"))
        changes = durable(status.select("id", "sha", F.col("resp_etag").alias("etag"), F.col("resp_last_mod").alias("last_mod"), F.lit(7).alias("freq"), "status"), "changes")
        self.rows.write(registry.merged_content(old, changes, self.now), number)
        changed = changes.filter(F.col("status").isin("INGESTED", "UPDATED")).select(F.col("id").alias("doc_id"), "sha")
        fresh = self.make_points(changed)
        before = self.points.read(number, self.points.touched(changed))
        kept = before.join(changed.select("doc_id"), "doc_id", "left_anti")
        self.points.write(registry.upserted(kept, fresh.withColumn("seq", F.lit(1))), number)

    def run(self, fetches: DataFrame) -> StreamingQuery:
        return fetches.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()


_KEYED = "doc_id bigint, body_sha256 string, revisions bigint, errors bigint"


def document_state(fetches: DataFrame) -> DataFrame:
    """(doc_id, body_sha256, revisions, errors): keyed state of a stream of fetches.

    The last hash of a document, how often it changed, and how many fetches in a row failed
    since the last answer; within a batch fetches count in the order of ``fetched_at, id``.
    Emitted is the state after each batch that holds the document.
    """

    def step(key, frames, state: GroupState):
        known, revisions, errors = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames))
        for sha, status in rows.sort_values(["fetched_at", "id"])[["body_sha256", "status_code"]].itertuples(index=False):
            if status in (200, 304):
                errors = 0
                if isinstance(sha, str) and status == 200 and sha != known:
                    known, revisions = sha, revisions + 1
            else:
                errors += 1
        state.update((known, revisions, errors))
        yield pd.DataFrame({"doc_id": [key[0]], "body_sha256": [known], "revisions": [revisions], "errors": [errors]})

    rows = fetches.filter("doc_id is not null").select("doc_id", "id", "fetched_at", F.coalesce("status_code", F.lit(0)).alias("status_code"), "body_sha256")
    return rows.groupBy("doc_id").applyInPandasWithState(step, _KEYED, "known string, revisions bigint, errors bigint", "update", GroupStateTimeout.NoTimeout)
