"""Lines repeated across the documents of one source.

The state is a set of tables in the shared folder: for every record its line keys, for every
(source, key) the number of records that hold it, and for every source its number of records.
New records are merged as deltas: only their lines are read, their counts are added to the
stored ones, and the keys whose standing changes name the records that must be rebuilt.

A line is a piece of text between LF characters, numbered from 0.  Its key is its letters,
lower-cased, with the letter io written as ie; a line without letters has no key.  A key is a
case in a source when it stands in at least ``min_records`` records and in at least
``min_share`` of the source's records.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.durable import drop_path, durable, new_path
from sievework.sources import one_each, with_columns

MIN_RECORDS = 5
MIN_SHARE = 0.20
#: Parts in which a whole table is merged, and parts by source in which counts are kept.
DELTAS, PARTS = 4, 16
#: Rows of two numbers that are sent to every executor instead of being joined by key.
FEW = 200_000


def line_keys(text: Column) -> Column:
    """array<bigint>: the key of each line."""
    return F.transform(F.split(text, "\n", -1), line_key)


def line_key(line: Column) -> Column:
    """The 64-bit hash of a line's letters, null where it has none."""
    letters = F.regexp_replace(F.translate(F.lower(line), "ё", "е"), r"\P{L}+", "")
    return F.when(letters != "", F.xxhash64(letters))


class LineCounts:
    """Incremental line counts per source.

    ``merge(records)`` takes a DataFrame with ``doc_id, source_code, text`` (other columns are
    ignored) and returns ``(doc_id, source_code, key, was, now)`` for the affected records only.

    Nulls: a null ``doc_id`` is no record and is left out; a null ``text`` is a record without
    lines (it counts in the source's number of records); a null ``source_code`` is a source of
    its own.  Repeated rows of one ``doc_id`` count once within a delta.  A record that comes
    again in a later delta with other lines or another source takes the place of the earlier
    one; unchanged it changes nothing.  An empty delta changes nothing.

    Counts are kept in PARTS parts by hash of the source; a merge reads and rewrites the parts
    of the sources that are in the delta.  Nothing is in place before a merge ends, and every
    write replaces what a failed one left, so a merge can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE):
        if min_records < 1 or not 0 <= min_share <= 1:
            raise ValueError("min_records must be at least 1 and min_share between 0 and 1")
        self.spark, self.root = spark, root or new_path(spark, "line-counts")
        self.min_records, self.min_share = min_records, min_share
        #: Paths of the deltas' records; by delta the ids it replaced; by part the latest version.
        self.deltas: list[str] = []
        self.replaced: dict[int, str] = {}
        self.parts: dict[int, int] = {}
        self.version = 0

    _RECORDS = "doc_id bigint, source_code string, keys array<bigint>"
    _COUNTS = "source_code string, key bigint, records bigint"
    _SIZES = "source_code string, total bigint"

    def _counts(self, parts: list[int]) -> DataFrame:
        paths = [f"{self.root}/counts/v{self.parts[p]}/part={p}" for p in parts if p in self.parts]
        return self.spark.read.schema(self._COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], self._COUNTS)

    def _sizes(self) -> DataFrame:
        return self.spark.read.schema(self._SIZES).parquet(f"{self.root}/sizes/v{self.version}") if self.version else self.spark.createDataFrame([], self._SIZES)

    def records(self) -> DataFrame:
        """Every record merged so far with its line keys, one row each."""
        if not self.deltas:
            return self.spark.createDataFrame([], self._RECORDS)
        read = self.spark.read.schema(self._RECORDS)
        if not self.replaced:
            return read.parquet(*self.deltas)
        gone = None
        for d, path in self.replaced.items():
            ids = self.spark.read.schema("doc_id bigint").parquet(path).select(F.col("doc_id").alias("again"), F.lit(d).alias("later"))
            gone = ids if gone is None else gone.unionByName(ids)
        rows = None
        for d, path in enumerate(self.deltas):
            own = read.parquet(path).withColumn("d", F.lit(d))
            rows = own if rows is None else rows.unionByName(own)
        if self._few(gone):
            gone = F.broadcast(gone)
        return rows.join(gone, (F.col("doc_id") == F.col("again")) & (F.col("d") < F.col("later")), "left_anti").drop("d")

    def _cases(self, counts: DataFrame, sizes: DataFrame) -> DataFrame:
        frequent = counts.filter(F.col("records") >= self.min_records)
        return (
            frequent.join(F.broadcast(sizes) if self._few(sizes) else sizes, frequent.source_code.eqNullSafe(sizes.source_code))
            .filter(F.col("records") >= F.lit(self.min_share) * F.col("total"))
            .select(frequent.source_code, "key")
        )

    def _few(self, df: DataFrame) -> bool:
        """Whether a table is small enough to be sent to every executor (about 8 MB)."""
        return df.limit(FEW + 1).count() <= FEW

    def merge(self, records: DataFrame) -> DataFrame:
        number = len(self.deltas)
        delta, version = f"{self.root}/records/d{number}", self.version + 1
        keyed = with_columns(records, "doc_id", "source_code", "text").filter("doc_id is not null").select("doc_id", "source_code", line_keys(F.col("text")).alias("keys"))
        # Only hashes travel: a record is some hundred bytes here, its text some thousand.
        fresh = keyed.groupBy("doc_id").agg(F.min(F.struct("source_code", "keys")).alias("r")).select("doc_id", "r.source_code", "r.keys")
        before = None
        if self.deltas:
            # Of records that are known only those that changed are merged again.
            known = self.records().select("doc_id", F.col("source_code").alias("old_source"), F.col("keys").alias("old_keys"), F.lit(True).alias("known"))
            both = fresh.join(known, "doc_id", "left")
            same = F.col("old_source").eqNullSafe(F.col("source_code")) & F.col("old_keys").eqNullSafe(F.col("keys"))
            both = both.withColumn("known", F.coalesce("known", F.lit(False))).filter(~(F.col("known") & same))
            both.write.mode("overwrite").parquet(f"{delta}-met")
            both = self.spark.read.schema(both.schema).parquet(f"{delta}-met")
            fresh = both.select("doc_id", "source_code", "keys")
            changed = both.filter("known").select("doc_id", F.col("old_source").alias("source_code"), F.col("old_keys").alias("keys"))
            if not changed.isEmpty():
                before = changed
        fresh.write.mode("overwrite").parquet(delta)
        fresh = self.spark.read.schema(self._RECORDS).parquet(delta)
        moves = fresh.withColumn("n", F.lit(1))
        if before is not None:
            before.select("doc_id").write.mode("overwrite").parquet(f"{delta}-replaced")
            moves = moves.unionByName(before.withColumn("n", F.lit(-1)))

        part = F.pmod(F.xxhash64("source_code"), F.lit(PARTS)).cast("int").alias("part")
        touched = sorted(r[0] for r in moves.select(part).distinct().collect())  # at most PARTS numbers
        old_counts, old_sizes = self._counts(touched), self._sizes()
        per_key = moves.select("source_code", F.explode(F.array_distinct("keys")).alias("key"), "n").filter("key is not null").groupBy("source_code", "key").agg(F.sum("n").alias("records"))
        per_source = moves.groupBy("source_code").agg(F.sum("n").alias("total"))
        if self.version:
            per_key = old_counts.unionByName(per_key).groupBy("source_code", "key").agg(F.sum("records").alias("records")).filter("records > 0")
            per_source = old_sizes.unionByName(per_source).groupBy("source_code").agg(F.sum("total").alias("total"))
        per_key.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/counts/v{version}")
        per_source.write.mode("overwrite").parquet(f"{self.root}/sizes/v{version}")
        was = self._cases(old_counts, old_sizes) if self.version else None

        # The merge is in place; a part left without a count has no folder.
        held = {p for p in touched if self._exists(f"{self.root}/counts/v{version}/part={p}")}
        self.parts = {p: v for p, v in self.parts.items() if p not in touched} | {p: version for p in held}
        self.version = version
        self.deltas.append(delta)
        if before is not None:
            self.replaced[number] = f"{delta}-replaced"

        now = self._cases(self._counts(touched), self._sizes()).withColumn("now", F.lit(True))
        if was is None:
            moved = now.withColumn("was", F.lit(False))
        else:
            n, b = now.alias("n"), was.withColumn("was", F.lit(True)).alias("b")
            moved = (
                n.join(b, F.col("n.source_code").eqNullSafe(F.col("b.source_code")) & (F.col("n.key") == F.col("b.key")), "full_outer")
                .select(F.when(F.col("n.now"), F.col("n.source_code")).otherwise(F.col("b.source_code")).alias("source_code"), F.coalesce("n.key", "b.key").alias("key"), F.coalesce("b.was", F.lit(False)).alias("was"), F.coalesce("n.now", F.lit(False)).alias("now"))
                .filter("was or now")
            )
        moved = moved.select("source_code", "key", "was", "now")
        path = f"{self.root}/moved/v{version}"
        moved.write.mode("overwrite").parquet(path)
        moved = self.spark.read.schema("source_code string, key bigint, was boolean, now boolean").parquet(path)
        if was is None:
            return self._holding(moved)
        # Records of earlier deltas need work only for keys that changed, new ones for all cases.
        latest = self.spark.read.schema(self._RECORDS).parquet(delta).select("doc_id")
        return self._holding(moved.filter("was <> now")).unionByName(self._holding(moved.filter("was and now")).join(latest, "doc_id", "left_semi"))

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _holding(self, keys: DataFrame) -> DataFrame:
        held = self.records().select("doc_id", "source_code", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null").alias("h")
        k = keys.alias("k")
        if self._few(keys):
            k = F.broadcast(k)
        return held.join(k, (F.col("h.key") == F.col("k.key")) & F.col("h.source_code").eqNullSafe(F.col("k.source_code"))).select("doc_id", "h.source_code", "h.key", "k.was", "k.now")

    def cases(self) -> DataFrame:
        """(source_code, key) above the thresholds, by the counts merged so far."""
        return self._cases(self._counts(list(self.parts)), self._sizes())

    def occurrences(self) -> DataFrame:
        """(doc_id, line_no) of every line to remove, over all records merged so far."""
        lines = self.records().select("doc_id", "source_code", F.posexplode("keys").alias("line_no", "key")).filter("key is not null").alias("l")
        cases = self.cases().alias("c")
        if self._few(cases):
            cases = F.broadcast(cases)
        return lines.join(cases, (F.col("l.key") == F.col("c.key")) & F.col("l.source_code").eqNullSafe(F.col("c.source_code")), "left_semi").select("doc_id", "line_no")

    def save(self) -> str:
        """What a later session needs to go on: pass the string to ``resume``."""
        return json.dumps({k: getattr(self, k) for k in ("root", "deltas", "replaced", "parts", "version", "min_records", "min_share")})

    @classmethod
    def resume(cls, spark: SparkSession, saved: str) -> "LineCounts":
        s = json.loads(saved)
        state = cls(spark, s["root"], s["min_records"], s["min_share"])
        state.deltas, state.version = s["deltas"], s["version"]
        state.replaced, state.parts = ({int(k): v for k, v in s[n].items()} for n in ("replaced", "parts"))
        return state

    def drop(self) -> None:
        drop_path(self.spark, self.root)


def merged(records: DataFrame, state: LineCounts, deltas: int = DELTAS) -> DataFrame | None:
    """Merges a whole table in parts by hash of doc_id; (doc_id) of the records the parts named."""
    records, named = with_columns(records, "doc_id", "source_code", "text").filter("doc_id is not null"), None
    for k in range(deltas):
        ids = state.merge(records.filter(F.pmod(F.xxhash64("doc_id"), F.lit(deltas)) == k)).select("doc_id")
        named = ids if named is None else named.unionByName(ids)
    return named


def repeated_lines(records: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, deltas: int = DELTAS) -> DataFrame:
    """(doc_id, line_no) of the lines that repeat within their source; see ``LineCounts``.

    The table is merged in ``deltas`` parts; the counts left by the last one decide.
    """
    state = LineCounts(records.sparkSession, min_records=min_records, min_share=min_share)
    merged(records, state, deltas)
    return state.occurrences()


def without_lines(records: DataFrame, state: LineCounts, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): texts without the lines that are cases now.

    ``only`` (``doc_id``) restricts the work to affected records, as ``merge`` names them.
    A text none of whose lines is a case comes back unchanged, a null text stays null; of rows
    with one doc_id the least counts.

    A case stands in a large share of its source's records, so a source has few: they are sent
    along as one array for each source and the texts are cut where they lie.  With more sources
    than can be sent the numbers of the lines are joined by doc_id.
    """
    texts = with_columns(records, "doc_id", "source_code", "text").filter("doc_id is not null")
    if only is not None:
        texts = texts.join(F.broadcast(only.select("doc_id")) if state._few(only) else only.select("doc_id"), "doc_id", "left_semi")
    texts = one_each(texts, "doc_id")
    cases = durable(state.cases(), "cases")
    if state._few(cases):
        gone = F.broadcast(cases.groupBy(F.col("source_code").alias("of")).agg(F.collect_list("key").alias("gone")))
        joined = texts.join(gone, F.col("source_code").eqNullSafe(F.col("of")), "left")
        kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line: ~F.coalesce(F.array_contains(F.col("gone"), line_key(line)), F.lit(False))), "\n")
        return joined.select("doc_id", F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"))
    drop = state.occurrences().groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return texts.join(drop, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"))


def cleaned_by_deltas(records: DataFrame, deltas: int = DELTAS) -> DataFrame:
    """(doc_id, text) of all records, as ``without_lines`` gives it, kept up over deltas.

    The table is merged in parts by hash of doc_id, and ``merge`` names the records each part
    affects, of it or of earlier ones.  The named records are rebuilt once all parts are in, as
    only their last texts are wanted; one never named keeps its own text.
    """
    records = with_columns(records, "doc_id", "source_code", "text").filter("doc_id is not null")
    state = LineCounts(records.sparkSession)
    named = durable(merged(records, state, deltas).distinct(), "named")
    untouched = records.select("doc_id", "text").join(F.broadcast(named) if state._few(named) else named, "doc_id", "left_anti")
    return without_lines(records, state, named).unionByName(one_each(untouched, "doc_id"))
