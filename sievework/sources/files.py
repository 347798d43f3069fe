"""File sources and sinks: corpora of text files, JSON lines, score sheets, keyed tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.functions.text import present, strip

# Names under which a corpus record keeps its fields.
TEXT_KEYS, SOURCE_KEYS = ("text", "content", "body", "raw_text", "clean_text"), ("source_code", "source")
ID_KEYS, URL_KEYS = ("external_id", "id"), ("canonical_url", "url", "source_url", "doc_url")


def text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(source_code, external_id, text, path) of the .txt and .md files under ``root``.

    The source is the first folder; the id is the folder of a ``doc.txt``, else the path without
    its extension.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").format("text").option("wholetext", "true").load(root)
    prefix = re.sub("^[a-z0-9]+:(?://[^/]*)?", "", root.rstrip("/"))
    inner = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:(?://[^/]*)?", "")
    relative = F.ltrim(F.replace(F.url_decode(inner), F.lit(prefix), F.lit("")), F.lit("/"))
    parts = F.split(relative, "/")
    external = F.when(relative.rlike(r"(^|/)doc\.txt$"), F.element_at(parts, -2)).otherwise(F.regexp_replace(relative, r"\.[^./]+$", ""))
    return files.select(F.get(parts, F.lit(0)).alias("source_code"), external.alias("external_id"), F.col("value").alias("text"), relative.alias("path"))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_code, external_id, text, canonical_url) of JSON files: a record, a list of
    records, or a record with a list under documents, items or rows."""
    names = (*TEXT_KEYS, *SOURCE_KEYS, *ID_KEYS, *URL_KEYS)
    record = ", ".join(f"{n} string" for n in dict.fromkeys(names))
    inner = f"array<struct<{record.replace(' string', ': string')}>>"
    raw = spark.read.schema(f"{record}, documents {inner}, items {inner}, `rows` {inner}").option("multiLine", "true").json(path)
    own = F.array(F.struct(*(F.col(n) for n in dict.fromkeys(names))))
    each = raw.select(F.explode(F.coalesce("documents", "items", "rows", own)).alias("r")).select("r.*")
    pick = lambda keys: present(*map(F.col, keys))
    return each.select(pick(SOURCE_KEYS).alias("source_code"), pick(ID_KEYS).alias("external_id"), pick(TEXT_KEYS).alias("text"), pick(URL_KEYS).alias("canonical_url")).filter("text is not null")


def usable_documents(corpus: DataFrame, least: int = 100) -> DataFrame:
    """Records of at least ``least`` characters, the first of each (source, id) by text."""
    w = Window.partitionBy("source_code", "external_id").orderBy("text")
    return corpus.filter(F.length(strip(F.col("text"))) >= least).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a bad line is an error if strict, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def score_sheet(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV of reviews: columns checked, a byte-order mark ignored, scores -1 or 1 to 5."""
    sheet = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    sheet = sheet.toDF(*(c.removeprefix("﻿") for c in sheet.columns))
    if missing := [c for c in required if c not in sheet.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    scores = [c for c in sheet.columns if c.startswith("human_") and not c.endswith("comment")]
    for c in scores:
        value = F.col(c).try_cast("int")
        sheet = sheet.withColumn(c, F.when(value.between(1, 5) | (value == -1), value).otherwise(F.raise_error(F.concat(F.lit(f"invalid {c}: "), F.coalesce(F.col(c), F.lit("null"))))))
    return sheet


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def swap_table(fresh: DataFrame, path: str) -> None:
    """Replace a Parquet table by rows that may have been read from it.

    The rows are written beside it; then the old table is renamed away and the new one takes
    its name.  A failure in between leaves both, and ``restored_table`` puts the old one back.
    """
    spark, base = fresh.sparkSession, path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, old, beside = hadoop(base), hadoop(f"{base}.old"), hadoop(f"{base}-{uuid.uuid4().hex[:8]}")
    fresh.write.parquet(beside.toString())
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(old, True)
        files.rename(target, old)
    files.rename(beside, target)
    files.delete(old, True)


def restored_table(spark: SparkSession, path: str) -> DataFrame:
    """The table; where a swap broke off after the old one was renamed away, the old one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, old = hadoop(path.rstrip("/")), hadoop(f"{path.rstrip('/')}.old")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target) and files.exists(old):
        files.rename(old, target)
    return spark.read.parquet(path)
