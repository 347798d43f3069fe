"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table carries.

    Operators call this first, so further columns cannot clash with the names they make up.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each key (the least, where rows differ); rows without a key are left out.

    Only the keys are shuffled, and the rows of keys that come more than once: few in a table
    with a key, so its texts stay where they are.
    """
    rows = df.filter(F.col(key).isNotNull())
    twice = rows.groupBy(key).count().filter("count > 1").select(key)
    rest = [c for c in df.columns if c != key]
    again = rows.join(twice, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return rows.join(twice, key, "left_anti").unionByName(again)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the scan has no more splits than there are cores.

    A small table may be one row group, which one task would read and work on alone; a table
    of many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
