"""Tables that outlive an executor: intermediate results kept in the shared folder.

A plan that is read more than once, or that grows in a loop, is cut by writing it as
Parquet under ``spark.checkpoint.dir``.  Unlike cached blocks the files are visible to all
executors, so the loss of one costs nothing but the running task.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a master of ``local`` gets a private folder, once per process, which is
    removed when the process ends; on a cluster it is an error, as executors would each write
    to a disk of their own.
    """
    global _own_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (lineage ends there).

    The table is needed as long as a plan that reads it may run, which only the caller knows:
    ``drop_tables`` removes what a session has written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def mark() -> int:
    """A point to which ``drop_tables`` goes back."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables written since a mark, when their results are stored."""
    while len(_written) > since:
        drop_path(spark, _written.pop())


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: it need not be installed there.

    The archive lies in the shared folder like every other file executors read.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    path = f"{shared_root(spark)}/code/{uuid.uuid4().hex[:12]}/{package.name}.zip"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target)
    out.write(archive.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def tune_arrow(spark: SparkSession, records: int = 1000) -> None:
    """Ready for Arrow functions: the package is shipped, and batches are small, as texts are
    long and a worker holds a batch or two at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
