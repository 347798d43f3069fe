import json
import os

import pytest
from pyspark.sql import functions as F

from sievework.sources import files, with_columns
from sievework.streaming.events import Refresh


def test_text_corpus(spark, tmp_path):
    (tmp_path / "src" / "d1").mkdir(parents=True)
    (tmp_path / "src" / "d1" / "doc.txt").write_text("текст\nдва")
    (tmp_path / "src" / "b.md").write_text("x")
    got = {(r.source_code, r.external_id): r.text for r in files.text_corpus(spark, str(tmp_path)).collect()}
    assert got == {("src", "d1"): "текст\nдва", ("src", "src/b"): "x"}


def test_json_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"documents": [{"id": "1", "body": "t1"}, {"external_id": "2", "text": "t2", "url": "u"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"source": "s", "id": "3", "content": "t3"}))
    got = sorted((r.external_id, r.text, r.canonical_url) for r in files.json_corpus(spark, str(tmp_path)).collect())
    assert got == [("1", "t1", None), ("2", "t2", "u"), ("3", "t3", None)]


def test_usable_documents(spark):
    rows = [("s", "1", "x" * 120), ("s", "1", "a" * 120), ("s", "2", " x " * 10), (None, "3", None)]
    got = files.usable_documents(spark.createDataFrame(rows, "source_code string, external_id string, text string")).collect()
    assert [r.text[0] for r in got] == ["a"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(p), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "a int").collect()


def test_score_sheet(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("﻿id,human_precision,human_comment\na,5,ok\nb,-1,\n", encoding="utf-8")
    assert [r.human_precision for r in files.score_sheet(spark, str(p), ("id", "human_precision")).orderBy("id").collect()] == [5, -1]
    with pytest.raises(ValueError):
        files.score_sheet(spark, str(p), ("id", "absent"))
    p.write_text("id,human_precision\na,9\n")
    with pytest.raises(Exception, match="invalid"):
        files.score_sheet(spark, str(p), ("id",)).collect()


def test_swap_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    files.swap_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_with_columns(spark):
    with pytest.raises(ValueError):
        with_columns(spark.range(1), "absent")


def test_refresh_is_idempotent(spark):
    rows = [(1, "2025-01-01", 1, "a"), (1, "2025-01-03", 2, "b"), (1, "2025-01-02", 3, "c"), (2, "2025-01-01", 4, None), (None, "2025-01-01", 5, "z")]
    batch = spark.createDataFrame(rows, "doc_id bigint, t string, id bigint, body_sha256 string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    r = Refresh(spark)
    for number, part in enumerate((batch.filter("id < 3"), batch.filter("id >= 2"), batch, batch.limit(0))):
        r.merge(part, number)
        r.merge(part, number)
        r = Refresh(spark, r.root)  # another driver on the same root knows the state
    assert [(x.doc_id, x.body_sha256) for x in r.state().collect()] == [(1, "b")]


def test_refresh_stops_and_starts_again(spark, tmp_path):
    """A stream that ends and starts on the same root goes on with its state."""
    schema = "doc_id bigint, fetched_at timestamp, id bigint, body_sha256 string"

    def arrive(number, rows):
        spark.createDataFrame(rows, "doc_id bigint, t string, id bigint, body_sha256 string").selectExpr("doc_id", "cast(t as timestamp) as fetched_at", "id", "body_sha256").coalesce(1).write.parquet(str(tmp_path / f"in{number}"))

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
        r = Refresh(spark, f"file://{tmp_path}/root")
        r.run(stream).awaitTermination()
        return sorted((x.doc_id, x.body_sha256) for x in r.state().collect())

    arrive(1, [(1, "2025-01-01", 1, "a"), (2, "2025-01-01", 2, "b")])
    assert run() == [(1, "a"), (2, "b")]
    arrive(2, [(1, "2025-01-02", 3, "c"), (2, "2024-01-01", 4, "old"), (3, "2025-01-01", 5, "d")])
    assert run() == [(1, "c"), (2, "b"), (3, "d")]


def test_registry_refresh_replaces_points(spark):
    from sievework.streaming.events import RegistryRefresh

    fields = "id bigint, source_code string, external_id string, content_sha256 string, qdrant_revision int, indexed_at timestamp, http_etag string, http_last_mod string, next_check_at timestamp, last_fetch_at timestamp, error_count int, last_error string"
    rows = spark.createDataFrame([(i, "s", f"e{i}", "x", 1, None, None, None, None, None, 3, "bad") for i in (1, 2, 3)], fields)
    points = lambda changed: changed.select(F.concat_ws(":", "doc_id", "sha").alias("point_id"), "doc_id")
    now = F.lit("2025-03-01").cast("timestamp")
    kind = "doc_id bigint, fetched_at timestamp, id bigint, status_code int, body_sha256 string, resp_etag string, resp_last_mod string"
    batch = lambda *r: spark.createDataFrame([(d, None, i, s, h, None, None) for d, i, s, h in r], kind)
    refresh = RegistryRefresh(spark, rows, points, "point_id string, doc_id bigint", now)
    for number, part in enumerate((batch((1, 1, 200, "y"), (2, 2, 304, None)), batch((1, 3, 200, "z"), (3, 4, 500, None)), batch((2, 5, 200, "q")))):
        refresh.merge(part, number)
        refresh.merge(part, number)  # a batch that comes again
        refresh = RegistryRefresh(spark, rows, points, "point_id string, doc_id bigint", now, refresh.root)
    assert sorted(tuple(r) for r in refresh.rows.read().select("id", "content_sha256", "qdrant_revision", "error_count").collect()) == [(1, "z", 3, 0), (2, "q", 2, 0), (3, "x", 1, 3)]
    assert sorted(r.point_id for r in refresh.points.read().collect()) == ["1:z", "2:q"]


def test_a_broken_swap_leaves_a_table(spark, tmp_path):
    from sievework.sources.files import restored_table, swap_table

    path = f"file://{tmp_path}/t"
    swap_table(spark.range(3), path)
    swap_table(spark.read.parquet(path).filter("id > 0"), path)
    assert restored_table(spark, path).count() == 2
    (tmp_path / "t").rename(tmp_path / "t.old")  # broken off after the old table was renamed away
    assert restored_table(spark, path).count() == 2


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from sievework import durable as d

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert d.shared_root(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert d.shared_root(session("local[8]", None)).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            d.shared_root(session(master, None))


def test_intermediate_tables_can_be_dropped(spark):
    from sievework import durable as d

    since = d.mark()
    table = d.durable(spark.range(3), "dropped")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 3 and os.path.exists(path)
    d.drop_tables(spark, since)
    assert not os.path.exists(path)
