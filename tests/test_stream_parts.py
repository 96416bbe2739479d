"""Streams of the registered queries grow by micro-batches and files, not by larger ones."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from tapewright.plans import q_streams, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", ["x", None])
def test_micro_batches_and_files_are_bounded(spark, order):
    rows = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("x"))
    stream = q_streams.as_stream(spark, rows, "parts", order=order, batch_rows=500, file_rows=250)
    found = q_streams.collected(spark, stream, "append", "parts-out")
    got = found.groupBy("batch").agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).orderBy("batch").collect()
    assert len(got) == 6 and sum(r.n for r in got) == 3000 and max(r.n for r in got) <= 600
    if order:
        assert all(before.z < after.a for before, after in zip(got, got[1:]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_capture_is_cut_into_files(spark, monkeypatch):
    monkeypatch.setattr(q_streams, "CAPTURE_ROWS", 100)
    written = []
    monkeypatch.setattr(q_streams.ingest, "frame_stream", lambda s, path, most, run=q_streams.ingest.frame_stream: written.append((path, most)) or run(s, path, most))
    key = (spark.sparkContext.applicationId, SF, "ingested")
    before = views._TABLES.pop(key, None)
    try:
        for name in ("S20_streaming_source", "S20_streaming_rejects"):
            assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name], tolerance=2e-6) is None
    finally:
        views._TABLES.pop(key, None)
        if before is not None:
            views._TABLES[key] = before
    path, most = written[0]
    assert most > 1 and len([f for f in os.listdir(path) if f.endswith(".gz")]) == -(-1000 // 100)
