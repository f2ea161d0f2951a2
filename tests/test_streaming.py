from datetime import datetime, timedelta

from voxlake.streaming import ingest

T0 = datetime(2024, 1, 1)


def test_edits_become_a_volume(spark, tmp_path):
    source, out = tmp_path / "edits", str(tmp_path / "volume")
    source.mkdir()
    edits = spark.readStream.schema(ingest.EDITS).option("maxFilesPerTrigger", 1).parquet(str(source))
    batches = [[(T0, 1, 1, 1, 5), (T0, 70, 1, 1, 6)], [(T0 + timedelta(minutes=1), 1, 1, 1, 7), (T0 - timedelta(minutes=1), 70, 1, 1, 9), (T0, 2, 2, 2, 3)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, ingest.EDITS).coalesce(1).write.mode("append").parquet(str(source))
        q = ingest.volume_sink(edits, out).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.x, r.label) for r in spark.read.parquet(out).collect()} == {(1, 7), (70, 6), (2, 3)}


def test_windows(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), 0, 0, 0, m % 2) for m in range(12)]
    spark.createDataFrame(rows, ingest.EDITS).coalesce(1).write.parquet(str(tmp_path / "e"))
    counts = ingest.label_counts(spark.readStream.schema(ingest.EDITS).parquet(str(tmp_path / "e")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.minute, r.label, r.n) for r in spark.table("counts").collect()) == [(0, 0, 3), (0, 1, 2), (5, 0, 2), (5, 1, 3), (10, 0, 1), (10, 1, 1)]
