"""Streaming forms, driven to completion over small files in several micro-batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from facetframe.streaming.events import deliver, session_stream, throttle_stream
from tests.test_scale_routes import chain


def write_batches(spark, folder, batches):
    """One file per micro-batch, oldest first."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id long, event_type string, id long, s double")
        timed = frame.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
        path = folder / f"part-{i:03d}.parquet"
        timed.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)


def read_stream(spark, folder):
    schema = "user_id long, event_type string, id long, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, stream, tmp_path, mode="append"):
    name = "t" + uuid.uuid4().hex
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).start()
    )
    try:
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def events(offsets):
    return [(1, "click", i, float(s)) for i, s in enumerate(offsets)]


def test_throttle_stream_over_batches(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder = tmp_path / "in"
    folder.mkdir()
    # Batches overlap in event time: the second brings events that belong before the first's last.
    first = [(1, "click", 0, 100.0), (1, "click", 1, 100.5), (1, "click", 2, 103.0), (2, "view", 3, 100.0)]
    second = [(1, "click", 4, 101.0), (1, "click", 5, 102.2), (2, "view", 6, 100.9), (1, "click", 7, 104.5)]
    close = [(9, "end", 8, 500.0)]
    after = [(9, "end", 9, 900.0)]
    write_batches(spark, folder, [first, second, close, after])
    stream = throttle_stream(read_stream(spark, folder), ["user_id", "event_type"], "ts", "id", 1000, "60 seconds")
    got = run(spark, stream, tmp_path)
    kept = sorted(r["ts"].timestamp() for r in got if r["user_id"] == 1)
    assert kept == chain([100.0, 100.5, 103.0, 101.0, 102.2, 104.5], 1.0)
    assert [r["id"] for r in got if r["user_id"] == 2] == [3]


def test_session_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_batches(
        spark,
        folder,
        [events([0, 20, 50]), [(1, "click", 9, 200.0), (1, "click", 10, 200.2)], [(2, "end", 11, 5000.0)], [(2, "end", 12, 9000.0)]],
    )
    got = run(spark, session_stream(read_stream(spark, folder), "user_id", "ts", "60 seconds", "10 seconds"), tmp_path)
    found = sorted((r["user_id"], r["events"], r["duration"]) for r in got)
    assert found[:2] == [(1, 2, 1), (1, 3, 50)]


def test_deliver_repeats_after_failure(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_batches(spark, folder, [[(1, "click", i, float(i)) for i in range(45)]])
    sent, marker = tmp_path / "sent", tmp_path / "failed-once"
    sent.mkdir()
    sent_path, marker_path = str(sent), str(marker)

    def send(rows):
        import os
        import uuid as u

        assert 1 <= len(rows) <= 20
        if not os.path.exists(marker_path):
            open(marker_path, "w").close()
            raise RuntimeError("the receiver is down")
        with open(f"{sent_path}/{u.uuid4().hex}", "w") as f:
            f.write("\n".join(str(r["id"]) for r in rows))

    checkpoint = str(tmp_path / "checkpoint")
    query = deliver(read_stream(spark, folder), send, checkpoint, every_ms=100)
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    query = deliver(read_stream(spark, folder), send, checkpoint, every_ms=100)
    query.processAllAvailable()
    query.stop()
    ids = {int(line) for f in sent.iterdir() for line in f.read_text().split()}
    assert ids == set(range(45))
