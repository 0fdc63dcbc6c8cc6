import json
import threading

import pytest

from tests.data import TWO_VESSELS, frame, ts
from wakeline.plans.catalog import Catalog
from wakeline.streaming import buffer, dedup, reader, sinks, stats
from tests.test_sources import message


def test_landed_stream_to_store(spark, tmp_path):
    feed, landing, root = tmp_path / "feed", str(tmp_path / "landing"), str(tmp_path / "store")
    feed.mkdir()
    lines = [message(f"2024-06-15T10:00:{i:02d}+00:00", MMSI=i % 3 + 1) for i in range(10)]
    (feed / "a.json").write_text("\n".join(lines + lines[:4] + [message(kind="Other")]))
    stream = reader.read_landed(spark, str(feed), stats.StreamConfig("aisstream", mmsi=(1, 2, 3), bbox=(0, 0, 5, 5)))
    q = sinks.run_sink(dedup.dedup_within_watermark(stream), sinks.ParquetSink(landing), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.option("recursiveFileLookup", True).parquet(landing).count() == 10
    (m,) = sinks.promote_landing(spark, root, landing, "aisstream")
    assert (m.record_count, m.transform_version) == (10, sinks.TRANSFORM)
    # promoting again keeps what is there and adds nothing twice
    (m,) = sinks.promote_landing(spark, root, landing, "aisstream", cleanup=True)
    assert m.record_count == 10 and Catalog(spark, root).scan("positions").count() == 10 and not (tmp_path / "landing").exists()
    with pytest.raises(ValueError):
        reader.read_landed(spark, str(feed), stats.StreamConfig("noaa"))


def test_rolling_dedup_stream(spark, tmp_path):
    frame(spark, TWO_VESSELS + TWO_VESSELS[:3]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, timestamp timestamp, lat double, lon double, sog double, source string").parquet(str(tmp_path / "in"))
    q = dedup.dedup_rolling(stream, 100).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM rolled").count() == 9


def test_loitering_sessions(spark, tmp_path):
    rows = [(1, 10 * i, 40.0, 1.0, 0.5) for i in range(4)] + [(1, 90 + 10 * i, 40.0, 1.0, 0.5) for i in range(2)] + [(2, 600, 1.0, 1.0, 9.0), (1, 900, 1.0, 1.0, 0.1)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, timestamp timestamp, lat double, lon double, sog double, source string").parquet(str(tmp_path / "in"))
    q = sinks.loitering_sessions(stream, gap="30 minutes").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.points for r in spark.sql("SELECT * FROM sessions WHERE mmsi = 1").collect())[:2] == [2, 4]


def test_compact(spark):
    rows = [(2, ts(0), 1.0, 1.0, 1.0, "a"), (1, ts(0), 1.0, 1.0, 1.0, "b"), (2, ts(0), 1.0, 1.0, 9.0, "c")]
    df = spark.createDataFrame(rows, "mmsi long, timestamp timestamp, lat double, lon double, sog double, source string").coalesce(1)
    assert [(r.mmsi, r.sog) for r in dedup.compact(df).collect()] == [(1, 1.0), (2, 9.0)]
    sinks.TableSink("landed_rows")(df, 0)
    assert spark.table("landed_rows").count() == 3
    sinks.TableSink("landed_rows")(df, 1)
    sinks.TableSink("landed_rows")(df, 1)
    assert {r.batch_id: r["count"] for r in spark.table("landed_rows").groupBy("batch_id").count().collect()} == {0: 3, 1: 3}
    spark.sql("DROP TABLE landed_rows")
    with pytest.raises(ValueError):
        sinks.TableSink("x; drop")


def put_all(b, n, same=False):
    return [b.put({"mmsi": 1, "timestamp": 0 if same else i, "lat": 0, "lon": 0}, timeout=0.01) for i in range(n)]


def test_buffer():
    b = buffer.MessageBuffer(stats.StreamConfig(max_queue=5, backpressure="drop_oldest"))
    put_all(b, 8)
    put_all(b, 8)
    s = b.stats
    assert (s.received, s.deduplicated, s.dropped, s.backpressure_events) == (16, 8, 3, 3)
    assert [m["timestamp"] for m in b.take()] == [3, 4, 5, 6, 7] and s.received == s.delivered + s.deduplicated + s.dropped
    full = buffer.MessageBuffer(stats.StreamConfig(max_queue=2))
    assert put_all(full, 3) == [True, True, False]
    late = threading.Timer(0.05, lambda: (full.take(), full.close()))
    late.start()
    assert full.put({"mmsi": 9}, timeout=5) and list(full) == [{"mmsi": 9}]
    small = dedup.RollingKeys(2)
    assert [small.seen((k,)) for k in (1, 2, 1, 3, 1)] == [False, False, True, False, False]


def test_health_and_files(tmp_path):
    now = [0.0]
    h = stats.Health(stats.StreamConfig(), clock=lambda: now[0])
    states = []
    for t in (29, 30, 119, 120):
        now[0] = t
        states.append(h.snapshot()["state"])
    assert states == ["healthy", "lagging", "lagging", "stale"]
    h.message()
    assert h.snapshot()["state"] == "healthy"
    h.running = False
    assert h.snapshot()["state"] == "stopped"
    delays = stats.reconnect_delays(stats.StreamConfig())
    assert [next(delays) for _ in range(6)] == [5, 10, 20, 40, 60, 60]
    assert len(stats.StreamConfig(dedup_window=0, backpressure="x", max_reconnect_delay_s=1, stale_threshold_s=1).validate()) == 4
    p = str(tmp_path / "c.json")
    assert stats.load_checkpoint(p) is None
    stats.save_checkpoint(p, "s", "t", 5, 1)
    assert stats.load_checkpoint(p)["messages_total"] == 5
    (tmp_path / "c.json").write_text("{")
    assert stats.load_checkpoint(p) is None


def poll(options, n):
    texts = [json.dumps({"n": i}) for i in range(n, min(n + 2, 4))]
    return texts, n + len(texts)


def test_message_source(spark, tmp_path):
    spark.dataSource.register(reader.MessageSource)
    stream = spark.readStream.format("wakeline_messages").option("connector", "tests.test_streaming:poll").load()
    q = stream.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            q.awaitTermination(0.5)
            if spark.sql("SELECT * FROM polled").count() >= 4:
                break
        assert spark.sql("SELECT * FROM polled").count() == 4
    finally:
        q.stop()
