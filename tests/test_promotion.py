from tests.data import frame
from wakeline.plans import store
from wakeline.plans.catalog import Catalog
from wakeline.schemas import POSITIONS
from wakeline.streaming import sinks


def landed(spark, path, days, vessels=(1, 2)):
    rows = [(m, 1440 * d + t, 40.0 + m, 5.0 + t / 100, 1.0) for d in range(days) for m in vessels for t in range(3)]
    sinks.ParquetSink(path)(frame(spark, rows + rows[:4]), 0)
    return path


def test_jobs_do_not_grow_with_days(spark, tmp_path):
    tracker, took = spark.sparkContext.statusTracker(), {}
    for days in (2, 8):
        landing = landed(spark, str(tmp_path / f"landing{days}"), days)
        spark.sparkContext.setJobGroup(f"promote{days}", "")
        made = sinks.promote_landing(spark, str(tmp_path / f"store{days}"), landing, "dma")
        took[days] = len(tracker.getJobIdsForGroup(f"promote{days}"))
        assert [(m.date, m.record_count, m.distinct_mmsi_count, m.rows_ok) for m in made] == [(f"2024-06-{15 + d}", 6, 2, 6) for d in range(days)]
        assert made[1].min_timestamp.startswith("2024-06-16 00:00:00") and made[1].bbox == [5.0, 41.0, 5.02, 42.0]
    spark.sparkContext.setJobGroup("others", "")
    assert took[2] == took[8]


def test_stored_rows_stay_in_their_partitions(spark, tmp_path):
    root = str(tmp_path / "store")
    of = lambda rows: POSITIONS.conform(frame(spark, rows, "dma"))
    # one row of the 16th held by the 15th; one that will land again; a day that doesn't land; another source
    store.write_partition(of([(9, 1500, 1.0, 1.0, 1.0), (1, 0, 41.0, 5.0, 1.0)]), root, "positions", "dma", "2024-06-15")
    store.write_partition(of([(9, 14400, 1.0, 1.0, 1.0)]), root, "positions", "dma", "2024-06-25")
    store.write_partition(of([(9, 0, 1.0, 1.0, 1.0)]), root, "positions", "noaa", "2024-06-15")
    for _ in range(2):
        sinks.promote_landing(spark, root, landed(spark, str(tmp_path / "landing"), 2), "dma")
        catalog = Catalog(spark, root)
        assert [(m.source, m.date, m.record_count) for m in catalog.partitions("positions")] == [("dma", "2024-06-15", 7), ("dma", "2024-06-16", 6), ("dma", "2024-06-25", 1), ("noaa", "2024-06-15", 1)]
        assert catalog.scan("positions", ["dma"], "2024-06-15", "2024-06-15").where("mmsi = 9").count() == 1
        assert catalog.scan("positions").count() == 15
    assert not store.cleanup_stale_staging(spark, root)


def test_staged_days_are_found_and_locked(spark, tmp_path):
    root, landing = str(tmp_path / "store"), landed(spark, str(tmp_path / "landing"), 2)
    store.PartitionWriter(spark, root, "positions", "dma", "2024-06-16").write(POSITIONS.conform(frame(spark, [(1, 0, 1.0, 1.0, 1.0)])))
    try:
        sinks.promote_landing(spark, root, landing, "dma")
        raise AssertionError("a day that is being staged was taken")
    except FileExistsError:
        pass
    assert store.cleanup_stale_staging(spark, root) == ["canonical/positions/source=dma/date=2024-06-16"]
    left = tmp_path / "store/_staging/days-0a/canonical/positions/source=dma/_day=2024-06-15"
    left.mkdir(parents=True)
    (left / "part.parquet").write_text("")
    assert store.cleanup_stale_staging(spark, root) == ["canonical/positions/source=dma/date=2024-06-15"]
    assert [m.date for m in sinks.promote_landing(spark, root, landing, "dma")] == ["2024-06-15", "2024-06-16"]
