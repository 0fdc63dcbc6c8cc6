import json

import pytest

from tests.data import TWO_VESSELS, frame, ts
from wakeline.cli import main
from wakeline.plans import store
from wakeline.plans.api import Fleet, parse_dates
from wakeline.plans.catalog import Catalog, Manifest
from wakeline.schemas import DATASETS, POSITIONS
from wakeline.sources.base import RawArtifact
from tests.test_sources import NOAA, zipped

DAY = "2024-06-15"


def positions(spark, rows=TWO_VESSELS, source="noaa"):
    return POSITIONS.conform(frame(spark, rows, source))


def test_write_and_scan(spark, tmp_path):
    m = store.write_partition(positions(spark), str(tmp_path), "positions", "noaa", DAY)
    assert (m.record_count, m.distinct_mmsi_count, m.write_status, m.bbox) == (9, 2, "committed", [-74.0, 40.0, 12.03, 55.0])
    catalog = Catalog(spark, str(tmp_path))
    out = catalog.scan("positions", ["noaa"], DAY, DAY)
    assert out.count() == 9 and out.columns == POSITIONS.columns
    assert catalog.scan("positions", ["dma"]).count() == 0 and catalog.scan("positions", None, "2024-06-16").count() == 0
    assert Manifest.from_json(m.to_json()) == m
    # writing again replaces
    store.write_partition(positions(spark, TWO_VESSELS[:3]), str(tmp_path), "positions", "noaa", DAY)
    assert catalog.refresh().scan("positions").count() == 3


def test_writer_steps(spark, tmp_path):
    w = store.PartitionWriter(spark, str(tmp_path), "positions", "noaa", DAY).write(positions(spark))
    assert Catalog(spark, str(tmp_path)).scan("positions").count() == 0
    with pytest.raises(FileExistsError):
        store.PartitionWriter(spark, str(tmp_path), "positions", "noaa", DAY).write(positions(spark))
    w.commit()
    with pytest.raises(RuntimeError):
        w.commit()
    store.PartitionWriter(spark, str(tmp_path), "positions", "dma", DAY).write(positions(spark))
    assert store.cleanup_stale_staging(spark, str(tmp_path)) == [f"canonical/positions/source=dma/date={DAY}"]
    with pytest.raises(ValueError):
        store.PartitionWriter(spark, str(tmp_path), "positions", "dma", DAY).validate()


def test_reports(spark, tmp_path):
    root = str(tmp_path)
    store.write_partition(positions(spark), root, "positions", "noaa", DAY, checks_applied=["lat_range"])
    store.write_partition(positions(spark), root, "positions", "dma", DAY, adapter_version="dma/9", rows_dropped=1)
    c = Catalog(spark, root)
    assert [(r.source, r.partitions, r.rows, r.vessels) for r in c.inventory().collect()] == [("dma", 1, 9, 2), ("noaa", 1, 9, 2)]
    q = c.quality_report("positions")
    assert (q.partitions_scanned, q.total_rows, q.rows_dropped, q.checks_applied) == (2, 19, 1, ("lat_range",))
    assert q.drop_rate == pytest.approx(1 / 19)
    p = c.provenance("positions")
    assert p["has_mixed_versions"] and p["sources"] == ["dma", "noaa"] and not p["can_rebuild_locally"]
    assert [h["problem"] for h in c.check_health()] == ["mixed versions"]
    files = c.files
    files.write(files.at("manifests", "positions", "source=x", "date=1.json"), json.dumps(json.loads(c.manifests[0].to_json()) | {"write_status": "staged", "source": "x"}))
    files.write(files.at("manifests", "positions", "source=y", "date=1.json"), json.dumps(json.loads(c.manifests[0].to_json()) | {"schema_version": "positions/v9", "source": "y"}))
    assert {h["problem"] for h in c.refresh().check_health()} == {"staged partition", "unknown schema version positions/v9", "mixed versions"}


def test_end_to_end(spark, tmp_path, capsys):
    root, path = str(tmp_path / "store"), zipped(tmp_path / "n.zip", NOAA)
    raw = {("noaa", parse_dates(DAY)[0]): [RawArtifact("u", "n.zip", "s", 1, path)]}
    fleet = Fleet(spark, root, DAY, "noaa", qc_mode="declared", raw_policy="full")
    made = fleet.download(raw)
    assert [(m.dataset, m.record_count, m.rows_dropped) for m in made] == [("positions", 2, 1), ("vessels", 1, 0)]
    assert fleet.sql("SELECT mmsi, count(*) AS n FROM positions GROUP BY mmsi").collect() == [(123456789, 2)]
    assert fleet.sql("SELECT count(*) FROM positions_fused").first()[0] == 2
    assert fleet.provenance()["can_rebuild_locally"] and fleet.quality_report().rows_dropped == 1
    assert [tuple(r) for r in fleet.fusion_info().collect()] == [("noaa", 0, "union", 1, 2, DAY, DAY)]
    assert [r.mmsi for r in fleet.latest_positions().collect()] == [123456789]
    assert Fleet(spark, root, DAY, bbox=(-74.05, 39, -73, 41)).positions().count() == 1
    assert Fleet(spark, root, DAY, mmsi=[1]).positions().count() == 0
    off = Fleet(spark, str(tmp_path / "off"), DAY, "noaa", qc_mode="off")
    assert off.download(raw)[0].record_count == 3
    for args in (["inventory"], ["health"], ["qc", "--start", DAY], ["sql", "SELECT 1 AS one", "--start", DAY], ["fusion", "--start", DAY], ["events", "--start", DAY], ["provenance", "--start", DAY], ["sources", "--streaming"], ["sources", "--compare", "noaa", "dma"]):
        assert main(["--root", root, *args], spark) == 0
    assert "finland" in capsys.readouterr().out


def test_fused_and_cached(spark, tmp_path):
    root = str(tmp_path)
    store.write_partition(positions(spark), root, "positions", "noaa", DAY)
    store.write_partition(positions(spark, source="dma"), root, "positions", "dma", DAY)
    assert Fleet(spark, root, DAY, ["noaa", "dma"]).positions().count() == 18
    fleet = Fleet(spark, root, DAY, ["noaa", "dma"], "prefer:dma")
    # fixes of one vessel within tolerance fall together, too
    assert {r.source for r in fleet.positions().collect()} == {"dma"}
    assert fleet.sql("SELECT count(*) FROM positions").first()[0] == 18
    args = {"min_duration": 0, "min_points": 1, "min_distance": 0}
    first = fleet.tracks(store=True, **args)
    n = first.count()
    assert n and len(fleet.catalog.partitions("tracks")) == 1
    again = fleet.tracks(**args)
    assert again.count() == n and "FileScan" in again._jdf.queryExecution().executedPlan().toString() and "Window" not in again._jdf.queryExecution().executedPlan().toString()
    assert "Window" in fleet.tracks(**args, refresh=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in fleet.tracks(gap="2h", **args)._jdf.queryExecution().executedPlan().toString()
    fleet.save_events(fleet.detect_loitering())
    assert fleet.events("loitering", 0.5).count() == 0


def test_dates():
    assert len(parse_dates(("2024-06-01", "2024-06-30"))) == 30 and len(parse_dates(["2024-06-01", "2024-06-03"])) == 2
    with pytest.raises(ValueError):
        parse_dates(("2024-06-02", "2024-06-01"))


def test_specs(spark):
    for spec in DATASETS.values():
        empty = spark.createDataFrame([], spec.struct)
        assert spec.validate(empty) == [] and spec.required <= set(spec.columns)
    bad = spark.createDataFrame([(1, "x")], "mmsi int, extra string")
    errors = POSITIONS.validate(bad)
    assert "missing required column: lat" in errors and "unexpected column: extra" in errors and any("expected bigint, got int" in e for e in errors)
    assert ts(0) is not None
