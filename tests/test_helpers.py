import os

import pytest
from pyspark.sql import functions as F

from tests.data import TWO_VESSELS, frame, ts
from wakeline import viz
from wakeline.functions import exprs
from wakeline.operators import boundaries as B
from wakeline.operators import density, helpers, qc
from wakeline.operators.tracks import TrackConfig, build_tracks

FIXES = [(111, 0, 40.0, 1.0, 1.0), (111, 10, 40.1, 1.0, 1.0), (111, 20, 40.2, 1.0, 1.0), (222, 5, 50.0, 2.0, 2.0), (222, 15, 50.1, 2.0, 2.0), (222, 25, 50.2, 2.0, 2.0), (333, 0, 60.0, 3.0, 3.0), (333, 30, 60.1, 3.0, 3.0)]


def minutes(df):
    return [(r.mmsi, r.timestamp.minute) for r in df.collect()]


def test_latest_and_snapshot(spark):
    df = frame(spark, FIXES)
    assert minutes(helpers.latest_positions(df)) == [(111, 20), (222, 25), (333, 30)]
    assert minutes(helpers.snapshot(df, ts(12))) == [(111, 10), (222, 15), (333, 0)]
    assert helpers.vessel_history(222, df)["positions"].count() == 3
    assert helpers.filter_bbox(df, 1.0, 40.0, 2.0, 50.0).count() == 4
    assert [r.mmsi for r in helpers.top_speeds(df, 2).collect()] == [333, 222]


def test_history_of_either_vessel(spark):
    events = spark.createDataFrame([(1, 2, ts(0)), (2, 3, ts(1)), (4, 5, ts(2))], "mmsi long, other_mmsi long, start_time timestamp")
    assert helpers.vessel_history(2, frame(spark, FIXES), events=events)["events"].count() == 2


def test_density(spark):
    rows = [(111, t, 40.0 + t / 1e4, -74.0, 1.0) for t in range(5)] + [(222, t, 40.0, -74.0, 1.0) for t in range(5)] + [(333, t, 55.0, 12.0, 1.0) for t in range(5)]
    out = density.compute_density(frame(spark, rows), 4).collect()
    assert sum(r.observation_count for r in out) == 15 and out[0].vessel_count == 2 and out[0].cell_id == "40.0,-74.0"
    assert [density.decimals(r) for r in (0, 1, 2, 4, 5, 8)] == [0, 1, 1, 2, 2, 3]
    assert sum(r["count"] for r in density.bin_positions(frame(spark, rows), 2).collect()) == 15


def test_boundaries(spark):
    ring = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))
    reg = B.BoundaryRegistry(B.BoundaryDataset("a", "1", (B.Region("x", 0, 0, 2, 2), B.Region("y", 2, 0, 4, 2))), B.BoundaryDataset("b", "2", (B.Region("z", 0, 0, 4, 4, ring),)))
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 3.0), (4, None, 1.0), (5, 9.0, 9.0), (6, 3.0, 3.0)], "id int, lat double, lon double")
    out = {r.id: r for r in df.select("id", reg.region_of("a").alias("a"), reg.region_of("none").alias("n"), reg.regions_of().alias("all")).collect()}
    assert [out[i].a for i in range(1, 7)] == ["x", "x", "y", None, None, None] and out[1].n is None
    assert [(x.dataset, x.region) for x in out[2]["all"]] == [("a", "x"), ("a", "y"), ("b", "z")] and out[4]["all"] == []
    assert reg.provenance_tags() == ["a/1", "b/2"] and reg.datasets() == ["a", "b"]
    reg.register(B.BoundaryDataset("a", "9", ()))
    assert reg.get("a").version == "9" and reg.get("c") is None
    many = B.BoundaryRegistry(B.BoundaryDataset("m", "1", tuple(B.Region(f"r{i}", i % 20, i // 20, i % 20 + 1, i // 20 + 1) for i in range(220))))
    rows = {r.id: r.region for r in many.label(df, "m").collect()}
    assert rows == {1: "r0", 2: "r1", 3: "r2", 4: None, 5: "r168", 6: "r42"}


def test_quality(spark):
    rows = [(200000001, 0, 40.0, 1.0, 5.0), (200000001, 1, 41.0, 1.0, 5.0), (200000001, 2, 95.0, 1.0, 200.0), (7, 0, 1.0, 1.0, 1.0), (200000002, 0, None, 1.0, None)]
    out = {(r.mmsi, r.timestamp.minute): r for r in qc.run_checks(frame(spark, rows)).collect()}
    assert out[(200000001, 0)].qc_severity == "ok" and out[(200000001, 0)].confidence_score == 1.0
    assert out[(200000001, 1)].qc_flags == ["implied_speed"] and out[(200000001, 1)].confidence_score == pytest.approx(0.8)
    assert out[(200000001, 2)].qc_severity == "error" and set(out[(200000001, 2)].qc_flags) == {"lat_range", "sog_range", "implied_speed"}
    assert out[(7, 0)].qc_flags == ["mmsi_format"] and out[(200000002, 0)].qc_flags == ["lat_not_null"]
    assert qc.run_checks(frame(spark, rows), drop_invalid=True).count() == 2
    assert {r.qc_severity for r in qc.run_checks(frame(spark, rows), mode="off").collect()} == {"ok"}
    stale = qc.run_checks(frame(spark, [(200000001, t, 40.0, 1.0, 0.0) for t in range(103)]))
    assert stale.where(F.array_contains("qc_flags", "stale_position")).count() == 3
    back = frame(spark, [(200000001, 5, 40.0, 1.0, 0.0), (200000001, 3, 40.0, 1.0, 0.0)]).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    assert [r.qc_flags for r in qc.run_checks(back, arrival="seq").orderBy("seq").collect()] == [[], ["timestamp_order"]]
    assert len(qc.BUILTIN) == 14
    report = qc.QualityReport("positions", 1, 10, 6, 2, 0, 2)
    assert (report.rows_written, report.ok_rate, report.drop_rate) == (8, 0.75, 0.2) and qc.QualityReport("x").ok_rate == 0


def test_expressions(spark):
    row = spark.range(1).select(exprs.bucket(F.lit(-7), 2).alias("b"), exprs.short_id("a", F.lit(1)).alias("i"), exprs.nav_status(F.lit(11)).alias("n"), exprs.blank_to_null(F.lit("  ")).alias("t"), exprs.confidence_class(F.lit(0.7)).alias("c")).first()
    import hashlib

    assert (row.b, row.n, row.t, row.c) == (-4, None, None, "high") and row.i == hashlib.sha1(b"a:1").hexdigest()[:16]


def test_viz(spark):
    tracks = build_tracks(frame(spark, TWO_VESSELS), TrackConfig(min_duration_seconds=0, include_geometry=True))
    view = viz.Viewport(-75.0, 39.0, -73.0, 40.02)
    assert viz.prepare_tracks(tracks, view).count() == 1 and viz.prepare_positions(frame(spark, TWO_VESSELS), view).count() == 3
    assert viz.prepare_positions(frame(spark, TWO_VESSELS), n=4).count() == 4
    assert sorted(round(r.trip_progress, 3) for r in viz.prepare_trips(tracks).collect()) == [0.667, 1.0]
    assert viz.prepare_trips(tracks.drop("geometry_wkb")).count() == 0
    assert sum(r["count"] for r in viz.prepare_density(frame(spark, TWO_VESSELS)).collect()) == 9
    drawn = tracks.where("geometry_wkb IS NOT NULL AND timestamp_offsets_ms IS NOT NULL").count()
    few = viz.replay_html(tracks, most=1)
    assert few.count('"path"') == 1 and f"{drawn - 1} shorter tracks are not drawn" in few
    page = viz.replay_html(tracks, "<x>")
    assert page.count('"path"') == drawn > 1 and "not drawn" not in page
    assert "&lt;x&gt;" in page and '"mmsi": 111' in page
    assert all(w.startswith("LINESTRING") for _, w in viz.geometry_wkt(tracks))
    for bad in ((0, 50, 0, 40), (0, -91, 0, 0), (-181, 0, 0, 0)):
        with pytest.raises(ValueError):
            viz.Viewport(*bad)


def test_nav_status_of_all_rows(spark):
    import duckdb

    from wakeline.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    out = [tuple(r) for r in QUERIES["nav_status_text"](spark, sf).collect()]
    db = duckdb.connect()
    files = f"{sf}/events.parquet" + ("/*.parquet" if os.path.isdir(f"{sf}/events.parquet") else "")
    db.execute(f"CREATE VIEW events AS FROM read_parquet('{files}')")
    key = lambda r: r[0]
    assert sorted(out, key=key) == sorted(db.execute(ORACLES["nav_status_text"]).fetchall(), key=key)
    assert len(out) == spark.read.parquet(f"{sf}/events.parquet").count() and len({t for _, t in out if t}) == 13


def test_points_on_edges_are_outside(spark):
    ring = ((2.0, 50.0), (5.0, 50.0), (5.0, 52.0), (2.0, 54.0))
    points = [(3.0, 50.0), (2.0, 51.0), (5.0, 51.0), (2.0, 50.0), (5.0, 52.0), (3.5, 53.0), (3.0, 51.0), (4.9, 50.1)]
    rows = spark.createDataFrame(points, "x double, y double")
    assert [r[0] for r in rows.select(B.in_ring(F.col("x"), F.col("y"), ring)).collect()] == [False] * 6 + [True] * 2


def test_polygon_query_against_sql(spark):
    import duckdb

    from wakeline.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["region_polygon"](spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM read_parquet('{sf}/events.parquet{'/*.parquet' if os.path.isdir(f'{sf}/events.parquet') else ''}')")
    assert sorted(map(tuple, out.collect())) == sorted(db.execute(ORACLES["region_polygon"]).fetchall())


def test_many_polygons(spark):
    """Beyond the folded size polygons are joined by cells, and give what the expression gives."""
    from wakeline.operators import boundaries as B

    rings = [B.Region(f"r{i}", 0.1 * i, 0.05 * i, 0.1 * i + 2, 0.05 * i + 3, ((0.1 * i, 0.05 * i), (0.1 * i + 2, 0.05 * i), (0.1 * i + 1, 0.05 * i + 3)) if i % 3 else ()) for i in range(B.FOLDED + 30)]
    known = B.BoundaryRegistry(B.BoundaryDataset("many", "1", tuple(rings)))
    points = spark.range(4000).select("id", (F.col("id") % 63 * 0.4).alias("lon"), (F.floor(F.col("id") / 63) * 0.25).alias("lat"), F.lit("x").alias("region_"))
    points = points.union(spark.createDataFrame([(-1, None, 1.0, "x"), (-2, 0.1, 0.05, "x"), (-3, 1.1, 3.05, "x"), (-4, 1.0, 0.0, "x")], points.schema))
    joined = {r.id: r.region for r in known.label(points, "many").collect()}
    folded = {r.id: r.region for r in points.withColumn("region", known.region_of("many")).collect()}
    assert joined == folded and len(joined) == 4004 and len(set(joined.values())) > 50


def test_rows_without_a_vessel_do_not_meet(spark):
    rows = [(None, t, 40.0, 1.0, 0.0) for t in range(200)] + [(200000001, t, 40.0, 1.0, 0.0) for t in range(102)]
    out = qc.run_checks(frame(spark, rows))
    assert out.where("mmsi IS NULL").groupBy("qc_flags").count().collect() == [(["mmsi_not_null"], 200)]
    assert out.where(F.array_contains("qc_flags", "stale_position")).count() == 2
