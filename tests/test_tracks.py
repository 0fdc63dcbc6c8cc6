import struct

import pytest
from pyspark.sql import functions as F

from tests.data import GAPPED, JUMP, TWO_VESSELS, frame
from wakeline.operators import tracks as T
from wakeline.schemas import TRACKS


def segments(df, **config):
    rows = T.detect_boundaries(df, T.TrackConfig(**config)).where("segment IS NOT NULL")
    return rows.select("mmsi", "segment").distinct().count()


def test_gaps_and_jumps(spark):
    assert segments(frame(spark, GAPPED), gap_seconds=1800) == 2
    assert segments(frame(spark, GAPPED), gap_seconds=3600) == 1
    assert segments(frame(spark, JUMP)) == 2
    assert segments(frame(spark, TWO_VESSELS)) == 2


def test_gap_is_strict_and_repeated_times_split(spark):
    assert segments(frame(spark, [(1, 0, 40.0, 1.0, 1.0), (1, 30, 40.0, 1.0, 1.0)]), gap_seconds=1800) == 1
    assert segments(frame(spark, [(1, 0, 40.0, 1.0, 1.0), (1, 0, 40.1, 1.0, 1.0)])) == 2


def test_missing_coordinates_are_in_no_segment(spark):
    df = frame(spark, [(1, 0, 40.0, 1.0, 1.0), (1, 1, None, 1.0, 1.0), (1, 2, 40.0, 1.0, 1.0), (1, 3, 40.0, 1.0, 1.0)])
    out = {r.timestamp.minute: r.segment for r in T.detect_boundaries(df).collect()}
    assert out == {0: 1, 1: None, 2: None, 3: 1}


def test_tracks(spark):
    out = T.build_tracks(frame(spark, TWO_VESSELS), T.TrackConfig(min_duration_seconds=0)).orderBy("mmsi").collect()
    assert [r.point_count for r in out] == [5, 4]
    assert out[0].duration_s == 240.0 and out[0].mean_speed == 5.0 and out[0].max_speed == 5.0
    assert out[0].distance_m == pytest.approx(4 * 0.01 * 111_320, rel=1e-6)
    assert (out[0].bbox_south, out[0].bbox_north) == (40.0, 40.04)
    assert out[0].record_provenance == "noaa:tracks" and len(out[0].track_id) == 16
    only = T.build_tracks(frame(spark, TWO_VESSELS), T.TrackConfig(min_duration_seconds=300)).collect()
    assert [r.mmsi for r in only] == [222]


def test_filter_segments(spark):
    rows = T.filter_segments(T.detect_boundaries(frame(spark, GAPPED)), T.TrackConfig(min_points=4, min_duration_seconds=0, min_distance_m=0))
    assert rows.count() == 4


def test_without_speed(spark):
    out = T.build_tracks(frame(spark, TWO_VESSELS).drop("sog"), T.TrackConfig(min_duration_seconds=0)).where("mmsi = 111").first()
    assert out.max_speed is None and out.mean_speed == pytest.approx(out.distance_m / 240 / 0.5144)


def test_geometry(spark):
    out = T.build_tracks(frame(spark, TWO_VESSELS), T.TrackConfig(min_duration_seconds=0, include_geometry=True)).where("mmsi = 111").first()
    order, kind, n = struct.unpack_from("<BII", out.geometry_wkb)
    assert (order, kind, n) == (1, 2, 5)
    assert struct.unpack_from("<dd", out.geometry_wkb, 9) == (-74.0, 40.0)
    assert out.timestamp_offsets_ms == [0, 60_000, 120_000, 180_000, 240_000]
    short = T.build_tracks(frame(spark, TWO_VESSELS), T.TrackConfig(min_duration_seconds=0, include_geometry=True, generalize_tolerance_m=50.0)).where("mmsi = 111").first()
    assert short.timestamp_offsets_ms == [0, 240_000]


def test_empty(spark):
    out = T.build_tracks(frame(spark, []))
    assert out.count() == 0 and out.columns == TRACKS.columns


def test_config():
    assert T.parse_track_args("1h", min_distance="1km") == T.TrackConfig(3600, 50.0, 3, 300, 1000.0)
    assert T.parse_duration("90s") == 90 and T.parse_duration(45) == 45 and T.parse_distance("500m") == 500.0
    assert T.TrackConfig(gap_seconds=0, min_points=0).validate() == ["gap_seconds must be > 0, got 0", "min_points must be >= 1, got 0"]
    assert T.TrackConfig().config_hash() != T.TrackConfig(gap_seconds=60).config_hash()
    assert T.TrackConfig().config_hash() == T.TrackConfig(refresh=True).config_hash()


def test_one_shuffle(spark):
    """Windows and grouping share the shuffle by source and vessel."""
    plan = T.build_tracks(frame(spark, TWO_VESSELS).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source") == 1
    assert F is not None
