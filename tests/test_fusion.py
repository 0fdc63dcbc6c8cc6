from datetime import timedelta

import pytest

from tests.data import START
from wakeline.operators import fusion as X

SCHEMA = "mmsi long, timestamp timestamp, lat double, lon double, sog double, source string, record_provenance string, vessel_name string, ship_type string"


@pytest.fixture(scope="module")
def sources(spark):
    at = lambda s: START + timedelta(seconds=s)
    make = lambda s, rows: spark.createDataFrame([(m, at(t), a, b, v, s, f"{s}:direct", n, k) for m, t, a, b, v, n, k in rows], SCHEMA)
    return {
        "noaa": make("noaa", [(111, 0, 40.0, -74.0, 10.0, "GOOD NAME", "70"), (111, 300, 40.01, -74.01, 11.0, "GOOD NAME", "70"), (222, 0, 55.0, 12.0, 0.0, "US VESSEL", "80")]),
        "dma": make("dma", [(111, 10, 40.001, -73.999, 10.1, "DMA NAME", "Cargo"), (111, 305, 40.011, -74.009, 10.9, "DMA NAME", "Cargo"), (333, 0, 56.0, 10.0, 0.0, "DK VESSEL", "Fishing")]),
    }


def test_union(sources):
    out = X.merge(sources, "union").collect()
    assert len(out) == 6 and {r.record_provenance for r in out} == {"noaa:union", "dma:union"}


def test_best(sources):
    out = X.merge(sources, X.FusionConfig("best", source_precedence=("noaa", "dma"))).collect()
    assert len(out) == 4
    assert {r.source for r in out if r.mmsi == 111} == {"noaa"}
    assert {r.record_provenance for r in out if r.mmsi == 111} == {"noaa:best[+dma+noaa]"}
    assert [r.record_provenance for r in out if r.mmsi == 222] == ["noaa:best"]


def test_prefer_and_fields(sources):
    out = X.merge(sources, "prefer:noaa").collect()
    assert {r.record_provenance for r in out if r.mmsi == 111} == {"noaa:prefer:noaa[+dma+noaa]"}
    config = X.FusionConfig("best", source_precedence=("noaa",), field_precedence={"ship_type": ["dma"]}, source_confidence_weights={"noaa": 1.0, "dma": 0.8})
    rows = X.merge(sources, config).collect()
    assert {(r.vessel_name, r.ship_type, r.confidence_score) for r in rows if r.mmsi == 111} == {("GOOD NAME", "Cargo", 1.0)}
    assert {r.confidence_score for r in rows if r.mmsi == 333} == {0.8}


def test_null_field_falls_through(spark, sources):
    from pyspark.sql import functions as F

    blank = sources["dma"].withColumn("ship_type", F.lit(None).cast("string"))
    out = X.merge({"noaa": sources["noaa"], "dma": blank}, X.FusionConfig("best", field_precedence={"ship_type": ["dma"]})).where("mmsi = 111").collect()
    assert {r.ship_type for r in out} == {"70"}


def test_single_and_missing_columns(sources):
    assert {r.record_provenance for r in X.merge({"noaa": sources["noaa"]}, "best").collect()} == {"noaa:only"}
    out = X.merge({"noaa": sources["noaa"], "dma": sources["dma"].drop("vessel_name")}, "union")
    assert out.count() == 6 and out.columns[-2:] == ["vessel_name", "ship_type"]


def test_parse_and_validate():
    assert X.parse_merge("BEST").mode == "best" and X.parse_merge("prefer:NOAA").prefer_source == "noaa"
    for bad in ("first", "prefer", "prefer:", "best:x"):
        with pytest.raises(ValueError):
            X.parse_merge(bad)
    assert len(X.FusionConfig("prefer", coordinate_tolerance_degrees=-1, field_precedence={"lat": ["x"]}, source_confidence_weights={"a": 2}).validate()) == 4


def test_summary(sources):
    s = X.summarize(sources, X.merge(sources, "best"))
    assert (s.rows_in, s.rows_out, round(s.duplicate_rate, 3)) == (6, 4, 0.333)
