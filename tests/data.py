"""Small fixtures: positions by minute of 2024-06-15."""

from datetime import UTC, datetime, timedelta

START = datetime(2024, 6, 15, tzinfo=UTC)
SCHEMA = "mmsi long, timestamp timestamp, lat double, lon double, sog double, source string"


def ts(minute: float) -> datetime:
    return START + timedelta(minutes=minute)


def frame(spark, rows, source="noaa"):
    """(mmsi, minute, lat, lon, sog) rows."""
    return spark.createDataFrame([(m, ts(t), lat, lon, sog, source) for m, t, lat, lon, sog in rows], SCHEMA)


TWO_VESSELS = [(111, t, 40.0 + t / 100, -74.0, 5.0) for t in range(5)] + [(222, 2 * t, 55.0, 12.0 + t / 100, 3.0) for t in range(4)]
GAPPED = [(111, t, 40.0 + t / 100, -74.0, 5.0) for t in range(4)] + [(111, 48 + t, 40.1 + t / 100, -74.0, 5.0) for t in range(3)]
JUMP = [(111, t, lat, -74.0, 5.0) for t, lat in enumerate((40.0, 40.01, 40.02, 45.0, 45.01, 45.02))]


def port_stay(mmsi, first, last, step=10):
    return [(mmsi, t, 51.9, 4.0 + 0.001 * i, 0.5) for i, t in enumerate(range(first, last + 1, step))]


def encounter(*vessels, last=30, step=5):
    return [(m, t, 40.0 + 0.001 * i, -74.0 - 0.001 * i, 3.0) for i, m in enumerate(vessels) for t in range(0, last + 1, step)]
