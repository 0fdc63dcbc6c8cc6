"""Latest positions, snapshots, histories and per-vessel figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.exprs import micros
from wakeline.operators.density import compute_density
from wakeline.operators.events import detect_eez_crossings, detect_encounters, detect_loitering, detect_port_calls

__all__ = ["compute_density", "detect_eez_crossings", "detect_encounters", "detect_loitering", "detect_port_calls", "filter_bbox", "filter_mmsi", "latest_positions", "snapshot", "top_speeds", "vessel_history", "vessel_stats"]


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("lat", "lon", "source") if c in df.columns]


def latest_positions(positions: DataFrame) -> DataFrame:
    """The last row of each vessel, in any order: one grouping, combined before its shuffle."""
    last = F.max_by(F.struct(*positions.columns), F.struct("timestamp", *_ties(positions)))
    return positions.groupBy("mmsi").agg(last.alias("_row")).select("_row.*")


def snapshot(positions: DataFrame, when: datetime | str | Column) -> DataFrame:
    """The row of each vessel that is nearest to ``when``; the earlier one of two equally near."""
    moment = when if isinstance(when, Column) else F.lit(when).cast("timestamp")
    off = F.abs(micros(F.col("timestamp")) - micros(moment))
    near = F.min_by(F.struct(*positions.columns), F.struct(off, F.col("timestamp"), *_ties(positions)))
    return positions.groupBy("mmsi").agg(near.alias("_row")).select("_row.*")


def vessel_history(mmsi: int, positions: DataFrame, tracks: DataFrame | None = None, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """A vessel's rows of each dataset, in order; of encounters also those as the other vessel."""
    out = {"positions": positions.where(F.col("mmsi") == mmsi).orderBy("timestamp")}
    if tracks is not None:
        out["tracks"] = tracks.where(F.col("mmsi") == mmsi).orderBy("start_time")
    if events is not None:
        out["events"] = events.where((F.col("mmsi") == mmsi) | (F.col("other_mmsi") == mmsi)).orderBy("start_time")
    return out


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows inside a box, edges included."""
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def filter_mmsi(df: DataFrame, mmsi: list[int]) -> DataFrame:
    return df.where(F.col("mmsi").isin([int(m) for m in mmsi]))


def vessel_stats(positions: DataFrame) -> DataFrame:
    return positions.groupBy("mmsi").agg(F.count("*").alias("points"), F.avg("sog").alias("mean_sog"), F.max("sog").alias("max_sog"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def top_speeds(positions: DataFrame, n: int = 10) -> DataFrame:
    return positions.groupBy("mmsi").agg(F.max("sog").alias("max_sog")).orderBy(F.desc("max_sog"), "mmsi").limit(n)
