"""Density of positions on a rounded grid, or on H3 cells where that library is there."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DensityConfig:
    resolution: int = 4

    def config_hash(self) -> str:
        return hashlib.sha1(f"res={self.resolution}".encode()).hexdigest()[:12]


def decimals(resolution: int) -> int:
    return max(0, (resolution - 1) // 3 + 1)


def compute_density(positions: DataFrame, resolution: int = 4, approximate: bool = False) -> DataFrame:
    """cell_id, centre, vessels and observations of each cell, busiest first; ``approximate`` counts vessels by sketch."""
    places = decimals(resolution)
    vessels = F.approx_count_distinct("mmsi") if approximate else F.count_distinct("mmsi")
    cells = positions.select("mmsi", F.round("lat", places).alias("center_lat"), F.round("lon", places).alias("center_lon"))
    out = cells.groupBy("center_lat", "center_lon").agg(vessels.alias("vessel_count"), F.count("*").alias("observation_count"))
    return out.select(F.concat_ws(",", "center_lat", "center_lon").alias("cell_id"), "center_lat", "center_lon", "vessel_count", "observation_count").orderBy(F.desc("observation_count"), "center_lat", "center_lon")


def bin_positions(positions: DataFrame, resolution: int = 4) -> DataFrame:
    """h3_index, count and centre, busiest first; a rounded grid stands in where h3 is missing."""
    try:
        import h3

        _ = h3.latlng_to_cell
    except (ImportError, AttributeError):
        places = decimals(resolution)
        grid = positions.groupBy(F.round("lat", places).alias("center_lat"), F.round("lon", places).alias("center_lon")).agg(F.count("*").alias("count"))
        return grid.select(F.concat_ws(",", "center_lat", "center_lon").alias("h3_index"), "count", "center_lat", "center_lon").orderBy(F.desc("count"), "h3_index")

    @F.pandas_udf("string")
    def cell(lat, lon):
        import pandas as pd

        return pd.Series([h3.latlng_to_cell(a, b, resolution) for a, b in zip(lat, lon, strict=True)])

    @F.pandas_udf("center_lat double, center_lon double")
    def centre(index):
        import pandas as pd

        return pd.DataFrame([h3.cell_to_latlng(i) for i in index], columns=["center_lat", "center_lon"])

    counts = positions.groupBy(cell("lat", "lon").alias("h3_index")).agg(F.count("*").alias("count"))
    return counts.withColumn("c", centre("h3_index")).select("h3_index", "count", "c.center_lat", "c.center_lon").orderBy(F.desc("count"), "h3_index")
