"""Named regions: boxes, optionally with a polygon, tested on columns.

A point lies in a region if it lies in its box, edges included, and, where the
region has a ring, inside that ring.  Small datasets fold into one expression;
any dataset can be joined as a frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regions that fold into an expression; beyond it they are joined.
FOLDED = 200


@dataclass(frozen=True)
class Region:
    name: str
    west: float
    south: float
    east: float
    north: float
    ring: tuple[tuple[float, float], ...] = ()

    def contains(self, lat: Column, lon: Column) -> Column:
        box = lon.between(self.west, self.east) & lat.between(self.south, self.north)
        return box & in_ring(lon, lat, self.ring) if self.ring else box


@dataclass(frozen=True)
class BoundaryDataset:
    name: str
    version: str
    regions: tuple[Region, ...]

    @property
    def tag(self) -> str:
        return f"{self.name}/{self.version}"


def in_ring(x: Column, y: Column, ring: tuple[tuple[float, float], ...]) -> Column:
    """Ray casting: whether an odd number of edges is crossed and none is touched; a closing point may be left out."""
    points = list(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    crossed, touched = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        along = y.between(min(ay, by), max(ay, by))
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            edge = (y - ay) * ((bx - ax) / (by - ay)) + ax
            crossed = crossed + F.when(spans & (x < edge), 1).otherwise(0)
            touched = touched | (along & (x == edge))
        else:
            touched = touched | (along & x.between(min(ax, bx), max(ax, bx)))
    return (crossed % 2 == 1) & ~touched


def in_ring_column(x: Column, y: Column, ring: Column) -> Column:
    """As ``in_ring`` for rings in a column, arrays of (x, y) that don't close."""
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))
    low, high = (lambda e, n: F.least(e["a"][n], e["b"][n])), (lambda e, n: F.greatest(e["a"][n], e["b"][n]))
    level = lambda e: e["a"]["y"] == e["b"]["y"]
    edge = lambda e: (y - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    crossed = F.filter(edges, lambda e: ~level(e) & ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < edge(e)))
    touched = F.exists(edges, lambda e: y.between(low(e, "y"), high(e, "y")) & F.when(level(e), x.between(low(e, "x"), high(e, "x"))).otherwise(x == edge(e)))
    return (F.size(crossed) % 2 == 1) & ~touched


class BoundaryRegistry:
    """Datasets by name, in order of registration; registering a name again replaces it."""

    def __init__(self, *datasets: BoundaryDataset):
        self._datasets: dict[str, BoundaryDataset] = {}
        for d in datasets:
            self.register(d)

    def register(self, dataset: BoundaryDataset) -> None:
        self._datasets[dataset.name] = dataset

    def get(self, name: str) -> BoundaryDataset | None:
        return self._datasets.get(name)

    def datasets(self) -> list[str]:
        return list(self._datasets)

    def provenance_tags(self) -> list[str]:
        return sorted(d.tag for d in self._datasets.values())

    def region_of(self, dataset: str, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
        """The first region that holds the point; null outside, for null coordinates and unknown datasets."""
        lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
        known = self.get(dataset)
        found = F.lit(None).cast("string")
        for region in reversed(known.regions if known else ()):
            found = F.when(region.contains(lat, lon), region.name).otherwise(found)
        return found

    def regions_of(self, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
        """All (dataset, region) that hold the point, in order of registration."""
        lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
        each = [F.when(r.contains(lat, lon), F.struct(F.lit(d.name).alias("dataset"), F.lit(r.name).alias("region"))) for d in self._datasets.values() for r in d.regions]
        return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<dataset:string,region:string>>")

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row a region; ``ring`` is empty for a box."""
        flat = lambda ring: ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        rows = [(d.name, i, r.name, *map(float, (r.west, r.south, r.east, r.north)), [tuple(map(float, p)) for p in flat(r.ring)]) for d in self._datasets.values() for i, r in enumerate(d.regions)]
        return spark.createDataFrame(rows, "dataset string, ord int, region string, west double, south double, east double, north double, ring array<struct<x:double,y:double>>")

    def label(self, positions: DataFrame, dataset: str, name: str = "region") -> DataFrame:
        """``positions`` with the region of each point.

        Datasets of more than ``FOLDED`` regions, boxes or polygons, meet points
        by one-degree cells: a cell's regions are one row, so points are
        neither multiplied nor grouped again.
        """
        known = self.get(dataset)
        if known is None or len(known.regions) <= FOLDED:
            return positions.withColumn(name, self.region_of(dataset))
        degree = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
        parts = self.frame(positions.sparkSession).where(F.col("dataset") == dataset).withColumn("_x", degree("west", "east")).withColumn("_y", degree("south", "north"))
        cells = parts.groupBy("_x", "_y").agg(F.array_sort(F.collect_list(F.struct("ord", "region", "west", "south", "east", "north", "ring"))).alias("_regions"))
        lat, lon = F.col("lat"), F.col("lon")
        holds = lambda r: lon.between(r["west"], r["east"]) & lat.between(r["south"], r["north"]) & ((F.size(r["ring"]) == 0) | in_ring_column(lon, lat, r["ring"]))
        rows = positions.withColumn("_x", F.floor("lon")).withColumn("_y", F.floor("lat")).join(cells, ["_x", "_y"], "left")
        first = F.try_element_at(F.filter("_regions", holds), F.lit(1))
        return rows.select(*positions.columns, first["region"].alias(name))
