"""Track segmentation: vessels' positions cut at gaps, jumps and time reversals."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.exprs import KNOT, distance_m, micros, seconds_between, track_id, whole_seconds
from wakeline.operators.islands import number_runs
from wakeline.schemas import TRACKS

SEGMENT = "segment"


def _digest(key: str, size: int = 12) -> str:
    return hashlib.sha1(key.encode()).hexdigest()[:size]


@dataclass(frozen=True)
class TrackConfig:
    gap_seconds: int = 1800
    max_speed_knots: float = 50.0
    min_points: int = 3
    min_duration_seconds: int = 300
    min_distance_m: float = 100.0
    include_geometry: bool = False
    generalize_tolerance_m: float = 0.0
    refresh: bool = False

    def config_hash(self) -> str:
        return _digest(f"gap={self.gap_seconds}:speed={self.max_speed_knots}:pts={self.min_points}:dur={self.min_duration_seconds}:dist={self.min_distance_m}:geo={self.include_geometry}:gen={self.generalize_tolerance_m}")

    def validate(self) -> list[str]:
        above, least = ("gap_seconds", "max_speed_knots"), {"min_points": 1, "min_duration_seconds": 0, "min_distance_m": 0, "generalize_tolerance_m": 0}
        errors = [f"{k} must be > 0, got {getattr(self, k)}" for k in above if getattr(self, k) <= 0]
        return errors + [f"{k} must be >= {v}, got {getattr(self, k)}" for k, v in least.items() if getattr(self, k) < v]


def parse_duration(value: str | float) -> int:
    """Seconds of ``90s``, ``30m``, ``1h`` or a bare number."""
    text = str(value).strip().lower()
    unit = {"h": 3600, "m": 60, "s": 1}.get(text[-1:])
    return int(float(text[:-1] if unit else text) * (unit or 1))


def parse_distance(value: str | float) -> float:
    """Metres of ``1km``, ``500m`` or a bare number."""
    text = str(value).strip().lower()
    if text.endswith("km"):
        return float(text[:-2]) * 1000
    return float(text.removesuffix("m"))


def parse_track_args(gap: str | float = "30m", max_speed: float = 50.0, min_points: int = 3, min_duration: str | float = "5m", min_distance: str | float = "100m", include_geometry: bool = False, generalize: str | float = 0, refresh: bool = False) -> TrackConfig:
    return TrackConfig(parse_duration(gap), float(max_speed), int(min_points), parse_duration(min_duration), parse_distance(min_distance), include_geometry, parse_distance(generalize), refresh)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("source", "mmsi") if c in df.columns]


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("timestamp", "lat", "lon") if c in df.columns]


def detect_boundaries(positions: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """Add ``segment``; null where a coordinate is missing, so that the row is in no segment."""
    config = config or TrackConfig()

    def breaks(previous):
        seconds = seconds_between(F.col("timestamp"), previous["timestamp"])
        moved = distance_m(F.col("lat"), F.col("lon"), previous["lat"], previous["lon"], F.col("lat"))
        return (seconds > config.gap_seconds) | (seconds <= 0) | (F.try_divide(moved, seconds) > config.max_speed_knots * KNOT)

    return number_runs(positions, _keys(positions), _order(positions), breaks, ["timestamp", "lat", "lon"], SEGMENT)


def _stepped(segments: DataFrame) -> DataFrame:
    """Add ``_step``, the metres from the row before in the segment."""
    line = Window.partitionBy(*_keys(segments), SEGMENT).orderBy(*_order(segments))
    previous = F.lag(F.struct("lat", "lon")).over(line)
    return segments.where(F.col(SEGMENT).isNotNull()).withColumn("_p", previous).withColumn("_step", distance_m(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon"), F.col("lat"))).drop("_p")


def filter_segments(segments: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """Rows of segments that are long enough in points, whole seconds and metres; by windows, without a join."""
    config = config or TrackConfig()
    whole = Window.partitionBy(*_keys(segments), SEGMENT)
    rows = _stepped(segments).withColumn("_n", F.count("*").over(whole)).withColumn("_s", whole_seconds(F.max("timestamp").over(whole), F.min("timestamp").over(whole))).withColumn("_m", F.coalesce(F.sum("_step").over(whole), F.lit(0.0)))
    return rows.where((F.col("_n") >= config.min_points) & (F.col("_s") >= config.min_duration_seconds) & (F.col("_m") >= config.min_distance_m)).drop("_n", "_s", "_m", "_step")


def wkb_linestring(coordinates: list[tuple[float, float]]) -> bytes | None:
    """Little-endian WKB of a line of (lon, lat); null for fewer than two points."""
    if coordinates is None or len(coordinates) < 2:
        return None
    return struct.pack("<BII", 1, 2, len(coordinates)) + b"".join(struct.pack("<dd", x, y) for x, y in coordinates)


def simplify(points: list[tuple[float, float]], tolerance_m: float) -> list[int]:
    """Positions of the points that Douglas-Peucker keeps, distances taken at the line's mean latitude."""
    import math

    if tolerance_m <= 0 or len(points) < 3:
        return list(range(len(points)))
    scale = math.cos(math.radians(sum(p[1] for p in points) / len(points)))
    flat = [(x * 111_320.0 * scale, y * 111_320.0) for x, y in points]
    keep, open_ = {0, len(points) - 1}, [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        (ax, ay), (bx, by) = flat[a], flat[b]
        length, far, at = math.hypot(bx - ax, by - ay), tolerance_m, -1
        for i in range(a + 1, b):
            x, y = flat[i][0] - ax, flat[i][1] - ay
            off = abs((bx - ax) * y - (by - ay) * x) / length if length else math.hypot(x, y)
            if off > far:
                far, at = off, i
        if at >= 0:
            keep.add(at)
            open_ += [(a, at), (at, b)]
    return sorted(keep)


def _with_geometry(tracks: DataFrame, tolerance_m: float) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines, offsets = [], []
            for points in batch.column(batch.num_columns - 1).to_pylist():
                line = [(p["lon"], p["lat"]) for p in points]
                kept = simplify(line, tolerance_m)
                lines.append(wkb_linestring([line[i] for i in kept]))
                offsets.append([(points[i]["us"] - points[0]["us"]) // 1000 for i in kept])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.binary()), pa.array(offsets, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "geometry_wkb", "timestamp_offsets_ms"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in tracks.dtypes[:-1])
    return tracks.mapInArrow(run, f"{kinds}, geometry_wkb binary, timestamp_offsets_ms array<long>")


def aggregate_tracks(segments: DataFrame, config: TrackConfig | None = None, source: str | None = None) -> DataFrame:
    """One track a segment that is long enough, by a single grouping after the window."""
    config = config or TrackConfig()
    rows = _stepped(segments)
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(source or ""))
    has_speed = "sog" in rows.columns
    sums = [
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("point_count"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance_m"), F.min("lon").alias("bbox_west"), F.min("lat").alias("bbox_south"), F.max("lon").alias("bbox_east"), F.max("lat").alias("bbox_north"),
    ]
    if has_speed:
        sums += [F.avg("sog").alias("mean_speed"), F.max("sog").alias("max_speed")]
    if config.include_geometry:
        sums.append(F.array_sort(F.collect_list(F.struct(micros(F.col("timestamp")).alias("us"), "lat", "lon"))).alias("_points"))
    out = rows.groupBy("source", "mmsi", SEGMENT).agg(*sums).withColumn("duration_s", whole_seconds(F.col("end_time"), F.col("start_time")))
    out = out.where((F.col("point_count") >= config.min_points) & (F.col("duration_s") >= config.min_duration_seconds) & (F.col("distance_m") >= config.min_distance_m))
    if not has_speed:
        out = out.withColumn("mean_speed", F.col("distance_m") / F.greatest("duration_s", F.lit(1.0)) / 0.5144).withColumn("max_speed", F.lit(None).cast("double"))
    out = out.withColumn("track_id", track_id(F.col("mmsi"), F.col("start_time"), F.col("source"), config.config_hash()))
    own = F.coalesce(F.nullif(F.lit(source), F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("derived")) if source else F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("derived"))
    out = out.withColumn("record_provenance", F.concat(own, F.lit(":tracks")))
    if config.include_geometry:
        out = _with_geometry(out.select(*[c for c in out.columns if c != "_points"], "_points"), config.generalize_tolerance_m)
    return TRACKS.conform(out)


def build_tracks(positions: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """Tracks of each source's vessels: one shuffle by (source, mmsi) serves windows and grouping."""
    return aggregate_tracks(detect_boundaries(positions, config), config)


@dataclass(frozen=True)
class TrackCacheKey:
    """What a derived partition depends on; equal keys mean that it can be read again."""

    dataset: str
    source: str
    date: str
    config_hash: str
    schema_version: str = TRACKS.version
    upstream_version: str = "positions/v1"
    upstream_hash: str = ""

    def key(self) -> str:
        return _digest(":".join((self.dataset, self.source, self.date, self.config_hash, self.schema_version, self.upstream_version, self.upstream_hash)), 16)


def upstream_hash(record_count: int, checksums: list[str]) -> str:
    return _digest(f"n={record_count}:" + "+".join(sorted(checksums)))
