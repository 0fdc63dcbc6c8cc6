"""Event detectors: port calls, boundary crossings, encounters and loitering.

Each detector is windows and groupings on one shuffle by vessel (encounters:
blocks of two groups of vessels), and gives rows of events/v1.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.exprs import METRES_PER_DEGREE, bucket, distance_m, event_id, micros, seconds_between, tiers, whole_seconds
from wakeline.operators import meetings
from wakeline.operators.islands import number_runs, time_gap
from wakeline.schemas import EVENTS

VERSION = "0.1.0"


class _Hashed:
    _names: tuple[tuple[str, str], ...] = ()

    def config_hash(self) -> str:
        return hashlib.sha1(":".join(f"{short}={getattr(self, name)}" for short, name in self._names).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class PortCallConfig(_Hashed):
    max_speed_knots: float = 3.0
    min_duration_s: int = 3600
    min_points: int = 3
    gap_seconds: int = 7200
    _names = (("speed", "max_speed_knots"), ("dur", "min_duration_s"), ("pts", "min_points"), ("gap", "gap_seconds"))


@dataclass(frozen=True)
class EEZCrossingConfig(_Hashed):
    max_gap_s: int = 7200
    max_distance_m: float = 100_000.0
    _names = (("gap", "max_gap_s"), ("dist", "max_distance_m"))


@dataclass(frozen=True)
class EncounterConfig(_Hashed):
    max_distance_m: float = 500.0
    min_duration_s: int = 600
    min_observations: int = 2
    time_bucket_s: int = 300
    gap_seconds: int = 3600
    _names = (("dist", "max_distance_m"), ("dur", "min_duration_s"), ("obs", "min_observations"), ("bucket", "time_bucket_s"), ("gap", "gap_seconds"))


@dataclass(frozen=True)
class LoiteringConfig(_Hashed):
    max_speed_knots: float = 2.0
    max_radius_m: float = 1000.0
    min_duration_s: int = 1800
    min_points: int = 3
    gap_seconds: int = 3600
    _names = (("speed", "max_speed_knots"), ("radius", "max_radius_m"), ("dur", "min_duration_s"), ("pts", "min_points"), ("gap", "gap_seconds"))


@dataclass(frozen=True)
class EventProvenance:
    """``source:detector/version[a+b]`` as its parts."""

    source: str
    detector: str
    detector_version: str = VERSION
    upstream_datasets: tuple[str, ...] = field(default=("tracks",))

    def __post_init__(self):
        if not self.upstream_datasets:
            raise ValueError("an event derives from one dataset at least")
        object.__setattr__(self, "upstream_datasets", tuple(sorted(self.upstream_datasets)))

    def to_token(self) -> str:
        return f"{self.source}:{self.detector}/{self.detector_version}[{'+'.join(self.upstream_datasets)}]"


_TOKEN = r"^([^:]*):([^/\[]*)/([^\[]*)\[(.*)\]$"


def parse_provenance(token: str) -> EventProvenance:
    import re

    found = re.match(_TOKEN, token)
    if not found:
        raise ValueError(f"no provenance token: {token!r}")
    return EventProvenance(found[1], found[2], found[3], tuple(found[4].split("+")))


def provenance_parts(token: Column) -> Column:
    """The parts of a token column, as a struct."""
    part = lambda i: F.regexp_extract(token, _TOKEN, i)
    return F.struct(part(1).alias("source"), part(2).alias("detector"), part(3).alias("detector_version"), F.split(part(4), r"\+").alias("upstream_datasets"))


def _events(df: DataFrame, kind: str, config, source: str | None, upstream: tuple[str, ...]) -> DataFrame:
    token = EventProvenance(source or "derived", f"{kind}_detector", VERSION, upstream).to_token()
    named = df.withColumn("event_type", F.lit(kind)).withColumn("record_provenance", F.lit(token))
    return EVENTS.conform(named.withColumn("event_id", event_id(kind, F.col("mmsi"), F.col("start_time"), F.col("source"), config.config_hash())))


def _with_source(positions: DataFrame) -> DataFrame:
    return positions if "source" in positions.columns else positions.withColumn("source", F.lit(None).cast("string"))


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("timestamp", "lat", "lon", "source") if c in df.columns]


def _first_source() -> Column:
    return F.min_by("source", F.struct("timestamp", "lat", "lon", "source"))


def detect_port_calls(positions: DataFrame, region: str = "region", config: PortCallConfig | None = None, source: str | None = None) -> DataFrame:
    """Slow stays in one region; ``region`` is a column, null outside all regions."""
    config = config or PortCallConfig()
    slow = _with_source(positions).where(F.col(region).isNotNull() & (F.col("sog") <= config.max_speed_knots))
    breaks = lambda before: (F.col(region) != before[region]) | time_gap(before, config.gap_seconds)
    runs = number_runs(slow, ["mmsi"], _order(slow), breaks, ["timestamp", region], "run")
    calls = runs.groupBy("mmsi", "run").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("points"), _first_source().alias("source"))
    seconds = whole_seconds(F.col("end_time"), F.col("start_time"))
    calls = calls.withColumn("seconds", seconds).where((F.col("seconds") >= config.min_duration_s) & (F.col("points") >= config.min_points))
    calls = calls.withColumn("confidence_score", tiers(0.5, (F.col("seconds") >= 14400, 0.9), (F.col("seconds") >= 7200, 0.7)))
    return _events(calls, "port_call", config, source, ("boundaries", "positions"))


def detect_eez_crossings(positions: DataFrame, region: str = "region", config: EEZCrossingConfig | None = None, source: str | None = None) -> DataFrame:
    """Consecutive rows of a vessel in two different regions; rows outside all regions count as the row before."""
    config = config or EEZCrossingConfig()
    rows = _with_source(positions)
    line = Window.partitionBy("mmsi").orderBy(*_order(rows))
    rows = rows.withColumn("_p", F.lag(F.struct("timestamp", "lat", "lon", F.col(region).alias("region"))).over(line))
    crossed = F.col(region).isNotNull() & F.col("_p.region").isNotNull() & (F.col(region) != F.col("_p.region"))
    seconds = seconds_between(F.col("timestamp"), F.col("_p.timestamp"))
    metres = distance_m(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon"), F.col("lat"))
    rows = rows.where(crossed).select(
        "mmsi", "source", F.col("_p.timestamp").alias("start_time"), F.col("timestamp").alias("end_time"),
        ((F.col("lat") + F.col("_p.lat")) / 2).alias("lat"), ((F.col("lon") + F.col("_p.lon")) / 2).alias("lon"), seconds.alias("seconds"), metres.alias("metres"),
    )
    rows = rows.where((F.col("seconds") > 0) & (F.col("seconds") <= config.max_gap_s) & (F.col("metres") <= config.max_distance_m))
    score = tiers(0.5, ((F.col("seconds") <= 1800) & (F.col("metres") <= 20_000), 0.9), ((F.col("seconds") <= 7200) & (F.col("metres") <= 100_000), 0.7))
    return _events(rows.withColumn("confidence_score", score), "eez_crossing", config, source, ("boundaries", "positions"))


#: Height and width of a cell, and of a zone that vessels are grouped by, in distances.
CELL, ZONE = 4, 16
#: Groups of vessels at most; rows and pairs of rows (as counted by zone) of one group, about.
GROUPS, GROUP_ROWS, GROUP_PAIRS = 256, 200_000, 64_000_000
#: Partitions that blocks are dealt to, for each core.
DEALT = 8


def _reach(config: EncounterConfig) -> float:
    """Degrees, a little more than the distance, against rounding."""
    return max(config.max_distance_m, 1.0) * 1.001 / METRES_PER_DEGREE


def _vessel_groups(rows: DataFrame, reach: float, bucket: str = "bucket") -> DataFrame:
    """``own``, the group of each vessel: vessels of one zone share groups, a crowded zone has more of them.

    Only whole numbers and extremes decide, so that it is the same each time it is computed.
    """
    zone = lambda lat, lon: (F.floor(lat / (ZONE * reach)).alias("zy"), F.floor(lon / (ZONE * reach)).alias("zx"))
    counted = rows.groupBy(*zone(F.col("lat"), F.col("lon")), bucket).agg(F.count("*").alias("n"))
    zones = counted.groupBy("zy", "zx").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * 3).alias("met"))
    parts = F.ceil(F.greatest(F.col("n") / GROUP_ROWS, F.sqrt(F.col("met") / GROUP_PAIRS), F.lit(1.0)))
    middle = lambda c: (F.min(c) + F.max(c)) / 2
    home = rows.groupBy("mmsi").agg(middle("lat").alias("lat"), middle("lon").alias("lon")).select("mmsi", *zone(F.col("lat"), F.col("lon")))
    home = home.join(zones.select("zy", "zx", parts.alias("parts")), ["zy", "zx"], "left")
    part = F.pmod(F.xxhash64("mmsi"), F.coalesce("parts", F.lit(1)).cast("long"))
    return home.select("mmsi", F.pmod(F.xxhash64("zy", "zx", part), F.lit(GROUPS)).cast("int").alias("own"))


def _meetings(positions: DataFrame, config: EncounterConfig, runs: meetings.Runs | None) -> DataFrame:
    """Observations of pairs, or runs of them.

    A cell is ``CELL`` distances high, and as wide at the latitude within it
    where degrees of longitude are shortest.  Each group of vessels tells the
    buckets and cells around its rows that it was there; a row goes to the block
    of its own group and each one that was around it, unless that is its own
    vessel alone.  So a pair of vessels meets in one block, and rows are shuffled,
    not pairs.
    """
    rows = _with_source(positions).where("lat IS NOT NULL AND lon IS NOT NULL AND timestamp IS NOT NULL AND mmsi IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    at = micros(F.col("timestamp"))
    rows = rows.select(F.col("mmsi").cast("long").alias("mmsi"), at.alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "source", bucket(at, config.time_bucket_s * 1_000_000).alias("bucket"))
    reach = _reach(config)
    height = CELL * reach
    rows = rows.join(_vessel_groups(rows, reach), "mmsi")
    shortest = F.least(F.cos(F.radians(F.col("y") * height - reach)), F.cos(F.radians((F.col("y") + 1) * height + reach)))
    wide = F.when(shortest > 0.01, reach / shortest).otherwise(F.lit(360.0))
    cell = lambda x, size: F.floor(x / size).cast("long")
    touched = lambda x, by, size: F.explode(F.sequence(cell(x - by, size), cell(x + by, size)))
    keys = ["bucket", "y", "x"]
    here = rows.withColumn("y", cell(F.col("lat"), height)).withColumn("x", cell(F.col("lon"), CELL * wide))
    there = rows.withColumn("y", touched(F.col("lat"), reach, height)).withColumn("x", touched(F.col("lon"), wide, CELL * wide))
    there = there.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)))
    there = there.groupBy(*keys, F.col("own").alias("other")).agg(F.min("mmsi").alias("least"), F.max("mmsi").alias("most"))
    dealt = here.join(there, keys).where((F.col("least") != F.col("mmsi")) | (F.col("most") != F.col("mmsi")))
    dealt = dealt.select(F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "mmsi", "at", "lat", "lon", "source", "bucket")
    # of a fixed number, as small rows make much work: blocks aren't put together by their bytes
    dealt = dealt.repartition(DEALT * positions.sparkSession.sparkContext.defaultParallelism, "first", "second")
    dealt = dealt.sortWithinPartitions("first", "second", "mmsi", "at", "lat", "lon", "source")
    near = meetings.Nearness(config.max_distance_m, METRES_PER_DEGREE, reach, CELL)
    schema = meetings.MET if runs else meetings.OBSERVATIONS
    return dealt.mapInArrow(meetings.meet(near, runs, [c.split()[0] for c in schema.split(", ")]), schema)


def encounter_observations(positions: DataFrame, config: EncounterConfig | None = None) -> DataFrame:
    """Pairs of observations of two vessels that are near in time and space.

    Rows that share vessel and time stand for one observation: the first by position.
    """
    seen = _meetings(positions, config or EncounterConfig(), None)
    seen = seen.withColumns({"timestamp_a": F.timestamp_micros("at_a"), "timestamp_b": F.timestamp_micros("at_b")})
    return seen.select("mmsi_a", "mmsi_b", "timestamp_a", "timestamp_b", "lat_a", "lon_a", "source_a", "lat_b", "lon_b", "metres", F.least("timestamp_a", "timestamp_b").alias("timestamp"))


def detect_encounters(positions: DataFrame, config: EncounterConfig | None = None, source: str | None = None) -> DataFrame:
    config = config or EncounterConfig()
    met = _meetings(positions, config, meetings.Runs(config.gap_seconds, config.min_duration_s, config.min_observations))
    met = met.withColumns({"start_time": F.timestamp_micros("began"), "end_time": F.timestamp_micros("ended")})
    score = tiers(0.5, ((F.col("seconds") >= 3600) & (F.col("metres") <= 200), 0.9), ((F.col("seconds") >= 600) & (F.col("metres") <= 500), 0.7))
    return _events(met.withColumn("confidence_score", score), "encounter", config, source, ("positions",))


def detect_loitering(positions: DataFrame, config: LoiteringConfig | None = None, source: str | None = None) -> DataFrame:
    """Slow runs that stay within a radius of their own centre."""
    config = config or LoiteringConfig()
    slow = _with_source(positions).where(F.col("sog") <= config.max_speed_knots)
    runs = number_runs(slow, ["mmsi"], _order(slow), lambda before: time_gap(before, config.gap_seconds), ["timestamp"], "run")
    whole = Window.partitionBy("mmsi", "run")
    runs = runs.withColumn("_lat", F.avg("lat").over(whole)).withColumn("_lon", F.avg("lon").over(whole))
    stays = runs.groupBy("mmsi", "run").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.first("_lat").alias("lat"), F.first("_lon").alias("lon"), F.count("*").alias("points"),
        F.max(distance_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), F.col("_lat"))).alias("radius"), _first_source().alias("source"),
    ).withColumn("seconds", whole_seconds(F.col("end_time"), F.col("start_time")))
    stays = stays.where((F.col("seconds") >= config.min_duration_s) & (F.col("points") >= config.min_points) & (F.col("radius") <= config.max_radius_m))
    score = tiers(0.5, ((F.col("seconds") >= 7200) & (F.col("radius") <= 500), 0.9), ((F.col("seconds") >= 1800) & (F.col("radius") <= 1000), 0.7))
    return _events(stays.withColumn("confidence_score", score), "loitering", config, source, ("positions",))


@dataclass(frozen=True)
class EventCacheKey:
    event_type: str
    source: str
    date: str
    config_hash: str
    schema_version: str = EVENTS.version
    upstream_version: str = "tracks/v1"
    upstream_hash: str = ""

    def key(self) -> str:
        return hashlib.sha1(":".join((self.event_type, self.source, self.date, self.config_hash, self.schema_version, self.upstream_version, self.upstream_hash)).encode()).hexdigest()[:16]
