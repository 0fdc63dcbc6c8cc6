"""Canonical datasets: columns, keys and valid ranges, versioned and frozen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "time": T.TimestampType(), "date": T.DateType(),
    "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType()), "longs": T.ArrayType(T.LongType()),
}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(":") for x in text.split())])


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    version: str
    struct: T.StructType
    required: frozenset[str]
    sort: tuple[str, ...]
    dedup: tuple[str, ...] = ()
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    partition: tuple[str, ...] = ("source", "date")

    @property
    def columns(self) -> list[str]:
        return self.struct.names

    @property
    def optional(self) -> frozenset[str]:
        return frozenset(self.columns) - self.required

    def validate(self, df: DataFrame) -> list[str]:
        """What is wrong with a frame's schema, in words; nullability isn't looked at."""
        have = {f.name: f.dataType for f in df.schema}
        want = {f.name: f.dataType for f in self.struct}
        errors = [f"missing required column: {c}" for c in self.columns if c in self.required and c not in have]
        errors += [f"column {c}: expected {want[c].simpleString()}, got {have[c].simpleString()}" for c in self.columns if c in have and have[c] != want[c]]
        return errors + [f"unexpected column: {c}" for c in have if c not in want]

    def conform(self, df: DataFrame) -> DataFrame:
        """All columns in order: missing ones null, others left out, kinds cast where they differ."""
        have = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
        column = lambda f: F.lit(None).cast(f.dataType) if f.name not in have else F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).try_cast(f.dataType)
        return df.select([column(f).alias(f.name) for f in self.struct])

    def in_range(self) -> dict[str, Column]:
        """For each column with a range: whether its value lies in it; null passes."""
        return {c: F.coalesce(F.col(c).between(a, b), F.lit(True)) for c, (a, b) in self.ranges.items()}


_COORDINATES = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}

POSITIONS = DatasetSpec(
    "positions", "positions/v1",
    _struct("mmsi:long timestamp:time lat:double lon:double sog:double cog:double heading:double nav_status:string imo:string callsign:string ship_type:string vessel_name:string length:double beam:double draught:double destination:string eta:time flag:string source:string source_record_id:string source_file:string ingest_id:string record_provenance:string spatial_key:string qc_flags:strings qc_severity:string confidence_score:double"),
    frozenset("mmsi timestamp lat lon source source_file ingest_id qc_severity record_provenance".split()),
    ("mmsi", "timestamp"), ("mmsi", "timestamp", "source"),
    _COORDINATES | {"sog": (0.0, 102.3), "cog": (0.0, 360.0), "heading": (0.0, 360.0), "confidence_score": (0.0, 1.0)},
)
VESSELS = DatasetSpec(
    "vessels", "vessels/v1",
    _struct("mmsi:long imo:string callsign:string vessel_name:string ship_type:string length:double beam:double flag:string first_seen:time last_seen:time source:string record_provenance:string"),
    frozenset("mmsi first_seen last_seen source record_provenance".split()),
    ("mmsi", "last_seen"), ("mmsi", "source"), {"length": (0.0, 500.0), "beam": (0.0, 80.0)},
)
TRACKS = DatasetSpec(
    "tracks", "tracks/v1",
    _struct("track_id:string mmsi:long start_time:time end_time:time point_count:long distance_m:double duration_s:double mean_speed:double max_speed:double bbox_west:double bbox_south:double bbox_east:double bbox_north:double geometry_wkb:binary timestamp_offsets_ms:longs source:string record_provenance:string"),
    frozenset("track_id mmsi start_time end_time point_count distance_m duration_s mean_speed max_speed bbox_west bbox_south bbox_east bbox_north source record_provenance".split()),
    ("mmsi", "start_time"), ("track_id",),
    {"point_count": (1, 1_000_000), "distance_m": (0.0, 1e8), "duration_s": (0.0, 86400.0 * 365), "mean_speed": (0.0, 102.3), "max_speed": (0.0, 102.3)}
    | {c: (-180.0, 180.0) for c in ("bbox_west", "bbox_east")} | {c: (-90.0, 90.0) for c in ("bbox_south", "bbox_north")},
)
EVENTS = DatasetSpec(
    "events", "events/v1",
    _struct("event_id:string event_type:string mmsi:long other_mmsi:long start_time:time end_time:time lat:double lon:double geometry_wkb:binary confidence_score:double source:string record_provenance:string"),
    frozenset("event_id event_type mmsi start_time end_time lat lon confidence_score source record_provenance".split()),
    ("event_type", "mmsi", "start_time"), ("event_id", "other_mmsi"), _COORDINATES | {"confidence_score": (0.0, 1.0)},
)
FISHING_EFFORT = DatasetSpec(
    "fishing_effort", "fishing_effort/v1",
    _struct("date:date lat:double lon:double flag:string geartype:string vessel_hours:double source:string record_provenance:string"),
    frozenset("date vessel_hours source record_provenance".split()),
    ("date", "flag", "geartype"), (), _COORDINATES | {"vessel_hours": (0.0, 1e6)},
)
DATASETS = {s.name: s for s in (POSITIONS, VESSELS, TRACKS, EVENTS, FISHING_EFFORT)}

EVENT_TYPES = ("port_call", "eez_crossing", "encounter", "loitering", "fishing")
SEVERITIES = ("ok", "warning", "error")
