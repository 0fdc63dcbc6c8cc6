"""Distances, times, identifiers and lookups as column expressions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude, and metres a second in a knot.
METRES_PER_DEGREE, KNOT = 111_320.0, 1852.0 / 3600.0

# Navigational status texts by AIS code (fixed by ITU-R M.1371); other codes have none.
NAV_STATUS = {
    0: "Under way using engine",
    1: "At anchor",
    2: "Not under command",
    3: "Restricted maneuverability",
    4: "Constrained by draught",
    5: "Moored",
    6: "Aground",
    7: "Engaged in fishing",
    8: "Under way sailing",
    9: "Reserved for HSC",
    10: "Reserved for WIG",
    14: "AIS-SART",
    15: "Not defined",
}


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, at: Column) -> Column:
    """Equirectangular distance, with the cosine taken at latitude ``at``."""
    north, east = (lat_a - lat_b) * METRES_PER_DEGREE, (lon_a - lon_b) * METRES_PER_DEGREE * F.cos(F.radians(at))
    return F.sqrt(north * north + east * east)


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds as a double."""
    return (micros(later) - micros(earlier)) / 1e6


def whole_seconds(later: Column, earlier: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / 1e6).cast("double")


def bucket(value: Column, width: int) -> Column:
    """The number of the bucket of ``width`` that a long falls into, rounding down."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("long")


def short_id(*parts: Column | str) -> Column:
    """16 hexadecimal digits of the SHA-1 of the parts, joined by colons."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha1(F.concat_ws(":", *[F.coalesce(c, F.lit("None")) for c in columns])), 1, 16)


def track_id(mmsi: Column, start: Column, source: Column, config: str = "") -> Column:
    return short_id(mmsi, micros(start), source, config)


def event_id(kind: str, mmsi: Column, start: Column, source: Column, config: str = "") -> Column:
    return short_id(kind, mmsi, micros(start), source, config)


def nav_status(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAV_STATUS.items() for x in pair])
    return F.try_element_at(table, code.try_cast("int"))


def tiers(default: float, *steps: tuple[Column, float]) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if out is not None else F.lit(default)


def confidence_class(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
