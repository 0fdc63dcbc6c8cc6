"""Digitraffic messages of Finland: locations and metadata by MQTT topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.exprs import blank_to_null, nav_status
from wakeline.sources.base import Access, Capabilities, Delivery, Holdings, unless
from wakeline.sources.registry import register_streaming

CAPABILITIES = Capabilities(
    "finland", "Fintraffic Digitraffic", Access(terms="CC BY 4.0"), Delivery("MQTT over WebSocket", "none", live=True),
    Holdings("around Finland", ("positions", "vessels"), beware=("locations count seconds, metadata milliseconds", "draught in tenths", "the vessel's number is in the topic alone")),
)
register_streaming(CAPABILITIES)

LOCATION = "time long, sog double, cog double, navStat int, heading double, lon double, lat double"
METADATA = "timestamp long, destination string, name string, draught double, callSign string, imo long, type int"


def _topic(topic: Column) -> tuple[Column, Column]:
    parts = F.split(topic, "/")
    return F.try_element_at(parts, F.lit(2)).try_cast("long"), F.try_element_at(parts, F.lit(3))


def locations(messages: DataFrame, topic: str = "topic", value: str = "value", bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Positions of ``vessels-v2/<mmsi>/location`` messages; ``bbox``: west, south, east, north."""
    mmsi, kind = _topic(F.col(topic))
    m = messages.where((kind == "location") & mmsi.isNotNull()).select(mmsi.alias("mmsi"), F.from_json(F.col(value).cast("string"), LOCATION).alias("m"))
    out = m.select(
        "mmsi", F.coalesce(F.timestamp_seconds("m.time"), F.current_timestamp()).alias("timestamp"), "m.lat", "m.lon", "m.sog", "m.cog",
        unless(F.col("m.heading"), 511.0).alias("heading"), nav_status(F.col("m.navStat")).alias("nav_status"), F.lit("finland").alias("source"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL")
    return out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])) if bbox else out


def metadata(messages: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Identities of ``vessels-v2/<mmsi>/metadata`` messages."""
    mmsi, kind = _topic(F.col(topic))
    m = messages.where((kind == "metadata") & mmsi.isNotNull()).select(mmsi.alias("mmsi"), F.from_json(F.col(value).cast("string"), METADATA).alias("m")).where("m IS NOT NULL")
    return m.select(
        "mmsi", F.coalesce(F.timestamp_millis("m.timestamp"), F.current_timestamp()).alias("timestamp"), blank_to_null(F.col("m.name")).alias("vessel_name"),
        F.nullif("m.imo", F.lit(0)).cast("string").alias("imo"), blank_to_null(F.col("m.callSign")).alias("callsign"), blank_to_null(F.col("m.destination")).alias("destination"),
        F.col("m.type").cast("string").alias("ship_type"), (F.col("m.draught") / 10).alias("draught"), F.lit("finland").alias("source"),
    )
