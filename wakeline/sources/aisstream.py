"""AISStream messages: position reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.exprs import blank_to_null, nav_status
from wakeline.sources.base import Access, Capabilities, Delivery, Holdings, unless
from wakeline.sources.registry import register_streaming

CAPABILITIES = Capabilities(
    "aisstream", "aisstream.io", Access(True, terms="a free key"), Delivery("JSON over WebSocket", "none", live=True, by_box=True),
    Holdings("where receivers on land reach", rows_a_day=(10_000_000, 100_000_000), beware=("heading 511 is unknown",)),
)
register_streaming(CAPABILITIES)

MESSAGE = (
    "MessageType string, MetaData struct<MMSI:long,time_utc:string,ShipName:string,latitude:double,longitude:double>, "
    "Message struct<PositionReport:struct<Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:int>>"
)


def subscription(api_key: str, bbox: tuple[float, float, float, float] | None = None, mmsi: list[int] | None = None) -> dict:
    """What the service is asked for; ``bbox`` is west, south, east, north, the globe without it."""
    west, south, east, north = bbox or (-180.0, -90.0, 180.0, 90.0)
    out = {"APIKey": api_key, "BoundingBoxes": [[[south, west], [north, east]]], "FilterMessageTypes": ["PositionReport"]}
    return out | {"FiltersShipMMSI": [str(m) for m in mmsi]} if mmsi else out


def normalize(messages: DataFrame, value: str = "value") -> DataFrame:
    """Position reports of JSON messages, static or streaming; a time that can't be read becomes the present."""
    m = messages.withColumn("m", F.from_json(F.col(value).cast("string"), MESSAGE)).where("m.MessageType = 'PositionReport'")
    clean = F.regexp_replace(F.regexp_replace(F.trim("m.MetaData.time_utc"), r"\s*UTC$", ""), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    clean = F.regexp_replace(clean, r"(\.\d{6})\d+", "$1")
    when = F.coalesce(F.trim(F.regexp_replace(clean, r"\s+([+-]\d{2}:\d{2})$", "$1")).try_cast("timestamp"), F.current_timestamp())
    report = "m.Message.PositionReport"
    return m.select(
        F.col("m.MetaData.MMSI").alias("mmsi"), when.alias("timestamp"), F.col("m.MetaData.latitude").alias("lat"), F.col("m.MetaData.longitude").alias("lon"),
        F.col(f"{report}.Sog").alias("sog"), F.col(f"{report}.Cog").alias("cog"), unless(F.col(f"{report}.TrueHeading"), 511.0).alias("heading"),
        nav_status(F.col(f"{report}.NavigationalStatus")).alias("nav_status"), blank_to_null(F.col("m.MetaData.ShipName")).alias("vessel_name"), F.lit("aisstream").alias("source"),
    ).where("mmsi IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
