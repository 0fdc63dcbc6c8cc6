"""Danish Maritime Authority: CSV in ZIP, daily from March 2024, monthly before."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.exprs import blank_to_null
from wakeline.sources.base import Access, Capabilities, Delivery, FetchSpec, Holdings, RawArtifact, Source, download, number, read_delimited, stamped, unless
from wakeline.sources.registry import register

DAILY_START = date(2024, 3, 1)
# Fixed column names of the feed, with both headers of its time column.
COLUMNS = {
    "# Timestamp": "timestamp",
    "Timestamp": "timestamp",
    "MMSI": "mmsi",
    "Latitude": "lat",
    "Longitude": "lon",
    "SOG": "sog",
    "COG": "cog",
    "Heading": "heading",
    "IMO": "imo",
    "Callsign": "callsign",
    "Name": "vessel_name",
    "Ship type": "ship_type",
    "Navigational status": "nav_status",
    "Width": "beam",
    "Length": "length",
    "Draught": "draught",
    "Destination": "destination",
}


def normalize(raw: DataFrame, day: date | None = None) -> DataFrame:
    """``day`` keeps one day of a monthly archive."""
    out = raw.select(
        "source_file", F.col("mmsi").try_cast("long").alias("mmsi"), F.try_to_timestamp("timestamp", F.lit("dd/MM/yyyy HH:mm:ss")).alias("timestamp"),
        *[number(c).alias(c) for c in ("lat", "lon", "sog", "cog", "length", "beam", "draught")],
        unless(number("heading"), 511.0).alias("heading"), unless(F.trim("imo"), "0", "", "Unknown").alias("imo"),
        *[blank_to_null(F.col(c)).alias(c) for c in ("callsign", "vessel_name", "ship_type", "nav_status", "destination")],
    )
    return out.where(F.to_date("timestamp") == F.lit(day)) if day else out


@register
class DMA(Source):
    SOURCE_ID = "dma"
    capabilities = Capabilities(
        "dma", "Danish Maritime Authority", Access(terms="open data"), Delivery("CSV in ZIP, by day, by month before March 2024", "2-3 days", archive_from=date(2006, 3, 1)),
        Holdings("around Denmark", ("positions", "vessels"), (1_000_000, 5_000_000), ("heading 511 is unknown", "IMO 0 or empty is unknown", "semicolons in old files, commas in new ones")),
    )

    def url(self, day: date) -> str:
        part = "%Y-%m-%d" if day >= DAILY_START else "%Y-%m"
        return f"http://aisdata.ais.dk/{day.year}/aisdk-{day.strftime(part)}.zip"

    def fetch_raw(self, spec: FetchSpec) -> list[RawArtifact]:
        url = self.url(spec.day)
        return [download(url, f"{spec.raw_dir}/{url.rsplit('/', 1)[-1]}")]

    def available_dates(self):
        return self.capabilities.delivery.archive_from, date.today()

    def normalize_positions(self, spark: SparkSession, paths: list[str], day: date | None = None) -> DataFrame:
        monthly = day if day and day < DAILY_START else None
        return stamped(normalize(read_delimited(spark, paths, COLUMNS), monthly), self.SOURCE_ID)
