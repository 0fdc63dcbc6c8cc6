"""NOAA Marine Cadastre: one ZIP of CSV a day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.exprs import blank_to_null, nav_status
from wakeline.sources.base import Access, Capabilities, Delivery, FetchSpec, Holdings, RawArtifact, Source, download, number, read_delimited, stamped, unless
from wakeline.sources.registry import register

BASE_URL = "https://coast.noaa.gov/htdata/CMSP/AISDataHandler"
# Fixed column names of the feed and what they are called here.
COLUMNS = {
    "MMSI": "mmsi",
    "BaseDateTime": "timestamp",
    "LAT": "lat",
    "LON": "lon",
    "SOG": "sog",
    "COG": "cog",
    "Heading": "heading",
    "VesselName": "vessel_name",
    "IMO": "imo",
    "CallSign": "callsign",
    "VesselType": "ship_type",
    "Status": "nav_status",
    "Length": "length",
    "Width": "beam",
    "Draft": "draught",
}


def normalize(raw: DataFrame) -> DataFrame:
    """Raw strings under canonical names to positions; what can't be read becomes null."""
    status = F.coalesce(nav_status(F.col("nav_status").try_cast("double")), F.when(F.col("nav_status").try_cast("double").isNull(), blank_to_null(F.col("nav_status"))))
    return raw.select(
        "source_file", F.col("mmsi").try_cast("long").alias("mmsi"), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        *[number(c).alias(c) for c in ("lat", "lon", "sog", "cog", "length", "beam", "draught")],
        unless(number("heading"), 511.0).alias("heading"), status.alias("nav_status"),
        unless(blank_to_null(F.col("imo")), "IMO0000000").alias("imo"), *[blank_to_null(F.col(c)).alias(c) for c in ("callsign", "ship_type", "vessel_name")],
    )


@register
class NOAA(Source):
    SOURCE_ID = "noaa"
    capabilities = Capabilities(
        "noaa", "NOAA Marine Cadastre", Access(terms="public domain"), Delivery("CSV, one ZIP a day", "a day", archive_from=date(2009, 1, 1)),
        Holdings("coasts of the United States", ("positions", "vessels"), (500_000, 2_000_000), ("heading 511 is unknown", "IMO0000000 is unknown", "vessel types are numbers")),
    )

    def url(self, day: date) -> str:
        return f"{BASE_URL}/{day.year}/AIS_{day:%Y_%m_%d}.zip"

    def fetch_raw(self, spec: FetchSpec) -> list[RawArtifact]:
        url = self.url(spec.day)
        return [download(url, f"{spec.raw_dir}/{url.rsplit('/', 1)[-1]}")]

    def available_dates(self):
        return self.capabilities.delivery.archive_from, date.today()

    def normalize_positions(self, spark: SparkSession, paths: list[str], day: date | None = None) -> DataFrame:
        return stamped(normalize(read_delimited(spark, paths, COLUMNS, ",")), self.SOURCE_ID)
