"""AISHub: JSON snapshots in any of the shapes that its service sends."""

from __future__ import annotations

from datetime import date
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.exprs import blank_to_null, nav_status
from wakeline.sources.base import Access, Capabilities, Delivery, FetchSpec, Holdings, RawArtifact, Source, download, stamped, unless
from wakeline.sources.registry import register


def records(document: Column) -> Column:
    """The records of a JSON document, as maps: a list, [meta, [records]], or an object with data or entries."""
    second = F.get_json_object(document, "$[1]")
    body = F.coalesce(F.get_json_object(document, "$.data"), F.get_json_object(document, "$.entries"), F.when(F.ltrim(second).startswith("["), second), document)
    return F.from_json(body, "array<map<string,string>>")


def normalize(raw: DataFrame) -> DataFrame:
    """Rows of source_file and r, a map of strings, to positions."""
    text = lambda k: F.try_element_at("r", F.lit(k))
    num = lambda k: text(k).try_cast("double")
    stamp = F.regexp_replace(text("TIME"), " GMT$", "")
    return raw.select(
        "source_file", text("MMSI").try_cast("long").alias("mmsi"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        num("LATITUDE").alias("lat"), num("LONGITUDE").alias("lon"), num("SOG").alias("sog"), num("COG").alias("cog"), unless(num("HEADING"), 511.0).alias("heading"),
        blank_to_null(text("NAME")).alias("vessel_name"), unless(F.trim(text("IMO")), "0", "", "Unknown").alias("imo"), blank_to_null(text("CALLSIGN")).alias("callsign"),
        blank_to_null(text("TYPE")).alias("ship_type"), num("DRAUGHT").alias("draught"), blank_to_null(text("DEST")).alias("destination"), nav_status(text("NAVSTAT")).alias("nav_status"),
        (num("A") + num("B")).alias("length"), (num("C") + num("D")).alias("beam"),
    )


@register
class AISHub(Source):
    SOURCE_ID = "aishub"
    capabilities = Capabilities(
        "aishub", "AISHub", Access(True, "one request a minute", "members share a receiver of their own"), Delivery("JSON", "under a minute", by_box=True, since=True),
        Holdings("where members' receivers stand", ("positions", "vessels"), (50_000, 500_000), ("heading 511 is unknown", "IMO 0 or empty is unknown", "sizes are distances from the antenna")),
    )

    def url(self, key: str) -> str:
        return f"https://data.aishub.net/ws.php?username={key}&format=1&output=json&compress=0"

    def fetch_raw(self, spec: FetchSpec) -> list[RawArtifact]:
        """A snapshot of now, kept under the day; the key isn't noted."""
        return [download(self.url(quote(self.key_of(spec))), f"{spec.raw_dir}/aishub-{spec.day:%Y-%m-%d}.json", noted=self.url("-"), **spec.options.get("transport", {}))]

    def normalize_positions(self, spark: SparkSession, paths: list[str], day: date | None = None) -> DataFrame:
        raw = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_name").alias("source_file"), F.explode(records(F.col("value"))).alias("r"))
        return stamped(normalize(raw), self.SOURCE_ID)
