"""Global Fishing Watch: events, vessel identities and fishing effort from its API's JSON."""

from __future__ import annotations

import json
from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.schemas import EVENTS, FISHING_EFFORT, VESSELS
from wakeline.sources.base import Access, Capabilities, Delivery, FetchSpec, Holdings, RawArtifact, Source, download
from wakeline.sources.registry import register

# Fixed names of the API's kinds of event.
KINDS = {"FISHING": "fishing", "ENCOUNTER": "encounter", "PORT_VISIT": "port_call", "LOITERING": "loitering"}
# Fixed address, datasets and page size of the API.
API, PAGE = "https://gateway.api.globalfishingwatch.org/v3", 1_000
EVENT_DATASETS = ("fishing", "encounters", "port-visits", "loitering")
_VESSEL = "id string, ssvid string, name string, flag string, type string"
EVENT_JSON = f"id string, type string, start string, end string, position struct<lat:double,lon:double>, vessel struct<{_VESSEL.replace(' string', ':string').replace(', ', ',')}>, encounter struct<vessel:struct<ssvid:string>>"
EFFORT_JSON = "date string, flag string, geartype string, hours double, lat double, lon double"


def _time(name: str):
    text = F.col(name)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def read_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """A row an item, with file and place in it; documents are lists, single items, or pages with their items under entries."""
    raw = spark.read.option("wholetext", True).text(paths)
    kind = "array<struct<" + ",".join(_ddl(schema)) + ">>"
    one = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    body = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.coalesce(F.get_json_object("value", "$.entries"), one))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json(body, kind)).alias("at", "item")).select("file", "at", "item.*")


def _ddl(schema: str) -> list[str]:
    out, depth, item = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out, item = [*out, item], ""
        else:
            item += c
    return [f"`{x.strip().split(' ', 1)[0]}`:{x.strip().split(' ', 1)[1]}" for x in [*out, item]]


def events(raw: DataFrame) -> DataFrame:
    """Items of unknown kind, without vessel number, or without begin or end are left out."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    out = raw.select(
        F.coalesce("id", F.lit("")).alias("event_id"), F.try_element_at(kind, F.upper("type")).alias("event_type"), F.col("vessel.ssvid").try_cast("long").alias("mmsi"),
        F.col("encounter.vessel.ssvid").try_cast("long").alias("other_mmsi"), _time("start").alias("start_time"), _time("end").alias("end_time"), "position.lat", "position.lon",
        F.lit(1.0).alias("confidence_score"), F.lit("gfw").alias("source"), F.lit("gfw:events_api").alias("record_provenance"),
    )
    return EVENTS.conform(out.where("event_type IS NOT NULL AND mmsi IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL"))


def vessels(raw: DataFrame) -> DataFrame:
    """The first item of each vessel; when it was seen isn't known here."""
    rows = raw.select(F.col("vessel.ssvid").try_cast("long").alias("mmsi"), F.col("vessel.name").alias("vessel_name"), "vessel.flag", F.col("vessel.type").alias("ship_type"), "file", "at").where("mmsi IS NOT NULL")
    first = rows.groupBy("mmsi").agg(F.min_by(F.struct("vessel_name", "flag", "ship_type"), F.struct("file", "at")).alias("v")).select("mmsi", "v.*")
    return VESSELS.conform(first.withColumn("source", F.lit("gfw")).withColumn("record_provenance", F.lit("gfw:events_api")))


def fishing_effort(raw: DataFrame) -> DataFrame:
    out = raw.select(F.col("date").try_cast("date").alias("date"), "lat", "lon", "flag", "geartype", F.col("hours").alias("vessel_hours"), F.lit("gfw").alias("source"), F.lit("gfw:fourwings_api").alias("record_provenance"))
    return FISHING_EFFORT.conform(out.where("date IS NOT NULL AND vessel_hours IS NOT NULL"))


@register
class GFW(Source):
    SOURCE_ID = "gfw"
    capabilities = Capabilities(
        "gfw", "Global Fishing Watch", Access(True, "100 requests a minute", "non-commercial, with attribution"), Delivery("JSON", "3 days", archive_from=date(2020, 1, 1), by_box=True),
        Holdings("all seas", ("events", "vessels", "fishing_effort"), (10_000, 100_000), ("no raw positions",)),
    )

    def available_dates(self):
        return self.capabilities.delivery.archive_from, date.today() - timedelta(days=3)

    def fetch_raw(self, spec: FetchSpec) -> list[RawArtifact]:
        """Pages of each kind of event, and the day's effort by cells, as files of the API's own JSON."""
        headers = {"Authorization": f"Bearer {self.key_of(spec)}", "Content-Type": "application/json"}
        more, first, last, found = spec.options.get("transport", {}), spec.day.isoformat(), (spec.day + timedelta(days=1)).isoformat(), []
        for kind in EVENT_DATASETS:
            offset = 0
            while offset is not None:
                query = urlencode({"datasets[0]": f"public-global-{kind}-events:latest", "start-date": first, "end-date": last, "limit": PAGE, "offset": offset})
                found.append(download(f"{API}/events?{query}", f"{spec.raw_dir}/gfw_events_{kind}_{first}_{offset}.json", headers=headers, **more))
                with open(found[-1].local_path, encoding="utf-8") as f:
                    offset = json.load(f).get("nextOffset")
        west, south, east, north = spec.options.get("bbox", (-180.0, -90.0, 180.0, 90.0))
        ring = [[west, south], [east, south], [east, north], [west, north], [west, south]]
        query = urlencode({"datasets[0]": "public-global-fishing-effort:latest", "spatial-resolution": "LOW", "temporal-resolution": "DAILY", "group-by": "GEARTYPE", "date-range": f"{first},{last}", "format": "JSON"})
        body = json.dumps({"geojson": {"type": "Polygon", "coordinates": [ring]}}).encode()
        return [*found, download(f"{API}/4wings/report?{query}", f"{spec.raw_dir}/gfw_effort_{first}.json", headers=headers, body=body, **more)]

    def normalize_positions(self, spark: SparkSession, paths: list[str], day: date | None = None) -> DataFrame:
        raise NotImplementedError("this source has no positions")

    def normalize_events(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return events(read_json(spark, [p for p in paths if "events" in p.rsplit("/", 1)[-1]], EVENT_JSON))

    def normalize_event_vessels(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return vessels(read_json(spark, [p for p in paths if "events" in p.rsplit("/", 1)[-1]], EVENT_JSON))

    def normalize_fishing_effort(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return fishing_effort(read_json(spark, [p for p in paths if "effort" in p.rsplit("/", 1)[-1]], EFFORT_JSON))
