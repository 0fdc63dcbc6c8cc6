"""Sinks of micro-batches, and the promotion of what has landed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.plans.catalog import Catalog, Manifest
from wakeline.plans.fs import Files
from wakeline.plans.store import write_partitions
from wakeline.schemas import POSITIONS
from wakeline.streaming.dedup import KEY, compact

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
TRANSFORM = "promotion/landing-to-canonical/1.0.0"


class ParquetSink:
    """Appends compacted batches to a landing folder, a subfolder a batch, so that a batch that is run again replaces itself."""

    def __init__(self, landing: str, compacted: bool = True):
        self.landing, self.compacted = landing.rstrip("/"), compacted

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = compact(batch) if self.compacted else batch
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.landing}/batch={batch_id:012d}")


class TableSink:
    """Batches in a table of the catalog, a partition a batch, so that one that is run again replaces itself; a first batch makes the table."""

    def __init__(self, table: str):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", table):
            raise ValueError(f"no table name: {table!r}")
        self.table = table

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if not spark.catalog.tableExists(self.table):
            rows.limit(0).write.format("parquet").partitionBy("batch_id").saveAsTable(self.table)
        mode, key = spark.conf.get(OVERWRITE), spark.table(self.table).columns
        spark.conf.set(OVERWRITE, "dynamic")
        try:
            rows.select(*key).write.mode("overwrite").insertInto(self.table)
        finally:
            spark.conf.set(OVERWRITE, mode)


def run_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval_s: float = 10.0):
    """Start a query that hands micro-batches to ``sink``; ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_s} seconds")).start()


def promote_landing(spark: SparkSession, root: str, landing: str, source: str, cleanup: bool = False) -> list[Manifest]:
    """Landed positions into the store's partitions, by day.

    Rows that a partition holds already stay in it; one row is kept of those
    with equal vessel, time and place.  All days are written by one job, so
    what has landed is read a fixed number of times.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(landing)
    rows = rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp")).where("timestamp IS NOT NULL")
    stamped = rows.withColumns({"source": F.lit(source), "source_file": F.lit(landing), "ingest_id": F.lit(uuid.uuid4().hex), "qc_severity": F.lit("ok"), "record_provenance": F.lit(f"{source}:stream")})
    landed, catalog = POSITIONS.conform(stamped).withColumn("_day", F.to_date("timestamp").cast("string")), Catalog(spark, root)
    days = {r[0] for r in landed.select("_day").distinct().collect()}
    held = [catalog.files.at(f) for m in catalog.partitions("positions", source) if m.date in days for f in m.files]
    if held:
        # a stored row stays in its partition, whatever its time
        stored = spark.read.schema(POSITIONS.struct).option("recursiveFileLookup", True).parquet(*held)
        day = F.regexp_extract("_metadata.file_path", r".*/date=([^/]+)/", 1)
        landed = stored.select("*", day.alias("_day")).unionByName(landed)
    made = write_partitions(landed.dropDuplicates(["_day", *KEY]), root, "positions", source, "_day", transform_version=TRANSFORM) if days else []
    if cleanup:
        files = Files(spark, landing)
        files.delete(files.root)
    return made


def loitering_sessions(stream: DataFrame, max_speed_knots: float = 2.0, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Slow runs of each vessel as session windows of a stream, closed by the watermark."""
    slow = stream.withWatermark("timestamp", delay).where(F.col("sog") <= max_speed_knots)
    runs = slow.groupBy("mmsi", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("points"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return runs.select("mmsi", "start_time", "end_time", "points", "lat", "lon")
