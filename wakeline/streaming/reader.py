"""Streams of messages: landed files, and a data source for live connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from wakeline.sources import aisstream, finland
from wakeline.streaming.stats import StreamConfig

CONNECTORS = ("aisstream", "finland")


def read_landed(spark: SparkSession, path: str, config: StreamConfig, files_per_trigger: int = 100) -> DataFrame:
    """Positions of JSON lines that a connector lands in a folder; ``files_per_trigger`` is the backpressure."""
    if config.source not in CONNECTORS:
        raise ValueError(f"no connector {config.source!r}; there are {', '.join(CONNECTORS)}")
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    if config.source == "aisstream":
        out = aisstream.normalize(raw)
        if config.bbox:
            west, south, east, north = config.bbox
            out = out.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    else:
        m = raw.select(F.from_json("value", "topic string, payload string").alias("m")).select("m.topic", F.col("m.payload").alias("value"))
        out = finland.locations(m, bbox=config.bbox)
    return out.where(F.col("mmsi").isin(list(config.mmsi))) if config.mmsi else out


class MessageSource(DataSource):
    """``spark.readStream.format("wakeline_messages")``: rows of a connector that ``connect`` names.

    The option ``connector`` is ``module:function``; called with the options and
    an offset, it returns (list of JSON texts, next offset).  WebSocket and MQTT
    clients plug in there; they aren't part of this library.
    """

    @classmethod
    def name(cls) -> str:
        return "wakeline_messages"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        import importlib

        module, _, function = options["connector"].partition(":")
        self.options, self.poll = options, getattr(importlib.import_module(module), function)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        texts, n = self.poll(self.options, start["n"])
        return iter([(t,) for t in texts]), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        texts, _ = self.poll(self.options, start["n"])
        return iter([(t,) for t in texts[: end["n"] - start["n"]]])

    def commit(self, end: dict) -> None:
        pass
