"""Manifests: what each partition holds, and which ones a query may see."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.qc import QualityReport
from wakeline.plans.fs import Files
from wakeline.schemas import DATASETS

STAGED, COMMITTED, FAILED = "staged", "committed", "failed"
RAW_POLICIES = ("none", "metadata", "full")


@dataclass(frozen=True)
class Manifest:
    dataset: str
    source: str
    date: str
    schema_version: str
    adapter_version: str
    transform_version: str
    files: list[str]
    record_count: int
    distinct_mmsi_count: int = 0
    min_timestamp: str | None = None
    max_timestamp: str | None = None
    bbox: list[float] | None = None
    rows_ok: int = 0
    rows_warning: int = 0
    rows_error: int = 0
    rows_dropped: int = 0
    checks_applied: list[str] = field(default_factory=list)
    raw_artifacts: list[dict] = field(default_factory=list)
    raw_policy: str = "metadata"
    cache_key: str | None = None
    write_timestamp: str | None = None
    write_status: str = STAGED

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


def statistics(df: DataFrame) -> dict:
    """Counts, time range and box of a partition, in one pass."""
    return _told(df.agg(*_sums(df)).first().asDict())


def statistics_by(df: DataFrame, key: str) -> dict[str, dict]:
    """The statistics of each value of ``key``, of all in one pass."""
    rows = [r.asDict() for r in df.groupBy(F.col(key).cast("string").alias("_key")).agg(*_sums(df)).collect()]
    return {r.pop("_key"): _told(r) for r in rows}


def _sums(df: DataFrame) -> list[Column]:
    time = next((c for c in ("timestamp", "start_time", "last_seen") if c in df.columns), None)
    sums = [F.count("*").alias("record_count")]
    sums.append((F.count_distinct("mmsi") if "mmsi" in df.columns else F.lit(0)).alias("distinct_mmsi_count"))
    if time:
        sums += [F.min(time).cast("string").alias("min_timestamp"), F.max(time).cast("string").alias("max_timestamp")]
    if {"lat", "lon"} <= set(df.columns):
        box = lambda f, c, m: F.greatest(F.least(f(c), F.lit(m)), F.lit(-m))
        sums.append(F.array(box(F.min, "lon", 180.0), box(F.min, "lat", 90.0), box(F.max, "lon", 180.0), box(F.max, "lat", 90.0)).alias("bbox"))
    if "qc_severity" in df.columns:
        sums += [F.count_if(F.col("qc_severity") == s).alias(f"rows_{s}") for s in ("ok", "warning", "error")]
    return sums


def _told(row: dict) -> dict:
    if row.get("bbox") and row["bbox"][0] is None:
        row["bbox"] = None
    return row if "rows_ok" in row else row | {"rows_ok": row["record_count"]}


class Catalog:
    """The manifests of a store, read once and again on ``refresh``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._held: list[Manifest] | None = None

    def refresh(self) -> Catalog:
        self._held = [Manifest.from_json(self.files.read(p)) for p in self.files.walk(self.files.at("manifests"), ".json")]
        return self

    @property
    def manifests(self) -> list[Manifest]:
        if self._held is None:
            self.refresh()
        return self._held

    def partitions(self, dataset: str | None = None, source: str | None = None, date_from: str | None = None, date_to: str | None = None, status: str | None = COMMITTED) -> list[Manifest]:
        fits = lambda m: (
            (status is None or m.write_status == status) and dataset in (None, m.dataset) and source in (None, m.source) and (not date_from or m.date >= date_from) and (not date_to or m.date <= date_to)
        )
        return sorted(filter(fits, self.manifests), key=lambda m: (m.dataset, m.source, m.date))

    def paths(self, dataset: str, sources: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> list[str]:
        own = [m for m in self.partitions(dataset, None, date_from, date_to) if sources is None or m.source in sources]
        return [self.files.at(f) for m in own for f in m.files]

    def scan(self, dataset: str, sources: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """Committed rows; columns that files lack are null, others are left out."""
        spec = DATASETS[dataset]
        paths = self.paths(dataset, sources, date_from, date_to)
        if not paths:
            return self.spark.createDataFrame([], spec.struct)
        return self.spark.read.schema(spec.struct).option("recursiveFileLookup", True).parquet(*paths)

    def frame(self) -> DataFrame:
        """The manifests as rows, for SQL."""
        schema = "dataset string, source string, date string, schema_version string, adapter_version string, transform_version string, record_count long, distinct_mmsi_count long, rows_ok long, rows_warning long, rows_error long, rows_dropped long, write_status string"
        names = [x.split()[0] for x in schema.split(", ")]
        return self.spark.createDataFrame([tuple(getattr(m, n) for n in names) for m in self.manifests], schema)

    # --- reports

    def inventory(self) -> DataFrame:
        """Partitions, rows and vessels (summed over partitions) by dataset and source."""
        own = self.frame().where(F.col("write_status") == COMMITTED)
        return own.groupBy("dataset", "source").agg(
            F.count("*").alias("partitions"), F.sum("record_count").alias("rows"), F.sum("distinct_mmsi_count").alias("vessels"), F.min("date").alias("date_from"), F.max("date").alias("date_to")
        ).orderBy("dataset", "source")

    def quality_report(self, dataset: str, source: str | None = None, date_from: str | None = None, date_to: str | None = None) -> QualityReport:
        own = self.partitions(dataset, source, date_from, date_to)
        total = lambda name: sum(getattr(m, name) for m in own)
        dropped = total("rows_dropped")
        return QualityReport(dataset, len(own), total("record_count") + dropped, total("rows_ok"), total("rows_warning"), total("rows_error"), dropped, source, date_from, date_to, tuple(sorted({c for m in own for c in m.checks_applied})))

    def provenance(self, dataset: str, date_from: str | None = None, date_to: str | None = None) -> dict:
        own = self.partitions(dataset, None, date_from, date_to)
        versions = {k: sorted({getattr(m, k) for m in own}) for k in ("schema_version", "adapter_version", "transform_version")}
        raw = [a for m in own for a in m.raw_artifacts]
        return {
            "dataset": dataset, "partitions": len(own), "sources": sorted({m.source for m in own}), **{f"{k}s": v for k, v in versions.items()},
            "raw_artifacts": len(raw), "has_mixed_versions": any(len(v) > 1 for v in versions.values()),
            "can_rebuild_locally": bool(own) and all(m.raw_artifacts and all(a.get("local_path") for a in m.raw_artifacts) for m in own),
        }

    def check_health(self) -> list[dict[str, str]]:
        """Partitions that were never committed or failed, versions that are unknown or mixed."""
        known = {s.version for s in DATASETS.values()}
        found = [{"level": "error" if m.write_status == FAILED else "warning", "partition": f"{m.dataset}/{m.source}/{m.date}", "problem": f"{m.write_status} partition"} for m in self.manifests if m.write_status != COMMITTED]
        found += [{"level": "error", "partition": f"{m.dataset}/{m.source}/{m.date}", "problem": f"unknown schema version {m.schema_version}"} for m in self.partitions() if m.schema_version not in known]
        for dataset in sorted({m.dataset for m in self.partitions()}):
            if self.provenance(dataset)["has_mixed_versions"]:
                found.append({"level": "warning", "partition": dataset, "problem": "mixed versions"})
        return found
