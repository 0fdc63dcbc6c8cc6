"""Fusing sources: near-duplicates of a vessel's position become one row, with provenance."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.exprs import micros

MODES = ("union", "best", "prefer")
#: Columns whose value always comes from the winning row.
PROTECTED = frozenset("mmsi timestamp lat lon source record_provenance source_file ingest_id".split())


@dataclass(frozen=True)
class FusionConfig:
    mode: str = "union"
    source_precedence: tuple[str, ...] = ()
    prefer_source: str | None = None
    timestamp_tolerance_seconds: float = 30.0
    coordinate_tolerance_degrees: float = 0.01
    field_precedence: dict[str, list[str]] = field(default_factory=dict)
    source_confidence_weights: dict[str, float] = field(default_factory=dict)
    tag_provenance: bool = True

    def validate(self) -> list[str]:
        errors = [] if self.mode in MODES else [f"unknown mode: {self.mode}"]
        if self.mode == "prefer" and not self.prefer_source:
            errors.append("prefer needs a source")
        errors += [f"{k} must be >= 0" for k in ("timestamp_tolerance_seconds", "coordinate_tolerance_degrees") if getattr(self, k) < 0]
        errors += [f"field {f} can't have a precedence of its own" for f in self.field_precedence if f in PROTECTED]
        return errors + [f"weight of {s} must lie in [0, 1]" for s, w in self.source_confidence_weights.items() if not 0 <= w <= 1]


def parse_merge(value: str | FusionConfig) -> FusionConfig:
    """``union``, ``best`` or ``prefer:<source>``."""
    if isinstance(value, FusionConfig):
        return value
    text = value.strip()
    mode, _, source = text.partition(":")
    mode = mode.strip().lower()
    if mode not in MODES or (mode == "prefer") != bool(source.strip()):
        raise ValueError(f"merge is union, best or prefer:<source>, not {value!r}")
    return FusionConfig(mode=mode, prefer_source=source.strip().lower() or None)


def dedup_buckets(df: DataFrame, config: FusionConfig) -> dict[str, Column]:
    us, tolerance = micros(F.col("timestamp")), int(config.timestamp_tolerance_seconds * 1_000_000)
    keys = {"_t": us - F.pmod(us, F.lit(tolerance)) if tolerance else us}
    if config.coordinate_tolerance_degrees > 0:
        keys |= {f"_{c}": F.round(F.col(c) / config.coordinate_tolerance_degrees) for c in ("lat", "lon") if c in df.columns}
    return keys


def precedence(sources: list[str], config: FusionConfig) -> list[str]:
    """The preferred source, then listed ones, then the rest by name."""
    listed = ([config.prefer_source] if config.mode == "prefer" and config.prefer_source else []) + [s for s in config.source_precedence]
    return list(dict.fromkeys([s for s in listed if s in sources] + sorted(sources)))


def _rank(order: list[str], source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return F.coalesce(F.try_element_at(table, source), F.lit(len(order)))


def _weighted(df: DataFrame, config: FusionConfig) -> DataFrame:
    if not config.source_confidence_weights:
        return df
    weight = reduce(lambda acc, x: F.when(F.col("source") == x[0], float(x[1])).otherwise(acc), reversed(config.source_confidence_weights.items()), F.lit(1.0))
    return df.withColumn("confidence_score", weight)


def merge(frames: dict[str, DataFrame], config: FusionConfig | str = "best") -> DataFrame:
    """Positions by source, fused.

    Best and prefer keep, of the rows in a bucket of vessel, time and place, the
    one of the highest source, then the earliest.  One grouping finds winner,
    sources and fields together; nothing is joined back.
    """
    config = parse_merge(config)
    if errors := config.validate():
        raise ValueError("; ".join(errors))
    named = {s: f if "source" in f.columns else f.withColumn("source", F.lit(s)) for s, f in frames.items()}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named.values())
    tag = lambda text: rows.withColumn("record_provenance", text) if config.tag_provenance else rows
    if len(frames) == 1:
        return _weighted(tag(F.concat("source", F.lit(":only"))), config)
    if config.mode == "union":
        return _weighted(tag(F.concat("source", F.lit(":union"))), config)

    order = precedence(list(frames), config)
    keys = dedup_buckets(rows, config)
    columns = rows.columns
    rank = _rank(order, F.col("source"))
    least = F.struct(rank, F.col("timestamp"), *[F.col(c) for c in ("lat", "lon") if c in columns])
    fields = []
    for name, own in config.field_precedence.items():
        if name in columns:
            by = F.struct(_rank(list(dict.fromkeys([*own, *order])), F.col("source")), F.col("timestamp"))
            fields.append(F.min_by(name, F.when(F.col(name).isNotNull(), by)).alias(f"_f_{name}"))
    keyed = rows.withColumns(keys)
    groups = keyed.groupBy("mmsi", *keys).agg(F.min_by(F.struct(*columns), least).alias("_row"), F.array_sort(F.collect_set("source")).alias("_sources"), *fields)
    chosen = {n: F.coalesce(F.col(f"_f_{n}"), F.col(f"_row.{n}")) for n in config.field_precedence if n in columns}
    token = F.concat(F.col("_row.source"), F.lit(":best" if config.mode == "best" else f":prefer:{config.prefer_source}"))
    token = F.when(F.size("_sources") > 1, F.concat(token, F.lit("[+"), F.array_join("_sources", "+"), F.lit("]"))).otherwise(token)
    out = groups.select([chosen.get(c, F.col(f"_row.{c}")).alias(c) for c in columns] + ([token.alias("_token")] if config.tag_provenance else []))
    if config.tag_provenance:
        out = out.withColumn("record_provenance", F.col("_token")).drop("_token")
    return _weighted(out, config)


@dataclass(frozen=True)
class FusionSummary:
    rows_in: int
    rows_out: int
    per_source: dict[str, int]

    @property
    def duplicate_rate(self) -> float:
        return 1 - self.rows_out / self.rows_in if self.rows_in else 0.0


def summarize(frames: dict[str, DataFrame], fused: DataFrame) -> FusionSummary:
    counts = {s: f.count() for s, f in frames.items()}
    return FusionSummary(sum(counts.values()), fused.count(), counts)
