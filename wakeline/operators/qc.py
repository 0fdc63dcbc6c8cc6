"""Quality checks as column expressions, their flags, severities and counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.exprs import KNOT, distance_m, seconds_between
from wakeline.operators.islands import number_runs

HARD_INVALID, SUSPICIOUS = "hard_invalid", "suspicious"


@dataclass(frozen=True)
class Check:
    """``ok`` gives a condition on a row, of which null counts as passed; checks of sequences read ``_p``, the row before, and ``_run``."""

    name: str
    kind: str
    ok: Callable[[], Column]
    columns: tuple[str, ...] = ()
    sequence: bool = False

    @property
    def severity(self) -> str:
        return "error" if self.kind == HARD_INVALID else "warning"


def range_check(column: str, low: float, high: float, kind: str) -> Check:
    return Check(f"{column}_range", kind, lambda: F.col(column).between(low, high), (column,))


def not_null(column: str) -> Check:
    return Check(f"{column}_not_null", HARD_INVALID, lambda: F.col(column).isNotNull(), (column,))


def _speed(limit: float = 50.0) -> Column:
    moved = distance_m(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon"), F.col("lat"))
    seconds = seconds_between(F.col("timestamp"), F.col("_p.timestamp"))
    return F.when(seconds > 0, F.try_divide(moved, seconds) <= limit * KNOT)


BUILTIN = (
    range_check("lat", -90.0, 90.0, HARD_INVALID),
    range_check("lon", -180.0, 180.0, HARD_INVALID),
    range_check("sog", 0.0, 102.3, SUSPICIOUS),
    range_check("cog", 0.0, 360.0, SUSPICIOUS),
    range_check("heading", 0.0, 360.0, SUSPICIOUS),
    *(not_null(c) for c in ("mmsi", "timestamp", "lat", "lon", "source")),
    Check("mmsi_format", HARD_INVALID, lambda: F.col("mmsi").between(100_000_000, 999_999_999), ("mmsi",)),
    Check("implied_speed", SUSPICIOUS, _speed, ("mmsi", "timestamp", "lat", "lon"), True),
    Check("stale_position", SUSPICIOUS, lambda: F.col("_run") <= 100, ("mmsi", "timestamp", "lat", "lon"), True),
    Check("timestamp_order", SUSPICIOUS, lambda: F.col("timestamp") >= F.col("_arrived"), ("mmsi", "timestamp"), True),
)


def run_checks(positions: DataFrame, checks: tuple[Check, ...] = BUILTIN, mode: str = "declared", arrival: str | None = None, drop_invalid: bool = False) -> DataFrame:
    """Fill qc_flags, qc_severity and confidence_score.

    ``mode`` off stamps every row ok.  ``arrival`` names the column that orders
    rows as they came in; without it the check of time order is left out.  The
    score is 1, less 0.2 for each suspicious flag, and 0 for invalid rows; that
    formula is this library's own.  Checks of columns that are missing are
    left out.  Checks of sequences pass rows without a vessel, which others flag.
    """
    if mode == "off":
        return positions.withColumn("qc_flags", F.array().cast("array<string>")).withColumn("qc_severity", F.lit("ok"))
    use = [c for c in checks if set(c.columns) <= set(positions.columns) and (c.name != "timestamp_order" or arrival)]
    rows, extra = positions, []
    if any(c.sequence for c in use):
        order = [c for c in ("timestamp", "lat", "lon") if c in positions.columns]
        # rows without a vessel have no sequence; by themselves they don't meet in one task
        rows = rows.withColumn("_alone", F.when(F.col("mmsi").isNull(), F.xxhash64(*order, F.rand(7))))
        vessel = ["mmsi", "_alone"]
        line = Window.partitionBy(*vessel).orderBy(*order)
        rows = rows.withColumn("_p", F.lag(F.struct("timestamp", "lat", "lon")).over(line))
        moved = lambda p: ~(F.col("lat").eqNullSafe(p["lat"]) & F.col("lon").eqNullSafe(p["lon"]))
        rows = number_runs(rows, vessel, order, moved, ["lat", "lon"], "_stay")
        rows = rows.withColumn("_run", F.row_number().over(Window.partitionBy(*vessel, "_stay").orderBy(*order)))
        extra = ["_p", "_stay", "_run", "_alone"]
        if arrival:
            rows = rows.withColumn("_arrived", F.lag("timestamp").over(Window.partitionBy(*vessel).orderBy(arrival)))
            extra.append("_arrived")
    failed = lambda c: ~F.coalesce(c.ok(), F.lit(True))
    kinds = {k: [c for c in use if c.kind == k] for k in (HARD_INVALID, SUSPICIOUS)}
    some = lambda cs: F.greatest(*[failed(c).cast("int") for c in cs], F.lit(0), F.lit(0)) == 1
    suspicious = sum((failed(c).cast("int") for c in kinds[SUSPICIOUS]), F.lit(0))
    flags = F.array_compact(F.array(*[F.when(failed(c), F.lit(c.name)) for c in use])) if use else F.array().cast("array<string>")
    rows = rows.withColumns({
        "qc_flags": flags,
        "qc_severity": F.when(some(kinds[HARD_INVALID]), "error").when(some(kinds[SUSPICIOUS]), "warning").otherwise("ok"),
        "confidence_score": F.when(some(kinds[HARD_INVALID]), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.2 * suspicious)),
    }).drop(*extra)
    return rows.where(F.col("qc_severity") != "error") if drop_invalid else rows


@dataclass(frozen=True)
class CheckResult:
    check_name: str
    rows_checked: int
    rows_flagged: int
    severity: str


@dataclass(frozen=True)
class QualityReport:
    dataset: str
    partitions_scanned: int = 0
    total_rows: int = 0
    rows_ok: int = 0
    rows_warning: int = 0
    rows_error: int = 0
    rows_dropped: int = 0
    source: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    checks_applied: tuple[str, ...] = ()
    check_results: tuple[CheckResult, ...] = field(default=())

    @property
    def rows_written(self) -> int:
        return self.total_rows - self.rows_dropped

    def _rate(self, n: int, of: int) -> float:
        return n / of if of > 0 else 0.0

    @property
    def ok_rate(self) -> float:
        return self._rate(self.rows_ok, self.rows_written)

    @property
    def warning_rate(self) -> float:
        return self._rate(self.rows_warning, self.rows_written)

    @property
    def error_rate(self) -> float:
        return self._rate(self.rows_error, self.rows_written)

    @property
    def drop_rate(self) -> float:
        return self._rate(self.rows_dropped, self.total_rows)


def check_counts(checked: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """check_name, severity, rows_checked, rows_flagged: one pass over the flags."""
    names = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity")) for c in checks])
    totals = checked.agg(F.count("*").alias("rows_checked"), *[F.count_if(F.array_contains("qc_flags", c.name)).alias(f"c{i}") for i, c in enumerate(checks)])
    flagged = F.array(*[f"c{i}" for i in range(len(checks))])
    return totals.select("rows_checked", F.explode(F.arrays_zip(names.alias("check"), flagged.alias("rows_flagged"))).alias("x")).select("x.check.*", "rows_checked", "x.rows_flagged")
