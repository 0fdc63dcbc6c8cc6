"""Counters, health and the monitoring file of a stream."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

HEALTHY, LAGGING, STALE, STOPPED = "healthy", "lagging", "stale", "stopped"


@dataclass(frozen=True)
class StreamConfig:
    source: str = "aisstream"
    dedup_window: int = 10_000
    max_queue: int = 10_000
    backpressure: str = "block"
    reconnect_delay_s: float = 5.0
    max_reconnect_delay_s: float = 60.0
    lag_threshold_s: float = 30.0
    stale_threshold_s: float = 120.0
    flush_interval_s: float = 10.0
    batch_size: int = 100
    mmsi: tuple[int, ...] = ()
    bbox: tuple[float, float, float, float] | None = None

    def validate(self) -> list[str]:
        positive = ("dedup_window", "max_queue", "reconnect_delay_s", "lag_threshold_s", "stale_threshold_s", "batch_size", "flush_interval_s")
        errors = [f"{k} must be > 0" for k in positive if getattr(self, k) <= 0]
        if self.backpressure not in ("block", "drop_oldest"):
            errors.append("backpressure is block or drop_oldest")
        if self.max_reconnect_delay_s < self.reconnect_delay_s:
            errors.append("max_reconnect_delay_s must not be below reconnect_delay_s")
        if self.stale_threshold_s <= self.lag_threshold_s:
            errors.append("stale_threshold_s must be above lag_threshold_s")
        return errors


@dataclass
class StreamStats:
    """Received = delivered + deduplicated + dropped + waiting."""

    received: int = 0
    delivered: int = 0
    deduplicated: int = 0
    dropped: int = 0
    backpressure_events: int = 0
    reconnections: int = 0
    errors: int = 0

    @property
    def dedup_rate(self) -> float:
        return self.deduplicated / self.received if self.received else 0.0


@dataclass
class Health:
    config: StreamConfig
    stats: StreamStats = field(default_factory=StreamStats)
    clock: object = time.monotonic
    running: bool = True

    def __post_init__(self):
        self.started = self.last = self.clock()

    def message(self) -> None:
        self.last = self.clock()

    def snapshot(self) -> dict:
        """State and lag from one look at the clock."""
        lag = self.clock() - self.last
        state = STOPPED if not self.running else STALE if lag >= self.config.stale_threshold_s else LAGGING if lag >= self.config.lag_threshold_s else HEALTHY
        return {"source": self.config.source, "state": state, "lag_seconds": lag, **asdict(self.stats), "dedup_rate": self.stats.dedup_rate}


def reconnect_delays(config: StreamConfig):
    """Seconds to wait before each try: doubled up to the most."""
    delay = config.reconnect_delay_s
    while True:
        yield delay
        delay = min(delay * 2, config.max_reconnect_delay_s)


def save_checkpoint(path: str, source: str, last_timestamp: str | None, messages_total: int, session_count: int) -> None:
    """For monitoring; a query resumes from its own checkpoint folder."""
    with open(f"{path}.partial", "w") as f:
        json.dump({"source": source, "last_timestamp": last_timestamp, "messages_total": messages_total, "session_count": session_count, "last_saved": datetime.now(UTC).isoformat()}, f)
    os.replace(f"{path}.partial", path)


def load_checkpoint(path: str) -> dict | None:
    """None where there is none, or none that can be read."""
    try:
        with open(path) as f:
            found = json.load(f)
        return found if isinstance(found, dict) else None
    except (OSError, ValueError):
        return None
