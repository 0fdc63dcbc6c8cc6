"""Sources by id, built in or from plugins."""

from __future__ import annotations

import logging
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession

from wakeline.sources.base import Capabilities, Source

GROUP = "wakeline.sources"
_sources: dict[str, Source] = {}
_streaming: dict[str, Capabilities] = {}
_plugins_loaded = False
log = logging.getLogger(__name__)


def register(source: type[Source] | Source) -> type[Source] | Source:
    made = source() if isinstance(source, type) else source
    _sources[made.SOURCE_ID] = made
    return source


def register_streaming(capabilities: Capabilities) -> None:
    _streaming[capabilities.source] = capabilities


def get(source_id: str) -> Source:
    if source_id not in _sources:
        raise KeyError(f"unknown source {source_id!r}; known: {', '.join(sorted(_sources))}")
    return _sources[source_id]


def registered() -> list[str]:
    return sorted({*_sources, *_streaming})


def capabilities(source_id: str) -> Capabilities:
    if source_id in _sources:
        return _sources[source_id].capabilities
    if source_id in _streaming:
        return _streaming[source_id]
    raise KeyError(f"unknown source {source_id!r}")


def available(source_id: str, day) -> bool | None:
    """Whether a day can be had; None if the source doesn't say."""
    dates = get(source_id).available_dates()
    if dates is None:
        return None
    return dates[0] <= day <= dates[1] if isinstance(dates, tuple) else day in dates


def catalog() -> list[dict[str, str]]:
    return [capabilities(s).summary() for s in registered()]


def compare(*source_ids: str) -> dict[str, dict[str, str]]:
    """For each point of the summaries, its value by source."""
    rows = {s: capabilities(s).summary() for s in source_ids}
    return {k: {s: r[k] for s, r in rows.items()} for k in next(iter(rows.values()), {})}


def find(backfill: bool | None = None, streaming: bool | None = None, auth: bool | None = None, dataset: str | None = None) -> list[str]:
    def fits(c: Capabilities) -> bool:
        return all((backfill in (None, c.backfills), streaming in (None, c.delivery.live), auth in (None, c.access.key), dataset is None or dataset in c.holdings.datasets))

    return [s for s in registered() if fits(capabilities(s))]


def load_plugins(entry_points=metadata.entry_points, again: bool = False) -> list[str]:
    """Register sources of installed packages once; one that fails is logged and left out."""
    global _plugins_loaded
    if _plugins_loaded and not again:
        return []
    _plugins_loaded, found = True, []
    for point in entry_points(group=GROUP):
        try:
            made = point.load()
            register(made)
            found.append(made.SOURCE_ID)
        except Exception:
            log.exception("source plugin %s can't be loaded", point.name)
    return found


def frame(spark: SparkSession) -> DataFrame:
    """The catalog as rows, for SQL."""
    rows = catalog()
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
