"""``python -m wakeline.cli``: the store from a shell."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wakeline", description=__doc__)
    top.add_argument("--root", default="wakeline-store")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, scoped: bool = True):
        p = sub.add_parser(name)
        if scoped:
            p.add_argument("--start", required=True)
            p.add_argument("--end")
            p.add_argument("--source", action="append")
            p.add_argument("--merge", default="union")
        for flags, more in options:
            p.add_argument(*flags, **more)

    add("download")
    add("inventory", scoped=False)
    add("qc", (("--dataset",), {"default": "positions"}))
    add("sql", (("query",), {}), (("--limit",), {"type": int, "default": 20}))
    add("health", scoped=False)
    add("sources", (("--streaming",), {"action": "store_true"}), (("--backfill",), {"action": "store_true"}), (("--compare",), {"nargs": "+"}), scoped=False)
    add("fusion")
    add("events", (("--type",), {"dest": "kind"}), (("--min-confidence",), {"type": float}), (("--limit",), {"type": int, "default": 20}))
    add("provenance", (("--dataset",), {"default": "positions"}))
    add("promote", (("landing",), {}), (("--source",), {"required": True}), (("--cleanup",), {"action": "store_true"}), scoped=False)
    return top


def main(args: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(args)
    if a.command == "sources":
        import wakeline.sources  # noqa: F401
        from wakeline.sources import registry

        shown = registry.compare(*a.compare) if a.compare else [registry.capabilities(s).summary() for s in registry.find(a.backfill or None, a.streaming or None)]
        print(json.dumps(shown, indent=1))
        return 0

    from wakeline.plans.api import Fleet
    from wakeline.plans.catalog import Catalog
    from wakeline.session import session

    spark = spark or session("wakeline-cli")
    if a.command in ("inventory", "health"):
        catalog = Catalog(spark, a.root)
        if a.command == "inventory":
            catalog.inventory().show(1000, False)
            return 0
        found = catalog.check_health()
        print(json.dumps(found, indent=1))
        return int(any(f["level"] == "error" for f in found))
    if a.command == "promote":
        from wakeline.streaming.sinks import promote_landing

        for m in promote_landing(spark, a.root, a.landing, a.source, a.cleanup):
            print(m.source, m.date, m.record_count)
        return 0
    fleet = Fleet(spark, a.root, (a.start, a.end or a.start), a.source or ["noaa"], a.merge)
    if a.command == "download":
        for m in fleet.download():
            print(m.dataset, m.source, m.date, m.record_count)
    elif a.command == "qc":
        report = fleet.quality_report(a.dataset)
        print(json.dumps(asdict(report) | {"ok_rate": report.ok_rate, "warning_rate": report.warning_rate, "error_rate": report.error_rate, "drop_rate": report.drop_rate}, indent=1))
    elif a.command == "sql":
        fleet.sql(a.query).show(a.limit, False)
    elif a.command == "fusion":
        fleet.fusion_info().show(1000, False)
    elif a.command == "events":
        fleet.events(a.kind, a.min_confidence).show(a.limit, False)
    elif a.command == "provenance":
        print(json.dumps(fleet.provenance(a.dataset), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
