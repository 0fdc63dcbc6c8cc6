"""Times of headline queries, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from wakeline import queries as own  # noqa: E402

HEADLINES = (
    "filter_mmsi", "filter_bbox", "vessel_stats", "latest_positions", "snapshot", "top_speeds", "build_tracks", "port_calls", "eez_crossings", "encounters", "loitering",
    "density_grid", "fusion_union", "fusion_best", "qc_flags",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: own.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINES:
        run(name)  # compiles code and fills the page cache
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
