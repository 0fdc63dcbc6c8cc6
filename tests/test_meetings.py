import math
import random

import pyarrow as pa

from tests.data import encounter, frame, ts
from wakeline.operators import events as E
from wakeline.operators import meetings as M

CONFIG = E.EncounterConfig()
NEAR = M.Nearness(500.0, 111_320.0, E._reach(CONFIG), E.CELL)


def crowd(seed, vessels=9, fixes=25):
    """Rows of a few places and whole minutes, so that vessels hold several rows of one time."""
    rng = random.Random(seed)
    return [(m, 5 * rng.randrange(8), 10 + rng.randrange(12) * 0.001, 20 + rng.randrange(12) * 0.001, 1.0) for m in range(1, vessels + 1) for _ in range(fixes)]


def by_loop(rows, of=lambda a, b: True):
    """The first by position of near rows of two vessels and times."""
    near = lambda a, b: math.hypot((a[2] - b[2]) * 111_320, (a[3] - b[3]) * 111_320 * math.cos(math.radians((a[2] + b[2]) / 2))) <= 500
    found = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and of(a[0], b[0]) and abs(a[1] // 5 - b[1] // 5) <= 1 and near(a, b):
                found.setdefault((a[0], b[0], a[1], b[1]), []).append((a[2], a[3], b[2], b[3]))
    return {k: min(v) for k, v in found.items()}


def test_pairs_are_not_shuffled(spark):
    plan = E.detect_encounters(frame(spark, encounter(111, 222)))._jdf.queryExecution().executedPlan().toString()
    above, met, _ = plan.partition("MapInArrow")
    assert met and "Exchange" not in above and "Sort" not in above


def test_many_groups_meet_as_one(spark, monkeypatch):
    """Groups and blocks lose no pair and give none twice, with rows that share vessel and time."""
    rows = crowd(1)
    seen = lambda: [((r.mmsi_a, r.mmsi_b, r.timestamp_a, r.timestamp_b), (r.lat_a, r.lon_a, r.lat_b, r.lon_b)) for r in E.encounter_observations(frame(spark, rows)).collect()]
    want = {(a, b, ts(s).replace(tzinfo=None), ts(t).replace(tzinfo=None)): v for (a, b, s, t), v in by_loop(rows).items()}
    whole = seen()
    assert len(whole) == len(want) and dict(whole) == want
    events = lambda: sorted(tuple(r) for r in E.detect_encounters(frame(spark, rows)).select("event_id", "mmsi", "other_mmsi", "start_time", "end_time", "source").collect())
    met = events()
    monkeypatch.setattr(E, "GROUP_ROWS", 20)
    assert E._vessel_groups(frame(spark, rows).withColumn("bucket", E.F.lit(0)), E._reach(CONFIG)).select("own").distinct().count() > 2
    parts = seen()
    assert len(parts) == len(want) and dict(parts) == want and events() == met and met


def test_small_lots(monkeypatch):
    """Lots smaller than one vessel's candidates and tables that end within batches give the same pairs."""
    group = {m: m % 3 for m in range(1, 10)}
    rows = crowd(2)
    dealt = []
    for first in range(3):
        for second in range(first, 3):
            dealt += sorted((first, second, group[m], m, t * 60_000_000, lat, lon, t // 5) for m, t, lat, lon, _ in rows if group[m] in (first, second))
    names = ("first", "second", "own", "mmsi", "at", "lat", "lon", "bucket")
    table = pa.table({n: [r[i] for r in dealt] for i, n in enumerate(names)} | {"source": ["x"] * len(dealt)})
    columns = [c.split()[0] for c in M.OBSERVATIONS.split(", ")]
    want = {(a, b, s * 60_000_000, t * 60_000_000): v for (a, b, s, t), v in by_loop(rows).items()}
    for lot, gather, size in ((2_000_000, 200_000, 10_000), (100, 10, 7), (1, 1, 1000)):
        monkeypatch.setattr(M, "LOT", lot)
        monkeypatch.setattr(M, "GATHER", gather)
        out = [r for b in M.meet(NEAR, None, columns)(iter(table.to_batches(size))) for r in b.to_pylist()]
        got = {(r["mmsi_a"], r["mmsi_b"], r["at_a"], r["at_b"]): (r["lat_a"], r["lon_a"], r["lat_b"], r["lon_b"]) for r in out}
        assert len(out) == len(got) and got == want
