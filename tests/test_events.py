from tests.data import encounter, frame, port_stay
from wakeline.operators import boundaries as B
from wakeline.operators import events as E
from wakeline.schemas import EVENTS

PORTS = B.BoundaryRegistry(B.BoundaryDataset("ports", "2024.1", (B.Region("Rotterdam", 3.8, 51.8, 4.5, 52.1),)))
EEZ = B.BoundaryRegistry(B.BoundaryDataset("eez", "11.0", (B.Region("NLD_EEZ", 2.5, 51.0, 7.2, 55.8), B.Region("GBR_EEZ", -5.0, 49.0, 2.5, 56.0))))
CROSSING = [(111, 10 * i, 53.0, lon, 10.0) for i, lon in enumerate((5.0, 4.5, 4.0, 3.5, 3.0, 2.0, 1.0, 0.0, -0.5, -1.0))]


def port_calls(spark, rows, **config):
    return E.detect_port_calls(PORTS.label(frame(spark, rows), "ports"), config=E.PortCallConfig(**config))


def test_port_call(spark):
    transit = [(111, t, 51.9, 3.5, 12.0) for t in range(6)] + [(111, t, 51.9, 4.2, 11.0) for t in range(135, 141)]
    (call,) = port_calls(spark, transit + port_stay(111, 10, 130)).collect()
    assert (call.end_time - call.start_time).total_seconds() == 7200 and call.confidence_score == 0.7
    assert call.record_provenance == "derived:port_call_detector/0.1.0[boundaries+positions]"
    assert E.parse_provenance(call.record_provenance).upstream_datasets == ("boundaries", "positions")


def test_port_call_splits(spark):
    assert port_calls(spark, port_stay(111, 0, 120) + port_stay(222, 60, 180)).count() == 2
    assert port_calls(spark, port_stay(111, 0, 120) + port_stay(111, 300, 420)).count() == 2
    assert port_calls(spark, port_stay(111, 0, 20)).count() == 0
    assert port_calls(spark, [(m, t, 10.0, y, s) for m, t, _, y, s in port_stay(111, 0, 120)]).count() == 0


def crossings(spark, rows, **config):
    return E.detect_eez_crossings(EEZ.label(frame(spark, rows), "eez"), config=E.EEZCrossingConfig(**config))


def test_crossing(spark):
    (c,) = crossings(spark, CROSSING).collect()
    assert (c.start_time.minute, c.end_time.minute) == (40, 50) and c.confidence_score == 0.7
    assert (c.lat, c.lon) == (53.0, 2.5)


def test_crossing_back_and_gaps(spark):
    back = [(111, 10 * i, 53.0, lon, 10.0) for i, lon in enumerate((4, 3.5, 3, 1.5, 2, 3, 4))]
    back = [(m, t, a, float(b), s) for m, t, a, b, s in back]
    assert crossings(spark, back, max_distance_m=200_000.0).count() == 2
    assert crossings(spark, [(1, 0, 53.0, 3.0, 1.0), (1, 180, 53.0, 2.0, 1.0)]).count() == 0
    assert crossings(spark, [(1, 0, 10.0, 3.0, 1.0), (1, 10, 53.0, 3.0, 1.0)]).count() == 0


def test_encounters(spark):
    (e,) = E.detect_encounters(frame(spark, encounter(111, 222))).collect()
    assert (e.mmsi, e.other_mmsi, e.confidence_score) == (111, 222, 0.7)
    assert (e.end_time - e.start_time).total_seconds() == 1800
    three = E.detect_encounters(frame(spark, encounter(111, 222, 333))).collect()
    assert {(r.mmsi, r.other_mmsi) for r in three} == {(111, 222), (111, 333), (222, 333)}
    assert E.detect_encounters(frame(spark, encounter(111))).count() == 0
    assert E.detect_encounters(frame(spark, encounter(111, 222, last=0))).count() == 0


def test_encounters_against_all_pairs(spark):
    """Cells lose no pair, wherever bucket and cell borders fall."""
    import math
    import random

    rng = random.Random(3)
    rows = [(m, rng.uniform(0, 60), 10 + rng.uniform(0, 0.02), 20 + rng.uniform(0, 0.02), 1.0) for m in range(1, 7) for _ in range(30)]
    got = {(r.mmsi_a, r.mmsi_b, r.timestamp_a, r.timestamp_b) for r in E.encounter_observations(frame(spark, rows)).collect()}
    held = [(r.mmsi, r.timestamp, r.lat, r.lon) for r in frame(spark, rows).collect()]
    near = lambda a, b: math.hypot((a[2] - b[2]) * 111320, (a[3] - b[3]) * 111320 * math.cos(math.radians((a[2] + b[2]) / 2))) <= 500
    bucket = lambda a: int(a[1].timestamp() // 300)
    assert got == {(a[0], b[0], a[1], b[1]) for a in held for b in held if a[0] < b[0] and near(a, b) and abs(bucket(a) - bucket(b)) <= 1}


def test_loitering(spark):
    stay = [(111, 6 * i, 40 + 1e-4 * i, -74 + 1e-4 * i, 0.5) for i in range(11)]
    (e,) = E.detect_loitering(frame(spark, stay)).collect()
    assert e.confidence_score == 0.7 and e.event_type == "loitering"
    assert E.detect_loitering(frame(spark, [(m, t, a, b, 12.0) for m, t, a, b, _ in stay])).count() == 0
    assert E.detect_loitering(frame(spark, [(111, 2 * i, 40.0, -74.0, 0.5) for i in range(5)])).count() == 0
    assert E.detect_loitering(frame(spark, [(111, 6 * i, 40 + 0.1 * i, -74.0, 0.5) for i in range(11)])).count() == 0


def test_same_ids_and_empty(spark):
    ids = [sorted(r.event_id for r in E.detect_encounters(frame(spark, encounter(111, 222))).collect()) for _ in range(2)]
    assert ids[0] == ids[1]
    for out in (E.detect_encounters(frame(spark, [])), E.detect_loitering(frame(spark, [])), port_calls(spark, []), crossings(spark, [])):
        assert out.count() == 0 and out.columns == EVENTS.columns and not EVENTS.validate(out)


def test_encounters_near_borders_of_cells(spark):
    """All pairs of a dense swarm, at the equator, in the north, near the pole and at 180 degrees, against a plain loop."""
    import math
    import random

    from wakeline.operators import events as E

    rng, rows = random.Random(3), []
    for k, (lat, lon) in enumerate(((0.0, 0.0), (51.9, 4.0), (-70.0, 179.999), (89.5, 10.0))):
        wide = 0.02 / max(0.005, math.cos(math.radians(lat)))
        rows += [(1000 * k + i, 0, lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-wide, wide), 1.0) for i in range(60)]
    config = E.EncounterConfig(max_distance_m=500.0)
    got = {(r.mmsi_a, r.mmsi_b) for r in E.encounter_observations(frame(spark, rows), config).collect()}
    metres = lambda a, b: math.hypot((a[2] - b[2]) * 111_320, (a[3] - b[3]) * 111_320 * math.cos(math.radians((a[2] + b[2]) / 2)))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and metres(a, b) <= 500}
    assert got == want and len(want) > 50
