import json
import zipfile
from datetime import UTC, date, datetime

import pytest

import wakeline.sources as _  # noqa: F401
from wakeline.schemas import EVENTS, FISHING_EFFORT, POSITIONS, VESSELS
from wakeline.sources import aishub, aisstream, base, finland, registry

NOAA = """MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft
123456789,2024-06-15T00:00:00,40.0,-74.0,10.0,90.0,511.0,SHIP A,IMO1234567,CALL1,70,0,100,20,5.5
123456789,2024-06-15T00:05:00,40.1,-74.1,11.0,91.0,92.0,SHIP A,IMO1234567,CALL1,70,5,100,20,5.5
987654321,bad,41.0,-75.0,x,90.0,90.0,,IMO0000000,,80,12,,,
"""
DMA = """# Timestamp;Type of mobile;MMSI;Latitude;Longitude;Navigational status;ROT;SOG;COG;Heading;IMO;Callsign;Name;Ship type;Width;Length;Draught;Destination
15/06/2024 00:00:00;Class A;219000001;55.5;12.5;Under way;0;10.1;90;511;9999999;OXAB;FERRY;Passenger;20;150;5.5;CPH
16/06/2024 00:00:00;Class A;219000002;55.6;12.6;Moored;0;0.0;0;90;0;OXAC;TUG;Tug;8;30
"""


def zipped(path, text, name="a.csv"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, text)
    return str(path)


@pytest.mark.parametrize("packed", [True, False])
def test_noaa(spark, tmp_path, packed):
    path = zipped(tmp_path / "n.zip", NOAA) if packed else str(tmp_path / "n.csv")
    if not packed:
        (tmp_path / "n.csv").write_text(NOAA)
    out = registry.get("noaa").normalize_positions(spark, [path])
    assert not POSITIONS.validate(out)
    rows = {(r.mmsi, r.sog): r for r in out.collect()}
    first, last = rows[(123456789, 10.0)], rows[(987654321, None)]
    assert first.heading is None and first.nav_status == "Under way using engine" and first.timestamp.replace(tzinfo=None) is not None
    assert rows[(123456789, 11.0)].heading == 92.0 and rows[(123456789, 11.0)].nav_status == "Moored"
    assert last.timestamp is None and last.imo is None and last.nav_status is None and last.vessel_name is None
    vessels = registry.get("noaa").normalize_vessels(out)
    assert {r.mmsi: r.vessel_name for r in vessels.collect()} == {123456789: "SHIP A", 987654321: None} and not VESSELS.validate(vessels)


@pytest.mark.parametrize("mark", [";", ","])
def test_dma(spark, tmp_path, mark):
    path = zipped(tmp_path / "d.zip", DMA.replace(";", mark))
    out = registry.get("dma").normalize_positions(spark, [path], date(2024, 6, 15)).orderBy("mmsi").collect()
    assert [r.mmsi for r in out] == [219000001, 219000002]
    assert out[0].heading is None and out[0].imo == "9999999" and out[0].destination == "CPH"
    assert out[1].imo is None and out[1].draught is None and out[1].destination is None
    from wakeline.sources import dma

    raw = base.read_delimited(spark, [path], dma.COLUMNS)
    assert dma.normalize(raw, date(2024, 6, 16)).count() == 1


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: [{"ERROR": False}, x], lambda x: {"data": x}, lambda x: {"entries": x}])
def test_aishub(spark, tmp_path, wrap):
    item = {"MMSI": 1, "TIME": "2024-06-15 10:00:00 GMT", "LATITUDE": 1.5, "LONGITUDE": 2.5, "SOG": 3, "COG": 4, "HEADING": 511, "NAME": " X ", "IMO": 0, "CALLSIGN": "", "TYPE": 70, "A": 10, "B": 20, "C": 3, "D": None, "DRAUGHT": 1.2, "DEST": "D", "NAVSTAT": 5}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(wrap([item])))
    (r,) = registry.get("aishub").normalize_positions(spark, [str(path)]).collect()
    assert (r.mmsi, r.lat, r.heading, r.vessel_name, r.imo, r.callsign, r.length, r.beam, r.nav_status, r.ship_type) == (1, 1.5, None, "X", None, None, 30.0, None, "Moored", "70")
    assert aishub.records is not None


def test_gfw(spark, tmp_path):
    items = [
        {"id": "e1", "type": "encounter", "start": "2024-06-15T00:00:00.000Z", "end": "2024-06-15T02:00:00.000Z", "position": {"lat": 1.0, "lon": 2.0}, "vessel": {"ssvid": "111", "name": "A", "flag": "NOR", "type": "fishing"}, "encounter": {"vessel": {"ssvid": "222"}}},
        {"id": "e2", "type": "unknown", "vessel": {"ssvid": "333"}},
        {"id": "e3", "type": "FISHING", "start": "2024-06-15T00:00:00Z", "end": None, "vessel": {"ssvid": "111", "name": "B"}},
        {"id": "e4", "type": "PORT_VISIT", "start": "2024-06-15T00:00:00Z", "end": "2024-06-16T00:00:00Z", "vessel": {"ssvid": "x"}},
    ]
    (tmp_path / "events.json").write_text(json.dumps(items))
    (tmp_path / "effort.json").write_text(json.dumps([{"date": "2024-06-15", "flag": "NOR", "geartype": "trawl", "hours": 2.5, "lat": 1.0, "lon": 2.0}, {"date": None, "hours": 1}, {"date": "2024-06-15", "hours": None}, {"date": "bad", "hours": 1}]))
    gfw, paths = registry.get("gfw"), [str(tmp_path / "events.json"), str(tmp_path / "effort.json")]
    out = gfw.normalize_events(spark, paths)
    (e,) = out.collect()
    assert not EVENTS.validate(out) and (e.event_id, e.event_type, e.mmsi, e.other_mmsi, e.confidence_score) == ("e1", "encounter", 111, 222, 1.0)
    assert {(r.mmsi, r.vessel_name) for r in gfw.normalize_event_vessels(spark, paths).collect()} == {(111, "A"), (333, None)}
    effort = gfw.normalize_fishing_effort(spark, paths)
    assert not FISHING_EFFORT.validate(effort) and [r.vessel_hours for r in effort.collect()] == [2.5]
    with pytest.raises(NotImplementedError):
        gfw.normalize_positions(spark, paths)


def message(time="2024-06-15 10:00:00.123456789 +0000 UTC", kind="PositionReport", **meta):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": 1, "time_utc": time, "ShipName": " A  ", "latitude": 1.0, "longitude": 2.0} | meta, "Message": {"PositionReport": {"Sog": 1.5, "Cog": 2.5, "TrueHeading": 511, "NavigationalStatus": 1}}})


def test_aisstream(spark):
    texts = [message(), message("2024-06-15T10:00:00+00:00"), message("bad"), message(kind="StaticData"), message(latitude=None), message(MMSI=None), "{"]
    out = aisstream.normalize(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert len(out) == 3
    at = [r.timestamp.astimezone(UTC).replace(microsecond=0) for r in out]
    assert at[:2] == [datetime(2024, 6, 15, 10, tzinfo=UTC)] * 2 and at[2].year >= 2025
    assert out[0].heading is None and out[0].nav_status == "At anchor" and out[0].vessel_name == "A"
    assert aisstream.subscription("k", (1, 2, 3, 4))["BoundingBoxes"] == [[[2, 1], [4, 3]]]
    assert aisstream.subscription("k")["BoundingBoxes"] == [[[-90.0, -180.0], [90.0, 180.0]]]


def test_finland(spark):
    rows = [
        ("vessels-v2/230000001/location", json.dumps({"time": 1718445600, "sog": 1.0, "cog": 2.0, "navStat": 0, "heading": 511, "lon": 25.0, "lat": 60.0})),
        ("vessels-v2/230000001/metadata", json.dumps({"timestamp": 1718445600000, "destination": " HEL ", "name": "X", "draught": 55, "callSign": "", "imo": 0, "type": 70})),
        ("vessels-v2/bad/location", "{}"),
        ("vessels-v2/230000002/location", json.dumps({"time": 1, "lon": 25.0})),
    ]
    df = spark.createDataFrame(rows, "topic string, value string")
    (p,) = finland.locations(df).collect()
    assert (p.mmsi, p.heading, p.timestamp.astimezone(UTC)) == (230000001, None, datetime(2024, 6, 15, 10, tzinfo=UTC))
    (m,) = finland.metadata(df).collect()
    assert (m.draught, m.imo, m.callsign, m.destination, m.ship_type) == (5.5, None, None, "HEL", "70")
    assert finland.locations(df, bbox=(0, 0, 1, 1)).count() == 0


def test_registry():
    assert registry.registered() == ["aishub", "aisstream", "dma", "finland", "gfw", "noaa"]
    assert registry.find(streaming=True) == ["aisstream", "finland"] and registry.find(dataset="events") == ["gfw"]
    assert registry.find(backfill=True, auth=False) == ["dma", "noaa"]
    assert registry.compare("noaa", "dma")["format"]["noaa"].startswith("CSV")
    assert registry.available("noaa", date(2020, 1, 1)) and not registry.available("noaa", date(2000, 1, 1)) and registry.available("aishub", date(2020, 1, 1)) is None
    with pytest.raises(KeyError):
        registry.get("nowhere")

    class Point:
        def __init__(self, name, made):
            self.name, self.made = name, made

        def load(self):
            if self.made is None:
                raise ImportError(self.name)
            return self.made

    class Plugin(base.Source):
        SOURCE_ID, capabilities = "plugin", base.Capabilities("plugin", "P")

        def fetch_raw(self, spec):
            return []

        def normalize_positions(self, spark, paths, day=None):
            return None

    assert registry.load_plugins(lambda group: [Point("bad", None), Point("good", Plugin)], again=True) == ["plugin"]
    assert "plugin" in registry.registered() and registry.load_plugins(lambda group: [Point("x", Plugin)]) == []
    registry._sources.pop("plugin")


def test_download(tmp_path):
    import io
    import urllib.error

    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return io.BytesIO(b"abc")

    path = str(tmp_path / "x" / "f.bin")
    a = base.download("http://x/f.bin", path, wait=waits.append, get=get)
    assert a.size_bytes == 3 and a.sha256 == base.sha256_of(path) and waits == [1, 2]
    assert base.download("http://x/f.bin", path, get=None).sha256 == a.sha256

    def missing(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "none", {}, None)

    n = len(calls)
    with pytest.raises(urllib.error.HTTPError):
        base.download("http://x/g", str(tmp_path / "g"), wait=waits.append, get=missing)
    assert len(calls) == n + 1


class Sent:
    """Stands for the network: what was asked for, and answers by a part of the address."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def __call__(self, request):
        import io

        url = request if isinstance(request, str) else request.full_url
        self.asked.append((url, {} if isinstance(request, str) else dict(request.headers), None if isinstance(request, str) else request.data))
        return io.BytesIO(json.dumps(next(v(url) if callable(v) else v for k, v in self.answers.items() if k.replace("_", "-") in url)).encode())


def test_addresses():
    assert registry.get("dma").url(date(2024, 6, 15)) == "http://aisdata.ais.dk/2024/aisdk-2024-06-15.zip"
    assert registry.get("dma").url(date(2023, 6, 15)) == "http://aisdata.ais.dk/2023/aisdk-2023-06.zip"
    for source in ("aishub", "gfw"):
        with pytest.raises(ValueError, match="api_key"):
            registry.get(source).fetch_raw(base.FetchSpec(date(2024, 6, 15), "/nowhere"))


def test_fetched_and_ingested(spark, tmp_path):
    """Sources with a key fetch, are normalised and written; the key isn't kept."""
    from wakeline.plans.api import Fleet

    hub = Sent(aishub=[{"ERROR": False}, [{"MMSI": 219000001, "TIME": "2024-06-15 10:00:00 GMT", "LATITUDE": 55.0, "LONGITUDE": 11.0, "SOG": 1.0, "NAME": "X"}]])
    event = lambda i, kind, mmsi: {"id": i, "type": kind, "start": "2024-06-15T01:00:00.000Z", "end": "2024-06-15T02:00:00.000Z", "position": {"lat": 1.0, "lon": 2.0}, "vessel": {"ssvid": str(mmsi), "name": f"N{mmsi}", "flag": "DNK", "type": "fishing"}}
    pages = lambda url: {"entries": [event("a", "fishing", 219000001)], "nextOffset": 1000} if "offset=0" in url else {"entries": [event("b", "fishing", 219000002)], "nextOffset": None}
    gfw = Sent(fishing_events=pages, port_visits={"entries": [event("c", "port_visit", 219000001)]}, events={"entries": []}, report={"entries": [{"date": "2024-06-15", "flag": "DNK", "geartype": "trawlers", "hours": 2.5, "lat": 1.0, "lon": 2.0}]})
    options = {"aishub": {"api_key": "s3cret", "transport": {"get": hub}}, "gfw": {"api_key": "t0ken", "transport": {"get": gfw}, "bbox": (0.0, 0.0, 5.0, 5.0)}}
    fleet = Fleet(spark, str(tmp_path / "s"), "2024-06-15", ["aishub", "gfw"], options=options)
    made = fleet.download()
    assert {(m.source, m.dataset): m.record_count for m in made} == {("aishub", "positions"): 1, ("aishub", "vessels"): 1, ("gfw", "events"): 3, ("gfw", "vessels"): 2, ("gfw", "fishing_effort"): 1}
    assert fleet.fishing_effort().first().vessel_hours == 2.5 and {r.event_id for r in fleet.events().collect()} == {"a", "b", "c"}
    assert all(h["Authorization"] == "Bearer t0ken" for _, h, _ in gfw.asked) and b"Polygon" in gfw.asked[-1][2]
    assert "s3cret" in hub.asked[0][0] and "s3cret" not in str([m.raw_artifacts for m in made]) and "t0ken" not in str([m.raw_artifacts for m in made])


def test_a_failed_day_is_raised_after_the_rest(spark, tmp_path):
    from wakeline.plans.api import Fleet

    hub = Sent(aishub=[])
    fleet = Fleet(spark, str(tmp_path / "s"), "2024-06-15", ["gfw", "aishub"], options={"aishub": {"api_key": "k", "transport": {"get": hub}}})
    with pytest.raises(ExceptionGroup, match="1 of 2"):
        fleet.download()
    assert [m.source for m in fleet.catalog.partitions("positions")] == ["aishub"]
