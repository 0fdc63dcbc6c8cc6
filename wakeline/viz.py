"""Preparing datasets for maps, and a page that replays tracks."""

from __future__ import annotations

import html
import json
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.density import bin_positions


@dataclass(frozen=True)
class Viewport:
    west: float
    south: float
    east: float
    north: float

    def __post_init__(self):
        if not -90 <= self.south <= self.north <= 90:
            raise ValueError("-90 <= south <= north <= 90 must hold")
        if not (-180 <= self.west <= 180 and -180 <= self.east <= 180):
            raise ValueError("west and east must lie within 180 degrees")


def clip_points(df: DataFrame, view: Viewport | None) -> DataFrame:
    return df if view is None else df.where(F.col("lon").between(view.west, view.east) & F.col("lat").between(view.south, view.north))


def clip_tracks(tracks: DataFrame, view: Viewport | None) -> DataFrame:
    """Tracks whose box meets the viewport, edges included."""
    if view is None:
        return tracks
    return tracks.where((F.col("bbox_west") <= view.east) & (F.col("bbox_east") >= view.west) & (F.col("bbox_south") <= view.north) & (F.col("bbox_north") >= view.south))


def sample(df: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all where there are no more."""
    return df if n is None else df.orderBy(F.rand(seed)).limit(n)


def prepare_positions(positions: DataFrame, view: Viewport | None = None, n: int | None = None) -> DataFrame:
    return sample(clip_points(positions, view), n)


def prepare_tracks(tracks: DataFrame, view: Viewport | None = None, n: int | None = None) -> DataFrame:
    return sample(clip_tracks(tracks, view), n)


def prepare_events(events: DataFrame, view: Viewport | None = None, n: int | None = None) -> DataFrame:
    return sample(clip_points(events, view), n)


def prepare_trips(tracks: DataFrame, view: Viewport | None = None, n: int | None = None) -> DataFrame:
    """Tracks with geometry and times, and their duration as a share of the longest one's."""
    if not {"geometry_wkb", "timestamp_offsets_ms"} <= set(tracks.columns):
        return clip_tracks(tracks, view).where("false").withColumn("trip_progress", F.lit(0.0))
    trips = prepare_tracks(tracks, view, n).where("geometry_wkb IS NOT NULL AND timestamp_offsets_ms IS NOT NULL")
    longest = trips.agg(F.max("duration_s").alias("_longest"))
    return trips.crossJoin(F.broadcast(longest)).withColumn("trip_progress", F.when(F.col("_longest") > 0, F.col("duration_s") / F.col("_longest")).otherwise(0.0)).drop("_longest")


def prepare_density(positions: DataFrame, resolution: int = 4, view: Viewport | None = None, n: int | None = None) -> DataFrame:
    return bin_positions(prepare_positions(positions, view, n), resolution)


def decode_linestring(wkb: bytes) -> list[tuple[float, float]]:
    order, kind, n = struct.unpack_from("<BII", wkb)
    if (order, kind) != (1, 2):
        raise ValueError("no little-endian line")
    values = struct.unpack_from(f"<{2 * n}d", wkb, 9)
    return list(zip(values[::2], values[1::2], strict=True))


def geometry_wkt(tracks: DataFrame) -> list[tuple[str, str]]:
    """(track_id, WKT): the line where a track has one, else its box; for geometry libraries, on the driver."""
    out = []
    for r in tracks.toLocalIterator():
        points = decode_linestring(r.geometry_wkb) if r.geometry_wkb else [(r.bbox_west, r.bbox_south), (r.bbox_east, r.bbox_south), (r.bbox_east, r.bbox_north), (r.bbox_west, r.bbox_north), (r.bbox_west, r.bbox_south)]
        text = ", ".join(f"{x} {y}" for x, y in points)
        out.append((r.track_id, f"LINESTRING ({text})" if r.geometry_wkb else f"POLYGON (({text}))"))
    return out


def colour(mmsi: int) -> list[int]:
    """A vessel's colour, the same in every page."""
    return [64 + (mmsi * k) % 192 for k in (37, 91, 149)]


def zoom(spread: float) -> int:
    """A map's zoom for a spread in degrees."""
    return next((z for limit, z in ((0.05, 13), (0.2, 11), (1, 9), (5, 7), (20, 5), (60, 3)) if spread <= limit), 2)


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><style>body{{margin:0;background:#0b1622;color:#dde;font-family:sans-serif}}canvas{{display:block}}</style></head>
<body>{note}<canvas id="c"></canvas><script>
const data = {data};
const c = document.getElementById("c"), g = c.getContext("2d");
c.width = innerWidth; c.height = innerHeight;
const scale = Math.min(c.width / data.span, c.height / data.span) * 0.9;
const at = (p) => [c.width / 2 + (p[0] - data.center[0]) * scale, c.height / 2 - (p[1] - data.center[1]) * scale];
let t = 0;
function draw() {{
  g.clearRect(0, 0, c.width, c.height);
  for (const k of data.trips) {{
    g.strokeStyle = "rgb(" + k.color.join(",") + ")"; g.beginPath();
    k.path.forEach((p, i) => {{ if (k.times[i] <= t) {{ const q = at(p); i ? g.lineTo(q[0], q[1]) : g.moveTo(q[0], q[1]); }} }});
    g.stroke();
  }}
  t = t > data.longest ? 0 : t + data.longest / 600; requestAnimationFrame(draw);
}}
draw();
</script></body></html>
"""


def replay_html(tracks: DataFrame, title: str = "Replay", most: int | None = None) -> str:
    """A page that draws tracks as time goes on, built on the driver: all that have geometry, or the ``most`` longest and how many it leaves out."""
    drawn = tracks.where("geometry_wkb IS NOT NULL AND timestamp_offsets_ms IS NOT NULL").orderBy(F.desc("duration_s"), "track_id").select("geometry_wkb", "timestamp_offsets_ms", "mmsi")
    left = 0 if most is None else max(0, drawn.count() - most)
    rows = drawn if most is None else drawn.limit(most)
    trips = [{"path": decode_linestring(r.geometry_wkb), "times": list(r.timestamp_offsets_ms), "color": colour(r.mmsi), "mmsi": r.mmsi} for r in rows.toLocalIterator()]
    points = [p for t in trips for p in t["path"]] or [(0.0, 0.0)]
    xs, ys = zip(*points, strict=True)
    span = max(max(xs) - min(xs), max(ys) - min(ys), 1e-3)
    data = {"trips": trips, "center": [(min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2], "span": span, "zoom": zoom(span), "longest": max([t["times"][-1] for t in trips] or [1])}
    return PAGE.format(title=html.escape(title), note=f"<p>{left} shorter tracks are not drawn</p>" if left else "", data=json.dumps(data).replace("</", "<\\/"))
