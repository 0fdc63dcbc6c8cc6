"""Queries over the driver's tables, one an operator, and the SQL that gives the same rows.

Positions are the ``events`` table seen as vessels: users are vessels, events
are fixes.  Times leave as microseconds, and sums of doubles are rounded, as
engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.exprs import confidence_class, micros, nav_status
from wakeline.operators import boundaries, density, events, fusion, helpers, qc, tracks
from wakeline.schemas import DATASETS

VIEW = """
    200000000 + user_id AS mmsi, {ts} AS timestamp,
    CAST(50.0 AS DOUBLE) + (user_id % 10) * CAST(0.5 AS DOUBLE) + (event_id % 100) / CAST(10000.0 AS DOUBLE) AS lat,
    CAST(2.0 AS DOUBLE) + (user_id % 7) * CAST(0.5 AS DOUBLE) + (event_id % 89) / CAST(10000.0 AS DOUBLE) AS lon,
    value / CAST(25.0 AS DOUBLE) AS sog,
    CASE event_id % 3 WHEN 0 THEN 'noaa' WHEN 1 THEN 'dma' ELSE 'aishub' END AS source,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'V' || CAST(user_id AS STRING) END AS vessel_name,
    event_type AS ship_type, event_id
"""
POS = f"p AS (SELECT {VIEW.format(ts='ts').replace('STRING', 'VARCHAR')} FROM events)"
#: Ties in time are settled by place in every query.
ORDER = "timestamp, lat, lon"

TRACKS = tracks.TrackConfig(gap_seconds=86_400, max_speed_knots=5000.0, min_points=3, min_duration_seconds=300, min_distance_m=100.0)
PORTS = boundaries.BoundaryDataset("ports", "2024.1", (boundaries.Region("alpha", 2.0, 50.0, 2.6, 51.1), boundaries.Region("beta", 2.4, 50.9, 3.0, 52.0), boundaries.Region("gamma", 3.4, 50.0, 5.1, 54.6)))
ZONES = boundaries.BoundaryDataset("eez", "11.0", (boundaries.Region("west", 1.0, 49.0, 2.0045, 56.0), boundaries.Region("east", 2.0045, 49.0, 6.0, 56.0)))
REEF = boundaries.BoundaryDataset("reef", "1.0", (boundaries.Region("reef", 2.0, 50.0, 5.0, 54.0, ((2.0, 50.0), (5.0, 50.0), (3.5, 54.0))),))
REGIONS = boundaries.BoundaryRegistry(PORTS, ZONES, REEF)
PORT_CALLS = events.PortCallConfig(max_speed_knots=12.0, min_duration_s=3600, min_points=3, gap_seconds=86_400)
CROSSINGS = events.EEZCrossingConfig(max_gap_s=7200, max_distance_m=100_000.0)
ENCOUNTERS = events.EncounterConfig(max_distance_m=500.0, min_duration_s=600, min_observations=2, time_bucket_s=3600, gap_seconds=86_400)
LOITERING = events.LoiteringConfig(max_speed_knots=12.0, max_radius_m=1000.0, min_duration_s=1800, min_points=3, gap_seconds=86_400)
FUSION = dict(timestamp_tolerance_seconds=3600.0, coordinate_tolerance_degrees=0.01)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr(*[x.strip() for x in _split(VIEW.format(ts="CAST(ts AS TIMESTAMP)"))])


def _split(text: str) -> list[str]:
    """The items of a select list."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out, item = [*out, item], ""
        else:
            item += c
    return [*out, item]


def _flat(df: DataFrame, *rounded: str) -> DataFrame:
    """Times as microseconds, and ``rounded`` doubles to 6 places; the nudge keeps exact halves from falling either way."""
    times = {n: micros(F.col(n)) for n, k in df.dtypes if k == "timestamp"}
    return df.withColumns(times | {c: F.round(F.col(c) + NUDGE, 6) for c in rounded})


NUDGE = 1.3e-8
QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_COLUMNS = "mmsi, epoch_us(timestamp) AS timestamp, lat, lon, sog, source, vessel_name, ship_type, event_id"


# --- filters and helpers


@_query(f"WITH {POS} SELECT {_COLUMNS} FROM p WHERE lat BETWEEN 50.5 AND 52.0 AND lon BETWEEN 2.5 AND 4.0")
def filter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(helpers.filter_bbox(positions(spark, sf_dir), 2.5, 50.5, 4.0, 52.0))


@_query(f"WITH {POS} SELECT {_COLUMNS} FROM p WHERE mmsi IN (200000005, 200000017, 200000101)")
def filter_mmsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(helpers.filter_mmsi(positions(spark, sf_dir), [200000005, 200000017, 200000101]))


@_query(f"WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp DESC, lat DESC, lon DESC, source DESC) AS n FROM p) SELECT {_COLUMNS} FROM r WHERE n = 1")
def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(helpers.latest_positions(positions(spark, sf_dir)))


@_query(f"WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), {ORDER}, source) AS n FROM p) SELECT {_COLUMNS} FROM r WHERE n = 1")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(helpers.snapshot(positions(spark, sf_dir), "2024-01-15 12:00:00"))


@_query(f"WITH {POS} SELECT mmsi, count(*) AS points, round(avg(sog) + 1.3e-8::DOUBLE, 6) AS mean_sog, max(sog) AS max_sog, epoch_us(min(timestamp)) AS first_seen, epoch_us(max(timestamp)) AS last_seen FROM p GROUP BY mmsi")
def vessel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(helpers.vessel_stats(positions(spark, sf_dir)), "mean_sog")


@_query(f"WITH {POS} SELECT mmsi, max(sog) AS max_sog FROM p GROUP BY mmsi ORDER BY max_sog DESC, mmsi LIMIT 10")
def top_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helpers.top_speeds(positions(spark, sf_dir))


# --- tracks

_METRES = "sqrt(pow(({a}lat - {b}lat) * 111320.0::DOUBLE, 2) + pow(({a}lon - {b}lon) * 111320.0::DOUBLE * cos(radians({at})), 2))"
_SEGMENTS = f"""
    {POS},
    l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY source, mmsi ORDER BY {ORDER})),
    d AS (SELECT *, (epoch_us(timestamp) - epoch_us(pt)) / 1e6::DOUBLE AS dt, {_METRES.format(a='', b='p', at='lat')} AS m FROM l),
    b AS (SELECT *, CASE WHEN pt IS NULL OR dt > {TRACKS.gap_seconds} OR dt <= 0 OR m / dt > {TRACKS.max_speed_knots}::DOUBLE * 1852.0 / 3600.0 THEN 1 ELSE 0 END AS brk FROM d),
    s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY source, mmsi ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b)
"""


@_query(f"WITH {_SEGMENTS} SELECT event_id, source, mmsi, segment FROM s")
def track_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.detect_boundaries(positions(spark, sf_dir), TRACKS).select("event_id", "source", "mmsi", "segment")


_TRACK_SQL = f"""
    WITH {_SEGMENTS},
    t AS (SELECT source, mmsi, segment, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS point_count,
                 coalesce(sum(CASE WHEN brk = 0 THEN m END), 0.0) AS distance_m, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6)::DOUBLE AS duration_s,
                 avg(sog) AS mean_speed, max(sog) AS max_speed, min(lon) AS bbox_west, min(lat) AS bbox_south, max(lon) AS bbox_east, max(lat) AS bbox_north
          FROM s GROUP BY source, mmsi, segment)
    SELECT sha1(mmsi || ':' || epoch_us(start_time) || ':' || source || ':{TRACKS.config_hash()}')[1:16] AS track_id, mmsi, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time,
           point_count, round(distance_m, 3) AS distance_m, duration_s, round(mean_speed + 1.3e-8::DOUBLE, 6) AS mean_speed, max_speed, bbox_west, bbox_south, bbox_east, bbox_north, source, source || ':tracks' AS record_provenance
    FROM t WHERE point_count >= 3 AND duration_s >= 300 AND distance_m >= 100
"""


@_query(_TRACK_SQL)
def build_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.build_tracks(positions(spark, sf_dir), TRACKS).drop("geometry_wkb", "timestamp_offsets_ms")
    return _flat(out, "mean_speed").withColumn("distance_m", F.round("distance_m", 3))


@_query(_TRACK_SQL[: _TRACK_SQL.index("SELECT sha1")] + "SELECT s.event_id, s.source, s.mmsi, s.segment FROM s JOIN t USING (source, mmsi, segment) WHERE point_count >= 3 AND duration_s >= 300 AND distance_m >= 100")
def track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.filter_segments(tracks.detect_boundaries(positions(spark, sf_dir), TRACKS), TRACKS)
    return rows.select("event_id", "source", "mmsi", "segment")


@_query()
def track_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = tracks.TrackConfig(TRACKS.gap_seconds, TRACKS.max_speed_knots, include_geometry=True)
    return _flat(tracks.build_tracks(positions(spark, sf_dir), config))


# --- regions


def _first(dataset: boundaries.BoundaryDataset, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {prefix}lon BETWEEN {r.west} AND {r.east} AND {prefix}lat BETWEEN {r.south} AND {r.north} THEN '{r.name}'" for r in dataset.regions) + " END"


@_query(f"WITH {POS} SELECT event_id, {_first(PORTS)} AS port, {_first(ZONES)} AS zone FROM p")
def region_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", REGIONS.region_of("ports").alias("port"), REGIONS.region_of("eez").alias("zone"))


@_query(
    f"WITH {POS} SELECT event_id, r.dataset, r.region FROM p JOIN (VALUES "
    + ", ".join(f"('{d.name}', '{r.name}', {r.west}::DOUBLE, {r.south}::DOUBLE, {r.east}::DOUBLE, {r.north}::DOUBLE)" for d in (PORTS, ZONES) for r in d.regions)
    + ") r(dataset, region, w, s, e, n) ON lon BETWEEN w AND e AND lat BETWEEN s AND n"
)
def region_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = boundaries.BoundaryRegistry(PORTS, ZONES)
    return positions(spark, sf_dir).select("event_id", F.explode(both.regions_of()).alias("r")).select("event_id", "r.dataset", "r.region")


@_query(f"WITH {POS} SELECT event_id FROM p WHERE lon BETWEEN 2 AND 5 AND lat BETWEEN 50 AND 54 AND lat - 50 < (lon - 2) * 4 / 1.5::DOUBLE AND lat - 50 < (5 - lon) * 4 / 1.5::DOUBLE AND lat > 50")
def region_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    return rows.where(REGIONS.region_of("reef").isNotNull()).select("event_id")


# --- events

_EVENT_COLUMNS = ["event_id", "event_type", "mmsi", "other_mmsi", "start_time", "end_time", "lat", "lon", "confidence_score", "source", "record_provenance"]


def _shown(out: DataFrame) -> DataFrame:
    return _flat(out.select(*_EVENT_COLUMNS), "lat", "lon")


def _event_sql(body: str, kind: str, config, upstream: str, other: str = "NULL::BIGINT") -> str:
    return f"""{body} SELECT sha1('{kind}:' || mmsi || ':' || epoch_us(start_time) || ':' || source || ':{config.config_hash()}')[1:16] AS event_id, '{kind}' AS event_type, mmsi, {other} AS other_mmsi,
        epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, round(lat + 1.3e-8::DOUBLE, 6) AS lat, round(lon + 1.3e-8::DOUBLE, 6) AS lon, CAST(score AS DOUBLE) AS confidence_score, source,
        'derived:{kind}_detector/0.1.0[{upstream}]' AS record_provenance FROM f"""


def _runs_sql(rows: str, gap: int, extra: str = "FALSE", keep: str = "lag(region) OVER w AS pr") -> str:
    return f"""
        l AS (SELECT *, lag(timestamp) OVER w AS pt, {keep} FROM ({rows}) WINDOW w AS (PARTITION BY mmsi ORDER BY {ORDER}, source)),
        r AS (SELECT *, sum(CASE WHEN pt IS NULL OR {extra} OR epoch_us(timestamp) - epoch_us(pt) > {gap * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY {ORDER}, source ROWS UNBOUNDED PRECEDING) AS run FROM l)
    """


@_query(_event_sql(f"""
    WITH {POS}, {_runs_sql(f"SELECT * FROM (SELECT *, {_first(PORTS)} AS region FROM p) WHERE region IS NOT NULL AND sog <= 12.0", PORT_CALLS.gap_seconds, "region <> pr")},
    g AS (SELECT mmsi, run, min(timestamp) AS start_time, max(timestamp) AS end_time, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n, arg_min(source, (timestamp, lat, lon, source)) AS source,
                 floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS secs FROM r GROUP BY mmsi, run),
    f AS (SELECT *, CASE WHEN secs >= 14400 THEN 0.9 WHEN secs >= 7200 THEN 0.7 ELSE 0.5 END AS score FROM g WHERE secs >= 3600 AND n >= 3)
""", "port_call", PORT_CALLS, "boundaries+positions"))  # fmt: skip
def port_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = REGIONS.label(positions(spark, sf_dir), "ports")
    return _shown(events.detect_port_calls(rows, config=PORT_CALLS))


@_query(_event_sql(f"""
    WITH {POS}, z AS (SELECT *, {_first(ZONES)} AS region FROM p),
    l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(region) OVER w AS pr FROM z WINDOW w AS (PARTITION BY mmsi ORDER BY {ORDER}, source)),
    c AS (SELECT mmsi, source, pt AS start_time, timestamp AS end_time, (lat + plat) / 2 AS lat, (lon + plon) / 2 AS lon, (epoch_us(timestamp) - epoch_us(pt)) / 1e6 AS secs, {_METRES.format(a='', b='p', at='lat')} AS m
          FROM l WHERE region IS NOT NULL AND pr IS NOT NULL AND region <> pr),
    f AS (SELECT *, CASE WHEN secs <= 1800 AND m <= 20000 THEN 0.9 WHEN secs <= 7200 AND m <= 100000 THEN 0.7 ELSE 0.5 END AS score FROM c WHERE secs > 0 AND secs <= 7200 AND m <= 100000)
""", "eez_crossing", CROSSINGS, "boundaries+positions"))  # fmt: skip
def eez_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = REGIONS.label(positions(spark, sf_dir), "eez")
    return _shown(events.detect_eez_crossings(rows, config=CROSSINGS))


@_query(_event_sql(f"""
    WITH {POS}, q AS (SELECT *, epoch_us(timestamp) // 3600000000 AS bucket FROM p),
    j AS (SELECT a.mmsi, b.mmsi AS other_mmsi, a.timestamp AS ta, b.timestamp AS tb, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, a.source AS asource, least(a.timestamp, b.timestamp) AS timestamp,
                 {_METRES.format(a='a.', b='b.', at='(a.lat + b.lat) / 2')} AS m
          FROM q a JOIN (SELECT *, unnest([bucket - 1, bucket, bucket + 1]) AS near FROM q) b ON a.bucket = b.near AND a.mmsi < b.mmsi),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, other_mmsi, ta, tb ORDER BY alat, alon, asource, blat, blon) AS n FROM j WHERE m <= 500) WHERE n = 1),
    l AS (SELECT *, lag(timestamp) OVER (PARTITION BY mmsi, other_mmsi ORDER BY timestamp, ta, tb) AS pt FROM o),
    r AS (SELECT *, sum(CASE WHEN pt IS NULL OR epoch_us(timestamp) - epoch_us(pt) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi, other_mmsi ORDER BY timestamp, ta, tb ROWS UNBOUNDED PRECEDING) AS run FROM l),
    g AS (SELECT mmsi, other_mmsi, run, least(min(ta), min(tb)) AS start_time, greatest(max(ta), max(tb)) AS end_time, avg((alat + blat) / 2) AS lat, avg((alon + blon) / 2) AS lon, count(*) AS n,
                 floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS secs, avg(m) AS m, arg_min(asource, (timestamp, ta, tb)) AS source FROM r GROUP BY mmsi, other_mmsi, run),
    f AS (SELECT *, CASE WHEN secs >= 3600 AND m <= 200 THEN 0.9 WHEN secs >= 600 AND m <= 500 THEN 0.7 ELSE 0.5 END AS score FROM g WHERE secs >= 600 AND n >= 2)
""", "encounter", ENCOUNTERS, "positions", "other_mmsi"))  # fmt: skip
def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(events.detect_encounters(positions(spark, sf_dir), ENCOUNTERS))


_LOITERING_SQL = _event_sql(f"""
    WITH {POS}, {_runs_sql("SELECT * FROM p WHERE sog <= 12.0", LOITERING.gap_seconds, keep="lag(lat) OVER w AS pl")},
    c AS (SELECT *, avg(lat) OVER (PARTITION BY mmsi, run) AS clat, avg(lon) OVER (PARTITION BY mmsi, run) AS clon FROM r),
    g AS (SELECT mmsi, run, min(timestamp) AS start_time, max(timestamp) AS end_time, min(clat) AS lat, min(clon) AS lon, count(*) AS n, max({_METRES.format(a='', b='c', at='clat')}) AS radius,
                 arg_min(source, (timestamp, lat, lon, source)) AS source, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS secs FROM c GROUP BY mmsi, run),
    f AS (SELECT *, CASE WHEN secs >= 7200 AND radius <= 500 THEN 0.9 WHEN secs >= 1800 AND radius <= 1000 THEN 0.7 ELSE 0.5 END AS score FROM g WHERE secs >= 1800 AND n >= 3 AND radius <= 1000)
""", "loitering", LOITERING, "positions")  # fmt: skip


@_query(_LOITERING_SQL)
def loitering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(events.detect_loitering(positions(spark, sf_dir), LOITERING))


@_query(f"SELECT event_id, confidence_score, CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.3 THEN 'medium' ELSE 'low' END AS confidence, 'derived' AS source_part, 'loitering_detector' AS detector, '0.1.0' AS version, 'positions' AS upstream FROM ({_LOITERING_SQL}) WHERE confidence_score >= 0.7")
def events_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events by kind and confidence, with the parts of their provenance."""
    out = events.detect_loitering(positions(spark, sf_dir), LOITERING).where("event_type = 'loitering' AND confidence_score >= 0.7")
    out = out.withColumn("p", events.provenance_parts(F.col("record_provenance")))
    return out.select("event_id", "confidence_score", confidence_class(F.col("confidence_score")).alias("confidence"), F.col("p.source").alias("source_part"), "p.detector", F.col("p.detector_version").alias("version"), F.array_join("p.upstream_datasets", "+").alias("upstream"))


@_query(f"""
    WITH {POS}, t AS ({_TRACK_SQL}), e AS ({_LOITERING_SQL})
    SELECT 'positions' AS dataset, event_id::VARCHAR AS id, epoch_us(timestamp) AS time FROM p WHERE mmsi = 200000042
    UNION ALL SELECT 'tracks', track_id, start_time FROM t WHERE mmsi = 200000042 UNION ALL SELECT 'events', event_id, start_time FROM e WHERE mmsi = 200000042
""")
def vessel_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    found = helpers.vessel_history(200000042, rows, tracks.build_tracks(rows, TRACKS), events.detect_loitering(rows, LOITERING))
    show = lambda name, key, time: found[name].select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("id"), micros(F.col(time)).alias("time"))
    return show("positions", "event_id", "timestamp").union(show("tracks", "track_id", "start_time")).union(show("events", "event_id", "start_time"))


# --- density


@_query(f"WITH {POS}, g AS (SELECT round(lat, 2) AS center_lat, round(lon, 2) AS center_lon, count(DISTINCT mmsi) AS vessel_count, count(*) AS observation_count FROM p GROUP BY 1, 2) SELECT center_lat || ',' || center_lon AS cell_id, * FROM g")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.compute_density(positions(spark, sf_dir), 4)


@_query(f"WITH {POS}, g AS (SELECT round(lat, 1) AS center_lat, round(lon, 1) AS center_lon, count(*) AS count FROM p GROUP BY 1, 2) SELECT center_lat || ',' || center_lon AS h3_index, * FROM g")
def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.bin_positions(positions(spark, sf_dir), 1)


# --- fusion


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = positions(spark, sf_dir)
    return {s: rows.where(F.col("source") == s) for s in ("noaa", "dma", "aishub")}


_FUSED = f"""
    WITH {POS}, k AS (SELECT *, epoch_us(timestamp) // 3600000000 AS tb, round(lat / 0.01::DOUBLE) AS yb, round(lon / 0.01::DOUBLE) AS xb, {{rank}} AS rank FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY mmsi, tb, yb, xb ORDER BY rank, {ORDER}) AS n, list_sort(list_distinct(list(source) OVER (PARTITION BY mmsi, tb, yb, xb))) AS sources FROM k)
    SELECT mmsi, epoch_us(timestamp) AS timestamp, lat, lon, sog, source, vessel_name, ship_type, event_id,
           source || '{{tag}}' || CASE WHEN len(sources) > 1 THEN '[+' || array_to_string(sources, '+') || ']' ELSE '' END AS record_provenance
    FROM r WHERE n = 1
"""


@_query(f"WITH {POS} SELECT {_COLUMNS}, source || ':union' AS record_provenance FROM p")
def fusion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fusion.merge(_sources(spark, sf_dir), fusion.FusionConfig("union")))


@_query(_FUSED.format(rank="CASE source WHEN 'aishub' THEN 0 WHEN 'dma' THEN 1 ELSE 2 END", tag=":best"))
def fusion_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fusion.merge(_sources(spark, sf_dir), fusion.FusionConfig("best", **FUSION)))


@_query(_FUSED.format(rank="CASE source WHEN 'noaa' THEN 0 WHEN 'aishub' THEN 1 ELSE 2 END", tag=":prefer:noaa"))
def fusion_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fusion.merge(_sources(spark, sf_dir), fusion.FusionConfig("prefer", prefer_source="noaa", **FUSION)))


@_query(f"""
    WITH {POS}, k AS (SELECT *, epoch_us(timestamp) // 3600000000 AS tb, CASE source WHEN 'aishub' THEN 0 WHEN 'dma' THEN 1 ELSE 2 END AS rank, CASE source WHEN 'noaa' THEN 0 WHEN 'aishub' THEN 1 ELSE 2 END AS name_rank FROM p)
    SELECT mmsi, tb, arg_min(event_id, (rank, timestamp, lat, lon)) AS event_id, arg_min(vessel_name, (name_rank, timestamp)) FILTER (vessel_name IS NOT NULL) AS vessel_name,
           CASE arg_min(source, (rank, timestamp, lat, lon)) WHEN 'noaa' THEN 1.0::DOUBLE WHEN 'dma' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence_score
    FROM k GROUP BY mmsi, tb
""")
def fusion_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = fusion.FusionConfig("best", timestamp_tolerance_seconds=3600.0, coordinate_tolerance_degrees=0.0, field_precedence={"vessel_name": ["noaa"]}, source_confidence_weights={"noaa": 1.0, "dma": 0.8})
    out = fusion.merge(_sources(spark, sf_dir), config)
    return out.select("mmsi", F.floor(micros(F.col("timestamp")) / 3_600_000_000).alias("tb"), "event_id", "vessel_name", "confidence_score")


# --- quality


@_query(f"""
    WITH {POS}, x AS (SELECT mmsi, timestamp, lat, lon, sog * 12 AS sog, source, event_id FROM p),
    l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM x WINDOW w AS (PARTITION BY mmsi ORDER BY {ORDER})),
    d AS (SELECT *, (epoch_us(timestamp) - epoch_us(pt)) / 1e6::DOUBLE AS dt, {_METRES.format(a='', b='p', at='lat')} AS m FROM l),
    f AS (SELECT event_id, list_filter([CASE WHEN sog NOT BETWEEN 0 AND 102.3 THEN 'sog_range' END, CASE WHEN dt > 0 AND m / dt > 50.0 * 1852.0::DOUBLE / 3600.0 THEN 'implied_speed' END], lambda x: x IS NOT NULL) AS flags FROM d)
    SELECT event_id, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) > 0 THEN 'warning' ELSE 'ok' END AS qc_severity, round(greatest(0, 1 - 0.2::DOUBLE * len(flags)), 6) AS confidence_score FROM f
""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).select("mmsi", "timestamp", "lat", "lon", (F.col("sog") * 12).alias("sog"), "source", "event_id")
    return qc.run_checks(rows).select("event_id", F.array_join("qc_flags", ",").alias("flags"), "qc_severity", F.round("confidence_score", 6).alias("confidence_score"))


#: Positions with faults of every kind; ts is left to be filled in.
SPOILED = """
    event_id, CASE WHEN event_id % 41 = 0 THEN 7 WHEN event_id % 43 = 0 THEN NULL WHEN user_id % 10 = 3 THEN 200000003 ELSE 200000000 + user_id END AS mmsi,
    CASE WHEN event_id % 47 = 0 THEN NULL ELSE {ts} END AS timestamp,
    CASE WHEN event_id % 31 = 0 THEN CAST(95.0 AS DOUBLE) WHEN event_id % 37 = 0 THEN NULL WHEN user_id % 10 = 3 THEN CAST(50.0 AS DOUBLE) ELSE CAST(50.0 AS DOUBLE) + (user_id % 10) * CAST(0.5 AS DOUBLE) + (event_id % 100) / CAST(100.0 AS DOUBLE) END AS lat,
    CASE WHEN event_id % 29 = 0 THEN CAST(-190.0 AS DOUBLE) WHEN event_id % 59 = 0 THEN NULL WHEN user_id % 10 = 3 THEN CAST(2.0 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) + (event_id % 89) / CAST(100.0 AS DOUBLE) END AS lon,
    value / CAST(25.0 AS DOUBLE) * 12 AS sog, CAST(event_id % 400 AS DOUBLE) AS cog, CAST(event_id % 380 AS DOUBLE) AS heading, CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'noaa' END AS source
"""
#: Name, severity and failing condition of each check.
_FAILS = (
    ("lat_range", "error", "lat NOT BETWEEN -90 AND 90"), ("lon_range", "error", "lon NOT BETWEEN -180 AND 180"), ("sog_range", "warning", "sog NOT BETWEEN 0 AND 102.3::DOUBLE"), ("cog_range", "warning", "cog NOT BETWEEN 0 AND 360"),
    ("heading_range", "warning", "heading NOT BETWEEN 0 AND 360"), *((f"{c}_not_null", "error", f"{c} IS NULL") for c in ("mmsi", "timestamp", "lat", "lon", "source")), ("mmsi_format", "error", "mmsi NOT BETWEEN 100000000 AND 999999999"),
    ("implied_speed", "warning", "dt > 0 AND m / dt > 50.0 * 1852.0::DOUBLE / 3600.0"), ("stale_position", "warning", "run > 100"), ("timestamp_order", "warning", "timestamp < arrived"),
)
_CHECKED = f"""
    x AS (SELECT {SPOILED.format(ts='ts')} FROM events),
    l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS rn, lag(timestamp) OVER (PARTITION BY mmsi ORDER BY event_id) AS arrived
          FROM x WHERE mmsi IS NOT NULL WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST)),
    d AS (SELECT *, sum(CASE WHEN rn = 1 OR lat IS DISTINCT FROM plat OR lon IS DISTINCT FROM plon THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY rn ROWS UNBOUNDED PRECEDING) AS stay,
                 (epoch_us(timestamp) - epoch_us(pt)) / 1e6::DOUBLE AS dt, {_METRES.format(a='', b='p', at='lat')} AS m FROM l),
    c AS (SELECT * EXCLUDE (pt, plat, plon, rn, stay), row_number() OVER (PARTITION BY mmsi, stay ORDER BY rn) AS run FROM d
          UNION ALL BY NAME SELECT * FROM x WHERE mmsi IS NULL)
"""


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in _split(SPOILED.format(ts="CAST(ts AS TIMESTAMP)"))])


@_query(f"WITH {_CHECKED} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{k}' AS severity, count(*) AS rows_checked, count(*) FILTER ({fails}) AS rows_flagged FROM c" for n, k, fails in _FAILS))
def qc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks, each over rows of which some fail it."""
    return qc.check_counts(qc.run_checks(_spoiled(spark, sf_dir), arrival="event_id"))


_LISTED = "list_filter([" + ", ".join(f"CASE WHEN {fails} THEN '{n}' END" for n, _, fails in _FAILS if n != "stale_position") + "], lambda x: x IS NOT NULL)"


@_query(f"""
    WITH {_CHECKED}, f AS (SELECT event_id, {_LISTED} AS flags, {" OR ".join(f"coalesce({fails}, FALSE)" for _, k, fails in _FAILS if k == "error")} AS bad, {" + ".join(f"coalesce(({fails})::INT, 0)" for n, k, fails in _FAILS if k == "warning" and n != "stale_position")} AS odd FROM c)
    SELECT event_id, array_to_string(flags, ',') AS flags, CASE WHEN bad THEN 'error' WHEN odd > 0 THEN 'warning' ELSE 'ok' END AS qc_severity, round(CASE WHEN bad THEN 0 ELSE greatest(0, 1 - 0.2::DOUBLE * odd) END, 6) AS confidence_score FROM f
""")
def qc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, severity and score of each row; without stale_position, where rows that tie can stand for one another."""
    out = qc.run_checks(_spoiled(spark, sf_dir), tuple(c for c in qc.BUILTIN if c.name != "stale_position"), arrival="event_id")
    return out.select("event_id", F.array_join("qc_flags", ",").alias("flags"), "qc_severity", F.round("confidence_score", 6).alias("confidence_score"))


@_query("SELECT event_id, CASE event_id % 17 WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'At anchor' WHEN 2 THEN 'Not under command' WHEN 3 THEN 'Restricted maneuverability' WHEN 4 THEN 'Constrained by draught' WHEN 5 THEN 'Moored' WHEN 6 THEN 'Aground' WHEN 7 THEN 'Engaged in fishing' WHEN 8 THEN 'Under way sailing' WHEN 9 THEN 'Reserved for HSC' WHEN 10 THEN 'Reserved for WIG' WHEN 14 THEN 'AIS-SART' WHEN 15 THEN 'Not defined' END AS nav_status FROM events")
def nav_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", nav_status(F.col("event_id") % 17).alias("nav_status"))


# --- feeds: the table seen as raw messages, read back by each source's rules


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_HEADING = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 360)::DOUBLE END"


@_query(f"""
    SELECT event_id::VARCHAR AS source_file, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 200000000 + user_id END AS mmsi, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS timestamp,
           value AS sog, {_HEADING} AS heading, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'IMO' || event_id END AS imo, CASE event_id % 4 WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'At anchor' END AS nav_status, nullif(trim(event_type), '') AS vessel_name
    FROM events
""")
def feed_noaa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources import noaa

    text = {c: F.lit(None).cast("string") for c in noaa.COLUMNS.values()}
    text |= {
        "source_file": F.col("event_id").cast("string"), "mmsi": F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("user_id") + 200000000).cast("string")),
        "timestamp": F.when(F.col("event_id") % 7 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "sog": F.col("value").cast("string"),
        "heading": F.when(F.col("event_id") % 5 == 0, "511.0").otherwise((F.col("event_id") % 360).cast("string")), "imo": F.when(F.col("event_id") % 3 == 0, "IMO0000000").otherwise(F.concat(F.lit("IMO"), "event_id")),
        "nav_status": F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("12"), F.lit("99")), (F.col("event_id") % 4 + 1).cast("int")), "vessel_name": F.concat(F.lit(" "), "event_type", F.lit(" ")),
    }
    out = noaa.normalize(_raw(spark, sf_dir).select([v.alias(k) for k, v in text.items()]))
    return _flat(out.select("source_file", "mmsi", "timestamp", "sog", "heading", "imo", "nav_status", "vessel_name"))


@_query(f"""
    SELECT event_id::VARCHAR AS source_file, 200000000 + user_id AS mmsi, epoch_us(date_trunc('second', ts)) AS timestamp, {_HEADING} AS heading,
           CASE event_id % 4 WHEN 3 THEN 'IMO' || event_id END AS imo, event_type AS ship_type FROM events WHERE ts::DATE = DATE '2024-01-10'
""")
def feed_dma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import date

    from wakeline.sources import dma

    text = {c: F.lit(None).cast("string") for c in dma.COLUMNS.values()}
    text |= {
        "source_file": F.col("event_id").cast("string"), "mmsi": (F.col("user_id") + 200000000).cast("string"), "timestamp": F.date_format("ts", "dd/MM/yyyy HH:mm:ss"),
        "heading": F.when(F.col("event_id") % 5 == 0, "511").otherwise((F.col("event_id") % 360).cast("string")),
        "imo": F.element_at(F.array(F.lit("0"), F.lit(""), F.lit("Unknown"), F.concat(F.lit("IMO"), F.col("event_id"))), (F.col("event_id") % 4 + 1).cast("int")), "ship_type": F.col("event_type"),
    }
    out = dma.normalize(_raw(spark, sf_dir).select([v.alias(k) for k, v in text.items()]), date(2024, 1, 10))
    return _flat(out.select("source_file", "mmsi", "timestamp", "heading", "imo", "ship_type"))


@_query(f"""
    SELECT event_id::VARCHAR AS source_file, 200000000 + user_id AS mmsi, epoch_us(date_trunc('second', ts)) AS timestamp, {_HEADING} AS heading, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 50 + event_id % 70)::DOUBLE END AS length, event_type AS vessel_name
    FROM events
""")
def feed_aishub(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources import aishub

    item = F.struct(
        (F.col("user_id") + 200000000).alias("MMSI"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT")).alias("TIME"), F.when(F.col("event_id") % 5 == 0, 511).otherwise(F.col("event_id") % 360).alias("HEADING"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50).alias("A"), (F.col("event_id") % 70).alias("B"), F.concat("event_type", F.lit(" ")).alias("NAME"),
    )
    document = F.concat(F.lit('[{"ERROR":false},['), F.to_json(item), F.lit("]]"))
    raw = _raw(spark, sf_dir).select(F.col("event_id").cast("string").alias("source_file"), F.explode(aishub.records(document)).alias("r"))
    return _flat(aishub.normalize(raw).select("source_file", "mmsi", "timestamp", "heading", "length", "vessel_name"))


@_query("""
    SELECT event_id::VARCHAR AS event_id, CASE event_type WHEN 'click' THEN 'fishing' WHEN 'purchase' THEN 'port_call' WHEN 'view' THEN 'encounter' ELSE 'loitering' END AS event_type, 200000000 + user_id AS mmsi,
           CASE WHEN event_id % 2 = 0 THEN 300000000 + user_id END AS other_mmsi, epoch_us(date_trunc('second', ts)) AS start_time, epoch_us(date_trunc('second', ts)) + 3600000000 AS end_time, 1.0::DOUBLE AS confidence_score, 'gfw:events_api' AS record_provenance
    FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0
""")
def feed_gfw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources import gfw

    kind = F.when(F.col("event_type") == "click", "fishing").when(F.col("event_type") == "purchase", "PORT_VISIT").when(F.col("event_type") == "view", "ENCOUNTER").otherwise("LOITERING")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    ssvid = lambda base: (F.col("user_id") + base).cast("string")
    raw = _raw(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 9 == 0, "GAP").otherwise(kind).alias("type"), iso("ts").alias("start"), F.when(F.col("event_id") % 10 != 0, iso(F.col("ts") + F.expr("INTERVAL 1 HOUR"))).alias("end"),
        F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).alias("position"), F.struct(ssvid(200000000).alias("ssvid")).alias("vessel"), F.struct(F.struct(F.when(F.col("event_id") % 2 == 0, ssvid(300000000)).alias("ssvid")).alias("vessel")).alias("encounter"),
    )
    out = gfw.events(raw).select("event_id", "event_type", "mmsi", "other_mmsi", "start_time", "end_time", "confidence_score", "record_provenance")
    return _flat(out)


@_query(f"SELECT 200000000 + user_id AS mmsi, epoch_us(date_trunc('second', ts)) AS timestamp, value AS sog, {_HEADING} AS heading, CASE event_id % 3 WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'At anchor' ELSE 'Not under command' END AS nav_status, event_type AS vessel_name FROM events WHERE event_id % 6 <> 0")
def feed_aisstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources import aisstream

    meta = F.struct((F.col("user_id") + 200000000).alias("MMSI"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC")).alias("time_utc"), F.concat("event_type", F.lit("  ")).alias("ShipName"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    report = F.struct(F.col("value").alias("Sog"), F.lit(1.0).alias("Cog"), F.when(F.col("event_id") % 5 == 0, 511.0).otherwise((F.col("event_id") % 360).cast("double")).alias("TrueHeading"), (F.col("event_id") % 3).alias("NavigationalStatus"))
    raw = _raw(spark, sf_dir).select(F.to_json(F.struct(F.when(F.col("event_id") % 6 == 0, "StaticDataReport").otherwise("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))).alias("value"))
    return _flat(aisstream.normalize(raw).select("mmsi", "timestamp", "sog", "heading", "nav_status", "vessel_name"))


@_query(f"""
    SELECT 200000000 + user_id AS mmsi, epoch_us(date_trunc('second', ts)) AS timestamp, 'location' AS kind, {_HEADING} AS heading, NULL::DOUBLE AS draught FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 200000000 + user_id, epoch_us(date_trunc('second', ts)), 'metadata', NULL, (event_id % 200) / 10.0::DOUBLE FROM events WHERE event_id % 2 = 1
""")
def feed_finland(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources import finland

    odd = F.col("event_id") % 2 == 1
    topic = F.concat(F.lit("vessels-v2/"), F.col("user_id") + 200000000, F.when(odd, "/metadata").otherwise("/location"))
    place = F.to_json(F.struct(F.unix_seconds("ts").alias("time"), F.lit(25.0).alias("lon"), F.lit(60.0).alias("lat"), F.when(F.col("event_id") % 5 == 0, 511).otherwise(F.col("event_id") % 360).alias("heading")))
    about = F.to_json(F.struct((F.unix_seconds("ts") * 1000).alias("timestamp"), (F.col("event_id") % 200).alias("draught")))
    raw = _raw(spark, sf_dir).select(topic.alias("topic"), F.when(odd, about).otherwise(place).alias("value"))
    one = finland.locations(raw).select("mmsi", "timestamp", F.lit("location").alias("kind"), "heading", F.lit(None).cast("double").alias("draught"))
    return _flat(one.union(finland.metadata(raw).select("mmsi", "timestamp", F.lit("metadata"), F.lit(None).cast("double"), "draught")))


@_query(f"""
    WITH {POS} SELECT mmsi, arg_max(vessel_name, (timestamp, lat, lon)) FILTER (vessel_name IS NOT NULL) AS vessel_name, arg_max(ship_type, (timestamp, lat, lon)) AS ship_type,
           epoch_us(min(timestamp)) AS first_seen, epoch_us(max(timestamp)) AS last_seen, source, source || ':positions' AS record_provenance FROM p GROUP BY mmsi, source
""")
def vessel_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.sources.base import extract_vessels

    each = [extract_vessels(rows, source) for source, rows in _sources(spark, sf_dir).items()]
    out = each[0].union(each[1]).union(each[2])
    return _flat(out.select("mmsi", "vessel_name", "ship_type", "first_seen", "last_seen", "source", "record_provenance"))


# --- streams, as batches of their operators


@_query(f"WITH {POS}, d AS (SELECT mmsi, timestamp, lat, lon, event_id + 1000000 * k AS event_id FROM p, range(2) r(k)), r AS (SELECT *, row_number() OVER (PARTITION BY mmsi, timestamp, lat, lon ORDER BY event_id DESC) AS n FROM d) SELECT mmsi, epoch_us(timestamp) AS timestamp, lat, lon, event_id FROM r WHERE n = 1")
def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.streaming.dedup import compact

    rows = positions(spark, sf_dir).select("mmsi", "timestamp", "lat", "lon", "event_id")
    return _flat(compact(rows.union(rows.withColumn("event_id", F.col("event_id") + 1_000_000)), "event_id"))


@_query(f"WITH {POS}, d AS (SELECT DISTINCT mmsi, timestamp, lat, lon FROM p) SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS record_count, count(DISTINCT mmsi) AS distinct_mmsi_count, epoch_us(min(timestamp)) AS min_timestamp, epoch_us(max(timestamp)) AS max_timestamp, min(lon) AS west, max(lat) AS north FROM d GROUP BY 1")
def partition_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests of promoted partitions hold, for all days in one grouping."""
    rows = positions(spark, sf_dir).dropDuplicates(["mmsi", "timestamp", "lat", "lon"])
    return rows.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("date")).agg(
        F.count("*").alias("record_count"), F.count_distinct("mmsi").alias("distinct_mmsi_count"), micros(F.min("timestamp")).alias("min_timestamp"), micros(F.max("timestamp")).alias("max_timestamp"), F.min("lon").alias("west"), F.max("lat").alias("north")
    )


@_query("WITH w AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events), s AS (SELECT *, sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM w) SELECT user_id, epoch_us(min(ts)) AS start_time, epoch_us(max(ts)) AS end_time, count(*) AS points FROM s GROUP BY user_id, run")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows part runs as gaps do; the microsecond keeps fixes that lie a gap apart together."""
    gap = "6 hours 1 microsecond"
    rows = _raw(spark, sf_dir).groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("points"))
    return _flat(rows.select("user_id", "start_time", "end_time", "points"))


# --- the store: partitions written, named in manifests, and read again


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="wakeline-store-")


def _fleet(spark: SparkSession, sf_dir: str, **more):
    """A store with a partition of positions for each source; those of dma were checked."""
    from wakeline.plans.api import Fleet
    from wakeline.plans.store import write_partition

    root = _scratch(spark)
    for source, rows in _sources(spark, sf_dir).items():
        rows = qc.run_checks(rows.withColumn("sog", F.col("sog") * 12), mode="declared" if source == "dma" else "off")
        write_partition(DATASETS["positions"].conform(rows.withColumn("record_provenance", F.lit(f"{source}:direct"))), root, "positions", source, "2024-01-15", checks_applied=["sog_range"] if source == "dma" else [])
    return Fleet(spark, root, ("2024-01-10", "2024-01-20"), ["noaa", "dma", "aishub"], **more)


_STORED = f"{POS}, c AS (SELECT * REPLACE (sog * 12 AS sog) FROM p)"
_STORE_QC = f"""
    l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM c WHERE source = 'dma' WINDOW w AS (PARTITION BY mmsi ORDER BY {ORDER})),
    v AS (SELECT *, coalesce(sog NOT BETWEEN 0 AND 102.3 OR (pt < timestamp AND {_METRES.format(a='', b='p', at='lat')} / ((epoch_us(timestamp) - epoch_us(pt)) / 1e6::DOUBLE) > 50.0 * 1852.0::DOUBLE / 3600.0), FALSE) AS odd FROM l)
"""


@_query(f"WITH {POS} SELECT mmsi, epoch_us(timestamp) AS timestamp, lat, lon, sog * 12 AS sog, source, vessel_name, ship_type FROM p")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were written and are found again through manifests."""
    out = _fleet(spark, sf_dir).catalog.scan("positions", None, "2024-01-15", "2024-01-15")
    return _flat(out.select("mmsi", "timestamp", "lat", "lon", "sog", "source", "vessel_name", "ship_type"))


@_query(f"WITH {POS} SELECT 'positions' AS dataset, source, 1::BIGINT AS partitions, count(*) AS rows, count(DISTINCT mmsi) AS vessels, '2024-01-15' AS date_from, '2024-01-15' AS date_to FROM p GROUP BY source")
def store_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fleet(spark, sf_dir).inventory()


@_query(f"""
    WITH {_STORED}, {_STORE_QC}, w AS (SELECT count(*) FILTER (odd) AS odd FROM v)
    SELECT source, count(*) AS record_count, count(DISTINCT mmsi) AS distinct_mmsi_count, epoch_us(min(timestamp)) AS min_timestamp, epoch_us(max(timestamp)) AS max_timestamp, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north,
           count(*) - (CASE WHEN source = 'dma' THEN (SELECT odd FROM w) ELSE 0 END) AS rows_ok, CASE WHEN source = 'dma' THEN (SELECT odd FROM w) ELSE 0 END AS rows_warning FROM c GROUP BY source
""")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What manifests say of their partitions."""
    made = _fleet(spark, sf_dir).catalog.manifests
    rows = [(m.source, m.record_count, m.distinct_mmsi_count, m.min_timestamp, m.max_timestamp, *m.bbox, m.rows_ok, m.rows_warning) for m in made]
    out = spark.createDataFrame(rows, "source string, record_count long, distinct_mmsi_count long, min_timestamp string, max_timestamp string, west double, south double, east double, north double, rows_ok long, rows_warning long")
    return out.withColumns({c: micros(F.col(c).cast("timestamp")) for c in ("min_timestamp", "max_timestamp")})


@_query(f"""
    WITH {_STORED}, {_STORE_QC} SELECT 'positions' AS dataset, 3::BIGINT AS partitions, (SELECT count(*) FROM p) AS rows, (SELECT count(*) FROM p) - count(*) FILTER (odd) AS rows_ok, count(*) FILTER (odd) AS rows_warning, 0::BIGINT AS rows_error, 'sog_range' AS checks, TRUE AS mixed_versions, FALSE AS can_rebuild FROM v
""")
def store_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report and the provenance of a store, in one row."""
    fleet = _fleet(spark, sf_dir)
    r, p = fleet.quality_report(), fleet.provenance()
    row = (r.dataset, r.partitions_scanned, r.total_rows, r.rows_ok, r.rows_warning, r.rows_error, ",".join(r.checks_applied), p["has_mixed_versions"], p["can_rebuild_locally"])
    return spark.createDataFrame([row], "dataset string, partitions long, rows long, rows_ok long, rows_warning long, rows_error long, checks string, mixed_versions boolean, can_rebuild boolean")


@_query(f"WITH {POS} SELECT source, count(*) AS n, count(DISTINCT mmsi) AS vessels, min(lat) AS south FROM p WHERE lat BETWEEN 50.5 AND 52.0 AND lon BETWEEN 2.5 AND 4.0 GROUP BY source")
def store_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the fused view of a store, within a box."""
    fleet = _fleet(spark, sf_dir, bbox=(2.5, 50.5, 4.0, 52.0))
    return fleet.sql("SELECT source, count(*) AS n, count(DISTINCT mmsi) AS vessels, min(lat) AS south FROM positions_fused GROUP BY source")


@_query(f"WITH {POS}, u AS (SELECT DISTINCT mmsi, timestamp, lat, lon, source FROM p) SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS rows, count(DISTINCT mmsi) AS vessels FROM u WHERE source = 'dma' GROUP BY 1")
def store_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch that lands twice under one number, and its promotion into days."""
    from wakeline.plans.catalog import Catalog
    from wakeline.streaming.sinks import ParquetSink, promote_landing

    root = _scratch(spark)
    sink, rows = ParquetSink(f"{root}/landing"), _sources(spark, sf_dir)["dma"].drop("event_id")
    for _ in range(2):
        sink(rows, 0)
    promote_landing(spark, f"{root}/store", f"{root}/landing", "dma")
    held = Catalog(spark, f"{root}/store").frame()
    return held.select("date", F.col("record_count").alias("rows"), F.col("distinct_mmsi_count").alias("vessels"))


# --- maps


@_query(f"WITH s AS ({_TRACK_SQL}) SELECT track_id, mmsi, round(duration_s / max(duration_s) OVER () + 1.3e-8::DOUBLE, 6) AS trip_progress FROM s WHERE bbox_west <= 4.0 AND bbox_east >= 2.5 AND bbox_south <= 52.0 AND bbox_north >= 50.5")
def map_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wakeline.viz import Viewport, prepare_trips

    config = tracks.TrackConfig(TRACKS.gap_seconds, TRACKS.max_speed_knots, include_geometry=True)
    made = tracks.build_tracks(positions(spark, sf_dir), config)
    trips = prepare_trips(made, Viewport(2.5, 50.5, 4.0, 52.0))
    plain = tracks.build_tracks(positions(spark, sf_dir), TRACKS).select("track_id", "mmsi", "start_time", "source")
    out = trips.drop("track_id").join(plain, ["mmsi", "start_time", "source"])
    return _flat(out.select("track_id", "mmsi", "trip_progress"), "trip_progress")


# --- joins and the SQL surface


@_query(f"WITH {POS}, s AS ({_LOITERING_SQL}) SELECT p.event_id AS fix, s.event_id FROM p JOIN s ON p.mmsi = s.mmsi AND epoch_us(p.timestamp) BETWEEN s.start_time AND s.end_time")
def fixes_in_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of a vessel while one of its events lasts: an equality join with an interval condition."""
    found = events.detect_loitering(positions(spark, sf_dir), LOITERING).select("event_id", "mmsi", "start_time", "end_time")
    rows = positions(spark, sf_dir).withColumnRenamed("event_id", "fix")
    return rows.join(found, "mmsi").where(F.col("timestamp").between(F.col("start_time"), F.col("end_time"))).select("fix", "event_id")


@_query(f"WITH {POS}, n AS (SELECT * FROM p WHERE source = 'noaa'), d AS (SELECT * FROM p WHERE source = 'dma') SELECT n.event_id, d.event_id AS before_id FROM n ASOF LEFT JOIN d ON n.mmsi = d.mmsi AND n.timestamp >= d.timestamp")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fix of one source the last one before it of another: a union, and the last value over a window."""
    from pyspark.sql import Window

    rows = positions(spark, sf_dir).where("source IN ('noaa', 'dma')")
    line = Window.partitionBy("mmsi").orderBy("timestamp", F.col("source") == "noaa").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("source") == "dma", F.col("event_id")), ignorenulls=True).over(line)
    return rows.withColumn("before_id", last).where("source = 'noaa'").select("event_id", "before_id")


SQL = {
    "sql_avg_speed_by_type": "SELECT ship_type, round(avg(sog), 6) AS avg_sog, count(*) AS n FROM positions GROUP BY ship_type",
    "sql_rollup": "SELECT source, ship_type, grouping(source) + grouping(ship_type) AS level, count(*) AS n FROM positions GROUP BY ROLLUP (source, ship_type)",
    "sql_cube": "SELECT source, ship_type, count(DISTINCT mmsi) AS vessels FROM positions GROUP BY CUBE (source, ship_type)",
    "sql_windows": "SELECT event_id, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp, event_id) AS n, ntile(4) OVER (PARTITION BY mmsi ORDER BY timestamp, event_id) AS quarter, dense_rank() OVER (PARTITION BY source ORDER BY mmsi) AS d FROM positions",
    "sql_set_operations": "SELECT mmsi FROM positions WHERE source = 'noaa' INTERSECT SELECT mmsi FROM positions WHERE source = 'dma' EXCEPT SELECT mmsi FROM positions WHERE sog > 19.5",
    "sql_semi_anti": "SELECT DISTINCT mmsi FROM positions p WHERE EXISTS (SELECT 1 FROM positions q WHERE q.mmsi = p.mmsi AND q.sog > 15) AND NOT EXISTS (SELECT 1 FROM positions q WHERE q.mmsi = p.mmsi AND q.sog > 18)",
    "sql_full_join": "SELECT coalesce(a.mmsi, b.mmsi) AS mmsi, a.n AS slow, b.n AS quick FROM (SELECT mmsi, count(*) AS n FROM positions WHERE sog < 0.05 GROUP BY mmsi) a FULL OUTER JOIN (SELECT mmsi, count(*) AS n FROM positions WHERE sog > 12 GROUP BY mmsi) b ON a.mmsi = b.mmsi",
    "sql_filtered_aggregates": "SELECT mmsi, count(*) FILTER (WHERE source = 'noaa') AS noaa, max(sog) FILTER (WHERE source = 'dma') AS dma_max FROM positions GROUP BY mmsi HAVING count(*) > 20",
}


def _sql_query(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        positions(spark, sf_dir).createOrReplaceTempView("positions")
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {POS}, positions AS (SELECT * FROM p) {text}"


for _name, _text in SQL.items():
    _sql_query(_name, _text)
