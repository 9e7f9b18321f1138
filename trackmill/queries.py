"""The trajectory queries and their DuckDB equivalents.

Every query runs over whole tables. Floats are rounded in both engines, to millimetres or millionths.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .fixtures import AREAS, POINTS, ROADS
from .functions import geo, text
from .operators import correction, filters, matching, roads, stateful
from .operators import sequence as seq
from .plans import service
from .sources import readers, sinks, workspace

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
W = "PARTITION BY day, plate_number ORDER BY datetime, event_id"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def on_points(body: str, *more: str) -> str:
    return f"WITH {', '.join([POINTS, *more])} {body}"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000e0 * asin(sqrt(power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({d}) - ({b})) / 2), 2))))"


def course(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))"
    return f"(({x} + 360e0) % 360e0)"


def turn(x: str) -> str:
    return f"(CASE WHEN abs({x}) > 180 THEN 360 - abs({x}) ELSE abs({x}) END)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.gps_points(spark, sf_dir)


def r(c, n: int = 3):
    return F.round(c, n)


# ------------------------------------------------------------------ reads and filters


@query(on_points("SELECT event_id, plate_number, day, t_sec, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, speed, heading, CAST(location_flag AS INTEGER) AS location_flag, road_id, road_type FROM gps_points"))
def gps_points_projection(spark, d):
    return points(spark, d).select("event_id", "plate_number", "day", "t_sec", r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"), "speed", "heading", "location_flag", "road_id", "road_type")


@query(on_points("SELECT plate_number, count(*) AS n FROM gps_points WHERE location_flag = 1 GROUP BY plate_number"))
def valid_fix_filter(spark, d):
    return points(spark, d).withColumn("is_valid", F.col("location_flag") == 1).where(filters.valid_fix()).groupBy("plate_number").agg(F.count("*").alias("n"))


@query(on_points("SELECT event_id, t_sec, speed FROM gps_points WHERE plate_number = 'B0007'"))
def plate_lookup(spark, d):
    return service.by_plate(points(spark, d), "B0007").select("event_id", "t_sec", "speed")


@query(on_points("SELECT event_id, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at FROM gps_points WHERE plate_number = 'B0012' AND datetime >= TIMESTAMP '2016-08-31 00:00:00' AND datetime <= TIMESTAMP '2016-08-31 23:59:59'"))
def plate_date_range(spark, d):
    return service.by_plate(points(spark, d), "B0012", "2016-08-31", "2016-08-31").select("event_id", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(on_points("SELECT event_id, day FROM gps_points p WHERE plate_number = 'B0003' AND day = (SELECT min(day) FROM gps_points WHERE plate_number = 'B0003') AND datetime BETWEEN TIMESTAMP '2016-08-31 00:02:00' AND TIMESTAMP '2016-08-31 00:10:00'"))
def single_vehicle_range(spark, d):
    return service.single_vehicle(points(spark, d), "B0003", "2016-08-31 00:02:00", "2016-08-31 00:10:00").select("event_id", "day")


@query(on_points("SELECT plate_number, count(*) AS n FROM gps_points WHERE plate_number IN (SELECT DISTINCT plate_number FROM gps_points ORDER BY 1 LIMIT 4 OFFSET (least(3, greatest(1, CAST(ceil((SELECT count(DISTINCT plate_number) FROM gps_points) / 4.0) AS BIGINT))) - 1) * 4) GROUP BY plate_number"))
def vehicle_page(spark, d):
    return service.vehicle_page(points(spark, d), 3, 4).groupBy("plate_number").agg(F.count("*").alias("n"))


@query(on_points("SELECT DISTINCT plate_number FROM gps_points"))
def distinct_plates(spark, d):
    return service.plates(points(spark, d), None)


@query(on_points("SELECT plate_number, count(*) AS point_count, strftime(min(datetime), '%H:%M:%S') AS start_time, strftime(max(datetime), '%H:%M:%S') AS end_time, round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat FROM gps_points GROUP BY plate_number"))
def vehicle_summary(spark, d):
    s = service.summary(points(spark, d))
    return s.select("plate_number", "point_count", *[F.date_format(c, "HH:mm:ss").alias(c) for c in ("start_time", "end_time")], *[r(c, 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query(on_points("SELECT event_id, plate_number FROM gps_points WHERE (day, plate_number) = (SELECT (day, plate_number) FROM gps_points ORDER BY day, plate_number LIMIT 1)"))
def first_vehicle(spark, d):
    return service.first_vehicle(points(spark, d)).select("event_id", "plate_number")


@query(on_points("SELECT event_id FROM gps_points WHERE latitude BETWEEN 22.55e0 AND 22.62e0 AND longitude BETWEEN 113.95e0 AND 114.1e0"))
def bbox_filter(spark, d):
    return points(spark, d).where(filters.in_box(22.55, 22.62, 113.95, 114.1)).select("event_id")


def _inside(rings) -> str:
    """Crossings as a sum over a ring's edges, written out."""

    def one(ring):
        edges = zip(ring, ring[1:] + ring[:1], strict=True)
        return " + ".join(f"CASE WHEN ({y1}e0 > latitude) <> ({y2}e0 > latitude) AND longitude < ({x2}e0 - {x1}e0) * (latitude - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges if y1 != y2)

    return "(" + " OR ".join(f"({one(list(ring))}) % 2 = 1" for ring in rings) + ")"


@query(on_points(" UNION ALL ".join(f"SELECT '{k}' AS area, event_id FROM gps_points WHERE {_inside(v)}" for k, v in AREAS.items())))
def area_filter(spark, d):
    p = points(spark, d)
    found = [p.where(filters.in_area(rings)).select(F.lit(k).alias("area"), "event_id") for k, rings in AREAS.items()]
    return found[0].union(found[1]).union(found[2])


_OUTER, _HOLE = [(113.9, 22.5), (114.2, 22.5), (114.2, 22.7), (113.9, 22.7)], [(114.0, 22.55), (114.1, 22.55), (114.1, 22.65), (114.0, 22.65)]


@query(on_points(f"SELECT event_id FROM gps_points WHERE {_inside([_OUTER])} AND NOT {_inside([_HOLE])}"))
def wkt_filter(spark, d):
    ring = lambda x: "(" + ", ".join(f"{a} {b}" for a, b in [*x, x[0]]) + ")"
    return points(spark, d).where(filters.in_wkt(f"POLYGON({ring(_OUTER)}, {ring(_HOLE)})")).select("event_id")


@query(on_points("SELECT event_id, longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AS ok_coordinate, speed BETWEEN 0 AND 200 AS ok_speed, heading BETWEEN 0 AND 360 AS ok_direction, latitude BETWEEN 3.86e0 AND 53.55e0 AND longitude BETWEEN 73.66e0 AND 135.05e0 AS in_country FROM gps_points"))
def coordinate_validation(spark, d):
    return filters.checks(points(spark, d)).select("event_id", "ok_coordinate", "ok_speed", "ok_direction", filters.in_china().alias("in_country"))


@query(on_points("SELECT event_id, speed FROM gps_points WHERE speed <= 200"))
def overspeed_filter(spark, d):
    return points(spark, d).where(filters.plausible_speed()).select("event_id", "speed")


# -------------------------------------------------------------------------- functions

_LAG = f"lag(latitude) OVER ({W}) AS a, lag(longitude) OVER ({W}) AS b"


@query(on_points(f"SELECT event_id, round(coalesce({hav('a', 'b', 'latitude', 'longitude')}, 0), 3) AS metres FROM (SELECT *, {_LAG} FROM gps_points)"))
def haversine_steps(spark, d):
    return seq.steps(points(spark, d), geo.haversine).select("event_id", r("step_m").alias("metres"))


@query(on_points(f"SELECT event_id, round({course('a', 'b', 'latitude', 'longitude')}, 6) AS bearing FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NOT NULL AND (a <> latitude OR b <> longitude)"))
def bearing_steps(spark, d):
    p = points(spark, d).withColumns({"a": seq.prev("latitude"), "b": seq.prev("longitude")})
    return p.where("a IS NOT NULL AND (a <> latitude OR b <> longitude)").select("event_id", r(geo.bearing("a", "b", "latitude", "longitude"), 6).alias("bearing"))


_MID = "cos(radians(latitude)) * cos(radians(longitude - b))", "cos(radians(latitude)) * sin(radians(longitude - b))"


@query(on_points(f"SELECT event_id, round(degrees(atan2(sin(radians(a)) + sin(radians(latitude)), sqrt(power(cos(radians(a)) + x, 2) + y * y))), 6) AS lat, round(b + degrees(atan2(y, cos(radians(a)) + x)), 6) AS lon FROM (SELECT *, {_MID[0]} AS x, {_MID[1]} AS y FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NOT NULL)"))
def midpoints(spark, d):
    p = points(spark, d).withColumns({"a": seq.prev("latitude"), "b": seq.prev("longitude")}).where("a IS NOT NULL").withColumn("m", geo.midpoint("a", "b", "latitude", "longitude"))
    return p.select("event_id", r("m.lat", 6).alias("lat"), r("m.lon", 6).alias("lon"))


@query(on_points("SELECT event_id, round(longitude * 20037508.34e0 / 180, 2) AS x, round(ln(tan((latitude + 90e0) * pi() / 360)) / (pi() / 180) * 20037508.34e0 / 180, 2) AS y, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM gps_points"))
def mercator_roundtrip(spark, d):
    p = points(spark, d).withColumn("m", geo.to_mercator("latitude", "longitude")).withColumn("b", geo.from_mercator("m.x", "m.y"))
    return p.select("event_id", r("m.x", 2).alias("x"), r("m.y", 2).alias("y"), r("b.lat", 6).alias("lat"), r("b.lon", 6).alias("lon"))


def _ellipsoid(source: str) -> str:
    """CTEs that end in `ell`: event_id and metres on the ellipsoid from (a, b), by a fixed number of iterations; the fixture's steps settle sooner."""
    f, minor = "(1 / 298.257223563e0)", "(6378137e0 * (1 - 1 / 298.257223563e0))"
    out = [f"e0 AS (SELECT event_id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, gap, gap AS lam FROM (SELECT event_id, atan(tan(radians(a)) * (1 - {f})) AS u1, atan(tan(radians(latitude)) * (1 - {f})) AS u2, radians(longitude - b) AS gap FROM {source} WHERE a IS NOT NULL))"]
    for i in range(1, 8):
        x1 = f"SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS si, s1 * s2 + c1 * c2 * cos(lam) AS co FROM e{i - 1}"
        x2 = f"SELECT *, atan2(si, co) AS arc, CASE WHEN si = 0 THEN 0 ELSE c1 * c2 * sin(lam) / si END AS sa FROM ({x1})"
        x3 = f"SELECT *, CASE WHEN sa * sa = 1 THEN 0 ELSE co - 2 * s1 * s2 / (1 - sa * sa) END AS mid, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS k FROM ({x2})"
        last = ", si, co, arc, 1 - sa * sa AS cc, mid" if i == 7 else ""
        x4 = f"SELECT *, gap + (1 - k) * {f} * sa * (arc + k * si * (mid + k * co * (2 * mid * mid - 1))) AS new FROM ({x3})"
        # what has settled stays
        out.append(f"e{i} AS (SELECT event_id, s1, c1, s2, c2, gap, CASE WHEN abs(new - lam) <= 1e-12 THEN lam ELSE new END AS lam{last} FROM ({x4}))")
    uu = f"cc * ((6378137e0 * 6378137e0 - {minor} * {minor}) / ({minor} * {minor}))"
    out.append(f"ell AS (SELECT event_id, CASE WHEN si = 0 THEN 0 ELSE {minor} * big * (arc - small * si * (mid + small / 4 * (co * (2 * mid * mid - 1) - small / 6 * mid * (4 * si * si - 3) * (4 * mid * mid - 3)))) END AS metres FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768)) AS big, uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128)) AS small FROM (SELECT *, {uu} AS uu FROM e7)))")
    return ", ".join(out)


@query(on_points("SELECT event_id, round(coalesce(metres, 0), 3) AS metres FROM gps_points LEFT JOIN ell USING (event_id)", f"before AS (SELECT *, {_LAG} FROM gps_points)", _ellipsoid("before")))
def vincenty_steps(spark, d):
    return seq.steps(points(spark, d)).select("event_id", r("step_m").alias("metres"))


def _boxes(points: DataFrame, *keys: str) -> DataFrame:
    """The box of the positions of each key, as a ring of four corners."""
    lo, hi = F.min, F.max
    b = points.groupBy(*keys).agg(lo("longitude").alias("x1"), hi("longitude").alias("x2"), lo("latitude").alias("y1"), hi("latitude").alias("y2"))
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    return b.select(*keys, corners.alias("ring"))


_BOX = "SELECT {0}, min(longitude) AS x1, max(longitude) AS x2, min(latitude) AS y1, max(latitude) AS y2 FROM gps_points GROUP BY {0}"


@query(on_points(f"SELECT plate_number, round(abs(radians(x2 - x1) * (2 + 2 * sin(radians(y1))) + radians(x1 - x2) * (2 + 2 * sin(radians(y2)))) * 6371000e0 * 6371000e0 / 2 / 1000) AS thousand_m2, round((x1 + x2) / 2, 6) AS lon, round((y1 + y2) / 2, 6) AS lat FROM ({_BOX.format('plate_number')})"))
def polygon_area(spark, d):
    """Of the box in which each vehicle moved."""
    rings = _boxes(points(spark, d), "plate_number").withColumn("m", geo.ring_mean(F.col("ring")))
    return rings.select("plate_number", F.round(geo.shoelace_sphere(F.col("ring")) / 1000).alias("thousand_m2"), r("m.lon", 6).alias("lon"), r("m.lat", 6).alias("lat"))


#: one first line for each kind of file, by event type
_LINES = ["a,b,c,d,e,f,g,h,i,j", "card 12T30", "9,21", ",".join("abcdefghijklmnopqr"), ",".join("abcdefghijk"), '<?xml version="1.0" encoding="UTF-8"?>', "x;y"]


@query("WITH l AS (SELECT event_id, (" + repr(_LINES) + ")[event_id % 7 + 1] AS line FROM events) SELECT event_id, CASE WHEN ltrim(line) LIKE '<?xml%' THEN 'gpx' WHEN len(string_split(line, ',')) = 10 THEN 'taxi_gps' WHEN contains(line, ' ') AND contains(line, 'T') THEN 'bus_card' WHEN contains(line, ',') AND (contains(line, '21') OR contains(line, '22')) THEN 'metro_card' WHEN len(string_split(line, ',')) > 15 THEN 'bus_gps' WHEN len(string_split(line, ',')) = 11 THEN 'taxi_transaction' ELSE 'csv' END AS kind FROM l")
def format_detect(spark, d):
    line = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("event_id") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.detect_format(line).alias("kind"))


@query(on_points("SELECT event_id, CASE WHEN m < 1000 THEN printf('%.1f米', m) ELSE printf('%.2f公里', m / 1000) END AS far, CASE WHEN s >= 3600 THEN printf('%d小时%d分钟', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%d分钟%d秒', s // 60, s % 60) ELSE printf('%d秒', s) END AS long FROM (SELECT event_id, CAST(event_id % 9000 AS DOUBLE) * 0.36137e0 AS m, t_sec * 3 AS s FROM gps_points)"))
def formatted(spark, d):
    p = points(spark, d)
    return p.select("event_id", text.distance_text((F.col("event_id") % 9000).cast("double") * 0.36137).alias("far"), text.duration_text(F.col("t_sec") * 3).alias("long"))


# --------------------------------------------------------------------------- sequences


@query(on_points(f"SELECT plate_number, day, round(sum(coalesce({hav('a', 'b', 'latitude', 'longitude')}, 0)), 2) AS metres FROM (SELECT *, {_LAG} FROM gps_points) GROUP BY plate_number, day"))
def total_distance(spark, d):
    return seq.steps(points(spark, d), geo.haversine).groupBy("plate_number", "day").agg(r(F.sum("step_m"), 2).alias("metres"))


@query(on_points(f"SELECT event_id, round(CASE WHEN s > 0 THEN {hav('a', 'b', 'latitude', 'longitude')} / s * 3.6e0 ELSE speed END, 3) AS speed FROM (SELECT *, {_LAG}, t_sec - lag(t_sec) OVER ({W}) AS s FROM gps_points)"))
def derived_speed(spark, d):
    return seq.derived_speed(points(spark, d)).select("event_id", r("speed").alias("speed"))


_LEADS = f"SELECT *, lead(latitude) OVER ({W}) AS a, lead(longitude) OVER ({W}) AS b, lead(event_id) OVER ({W}) AS nxt FROM"


@query(on_points(f"SELECT day, plate_number, count(*) AS point_count, round(coalesce(sum({hav('latitude', 'longitude', 'a', 'b')}), 0), 2) AS metres, round(coalesce(avg(CASE WHEN nxt IS NOT NULL AND speed BETWEEN 0 AND 200 THEN speed END), 0), 3) AS avg_speed, round(coalesce(max(CASE WHEN nxt IS NOT NULL AND speed BETWEEN 0 AND 200 THEN speed END), 0), 3) AS max_speed, round(coalesce(min(CASE WHEN nxt IS NOT NULL AND speed BETWEEN 0 AND 200 THEN speed END), 0), 3) AS min_speed FROM ({_LEADS} gps_points) GROUP BY day, plate_number"))
def trajectory_stats(spark, d):
    s = correction.summary(points(spark, d))
    return s.select("day", "plate_number", "point_count", r("total_distance", 2).alias("metres"), r("average_speed").alias("avg_speed"), r("max_speed").alias("max_speed"), r("min_speed").alias("min_speed"))


@query(on_points(f"SELECT day, plate_number, round(CASE WHEN max(t_sec) > min(t_sec) THEN sum(coalesce({hav('a', 'b', 'latitude', 'longitude')}, 0)) / (max(t_sec) - min(t_sec)) * 3.6e0 ELSE 0 END, 3) AS average FROM (SELECT *, {_LAG} FROM gps_points) GROUP BY day, plate_number"))
def average_by_duration(spark, d):
    long = F.max("t_sec") - F.min("t_sec")
    return seq.steps(points(spark, d), geo.haversine).groupBy("day", "plate_number").agg(r(F.when(long > 0, F.sum("step_m") / long * 3.6).otherwise(0.0)).alias("average"))


_MOVED = f"SELECT * FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NULL OR abs(longitude - b) > 0.00001e0 OR abs(latitude - a) > 0.00001e0"


@query(on_points(f"SELECT event_id FROM ({_MOVED})"))
def dedupe_tolerance(spark, d):
    return seq.moved(points(spark, d)).select("event_id")


@query(on_points(f"SELECT event_id FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NULL OR NOT (abs(longitude - b) < 0.001e0 AND abs(latitude - a) < 0.0003e0 + 0.0007e0)"))
def dedupe_strict(spark, d):
    return seq.moved_strict(points(spark, d), 0.001).select("event_id")


@query(on_points(f"SELECT event_id FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NULL OR a <> latitude OR b <> longitude"))
def dedupe_exact(spark, d):
    return seq.changed(points(spark, d)).select("event_id")


@query(on_points(f"SELECT event_id FROM (SELECT *, {_LAG} FROM gps_points) WHERE a IS NULL OR {hav('a', 'b', 'latitude', 'longitude')} <= 1500"))
def jump_removal(spark, d):
    return seq.without_jumps(points(spark, d), 1500.0).select("event_id")


@query(on_points(f"SELECT event_id, round(CASE WHEN c = 5 AND n >= 5 THEN x ELSE latitude END, 6) AS lat, round(CASE WHEN c = 5 AND n >= 5 THEN y ELSE longitude END, 6) AS lon FROM (SELECT *, count(*) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c, count(*) OVER (PARTITION BY day, plate_number) AS n, avg(latitude) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x, avg(longitude) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM gps_points)"))
def moving_average(spark, d):
    return seq.smoothed(points(spark, d), 5).select("event_id", r("smooth_latitude", 6).alias("lat"), r("smooth_longitude", 6).alias("lon"))


_PLACES = f"(SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY day, plate_number) AS n FROM gps_points)"


@query(on_points(f"SELECT event_id FROM {_PLACES} WHERE n <= 8 OR i = 0 OR i = n - 1 OR (i % greatest(n // 8, 1) = 0 AND i < n - greatest(n // 8, 1))"))
def lod_sample(spark, d):
    return seq.level_of_detail(points(spark, d), 10).select("event_id")


@query(on_points(f"SELECT event_id FROM {_PLACES} WHERE i % greatest(n // 10, 1) = 0 AND i < n - 1"))
def waypoints(spark, d):
    return seq.waypoints(points(spark, d), 10).select("event_id")


@query(on_points(f"SELECT event_id, CAST(c AS INTEGER) AS chunk, CAST(i - c * 8 AS BIGINT) AS place FROM (SELECT *, unnest(range(greatest(CAST(ceil((i - 9) / 8.0) AS BIGINT), 0), i // 8 + 1)) AS c FROM {_PLACES})"))
def overlap_chunks(spark, d):
    return seq.chunks(points(spark, d), 10, 2).select("event_id", "chunk", F.col("place").cast("long").alias("place"))


@query(on_points(f"SELECT event_id, row_number() OVER ({W}) AS seq FROM gps_points"))
def chunks_stitched(spark, d):
    out = seq.stitched(seq.chunks(points(spark, d), 10, 2), 2)
    return seq.numbered(out).select("event_id", F.col("seq").cast("long").alias("seq"))


@query(on_points(f"SELECT event_id, now, CASE WHEN first THEN 0 ELSE {turn('now - before')} END AS delta FROM (SELECT *, lag(event_id) OVER ({W}) IS NULL AS first, lag(heading) OVER ({W}) AS before, CASE WHEN speed = 0 AND lag(event_id) OVER ({W}) IS NOT NULL THEN NULL ELSE heading END AS now FROM gps_points)"))
def heading_delta(spark, d):
    return seq.heading_deltas(points(spark, d)).select("event_id", F.col("heading_now").alias("now"), F.col("heading_delta").alias("delta"))


_KNOWN = "CASE WHEN road_id <> 'unknown' THEN road_id END"


@query(on_points("SELECT event_id, coalesce(" + ", ".join(f"{'lag' if n > 0 else 'lead'}(k, {abs(n)}) OVER ({W})" for n in (1, -1, 2, 3, -2, -3)) + f") AS context_road FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN {_KNOWN} END AS k FROM gps_points)"))
def road_context(spark, d):
    p = points(spark, d).withColumn("road_id", F.when(F.col("event_id") % 4 == 0, F.col("road_id")).otherwise("unknown"))
    return seq.road_context(p).select("event_id", "context_road")


def _far(n: int) -> str:
    at = lambda c: f"{'lag' if n > 0 else 'lead'}({c}, {abs(n)}) OVER ({W})"
    return f"coalesce(abs(t_sec - {at('t_sec')}) <= 60 AND {hav(at('latitude'), at('longitude'), 'latitude', 'longitude')} > 3000, false)"


@query(on_points("SELECT event_id FROM (SELECT *, " + " OR ".join(_far(n) for n in (1, 2, 3, -1, -2, -3)) + f" AS far, lag(event_id) OVER ({W}) IS NOT NULL AND lead(event_id) OVER ({W}) IS NOT NULL AS inner_ FROM gps_points) WHERE NOT (far AND inner_)"))
def temporal_distance_rule(spark, d):
    return seq.near_in_time(points(spark, d), 60, 3000.0).select("event_id")


@query(on_points("SELECT event_id FROM (SELECT *, " + ", ".join(f"{'lag' if n > 0 else 'lead'}(q, {abs(n)}) OVER ({W}) AS r{k}" for k, n in enumerate((2, 1, -1, -2))) + f", row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY day, plate_number) AS n FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN road_id ELSE 'main' END AS q FROM gps_points)) WHERE NOT (n >= 5 AND i >= 2 AND i <= n - 3 AND coalesce(len(list_filter([r0, r1, r2, r3], lambda x: x <> q AND len(list_filter([r0, r1, r2, r3], lambda y: y = x)) >= 3)) > 0, false))"))
def road_consistency_rule(spark, d):
    p = points(spark, d).withColumn("road_id", F.when(F.col("event_id") % 3 == 0, F.col("road_id")).otherwise("main"))
    return seq.consistent_roads(p).select("event_id")


@query(on_points(f"SELECT day, plate_number, count(*) AS point_count, arg_min(event_id, (datetime, event_id)) AS first_event, arg_max(event_id, (datetime, event_id)) AS last_event, round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat FROM ({_MOVED}) GROUP BY day, plate_number"))
def trajectory_build(spark, d):
    t = service.build(points(spark, d))
    return t.select("day", "plate_number", "point_count", "first_event", "last_event", *[r(f"bbox.{c}", 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query(on_points(f"SELECT event_id, row_number() OVER ({W}) AS seq FROM ({_MOVED})"))
def trajectory_flatten(spark, d):
    return service.flat(service.build(points(spark, d))).select("event_id", F.col("seq").cast("long").alias("seq"))


@query(on_points("SELECT count(DISTINCT plate_number) AS vehicles, count(*) AS points, count(DISTINCT (day, plate_number)) AS trajectories FROM gps_points"))
def vehicle_counts(spark, d):
    return points(spark, d).agg(F.countDistinct("plate_number").alias("vehicles"), F.count("*").alias("points"), F.countDistinct("day", "plate_number").alias("trajectories"))


@query(on_points("SELECT event_id FROM gps_points WHERE (day, plate_number) NOT IN (SELECT (day, plate_number) FROM gps_points WHERE user_id % 3 = 0)"))
def anti_join_new_plates(spark, d):
    p = points(spark, d)
    return service.new_plates(p, p.where("user_id % 3 = 0")).select("event_id")


@query("SELECT count(*) AS total, count(*) FILTER (s = 0) AS pending, count(*) FILTER (s = 1) AS processing, count(*) FILTER (s = 2) AS completed, count(*) FILTER (s = 3) AS failed, round(count(*) FILTER (s = 2) * 100.0e0 / count(*)) AS completion_percent FROM (SELECT event_id % 4 AS s FROM events)")
def task_completion(spark, d):
    status = F.element_at(F.array(*map(F.lit, ["pending", "processing", "completed", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    return service.completion(spark.read.parquet(f"{d}/events.parquet").select(status.alias("status")))


# --------------------------------------------------------------------------- correction

_CITY = "CASE WHEN v <= 60 THEN 1 - v / 60 * 0.2e0 WHEN v <= 80 THEN 0.8e0 - (v - 60) / 20 * 0.6e0 ELSE greatest(0e0, 0.2e0 - (v - 80) / 80) END"
_ROAD = "CASE WHEN v <= 120 THEN 1 - v / 120 * 0.3e0 WHEN v <= 150 THEN 0.7e0 - (v - 120) / 30 * 0.5e0 ELSE greatest(0e0, 0.2e0 - (v - 150) / 150) END"


def _head(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 1 ELSE greatest(0.5e0, CASE WHEN {x} <= 30 THEN 1 - {x} / 30 * 0.1e0 WHEN {x} <= 90 THEN 0.9e0 - ({x} - 30) / 60 * 0.2e0 WHEN {x} <= 150 THEN 0.7e0 - ({x} - 90) / 60 * 0.1e0 ELSE 0.6e0 - ({x} - 150) / 30 * 0.1e0 END) END)"


_SCORED = f"""
c0 AS (
  SELECT *, row_number() OVER ({W}) AS seq, {_LAG}, lag(t_sec) OVER ({W}) AS bt, lag(heading) OVER ({W}) AS bh, lag(speed) OVER ({W}) AS bs, lead(speed) OVER ({W}) AS ns FROM gps_points
), {_ellipsoid('c0')}, c1 AS (
  SELECT c0.*, metres FROM c0 LEFT JOIN ell USING (event_id)
), c2 AS (
  SELECT *, coalesce(abs(t_sec - bt), 0) AS s, coalesce(metres, 0) AS m, CASE WHEN speed = 0 AND seq > 1 THEN NULL ELSE heading END AS hn FROM c1
), c3 AS (
  SELECT *, CASE WHEN s > 0 THEN (m / 1000) / (s / 3600.0e0) ELSE 0 END AS v, CASE WHEN seq = 1 THEN 0 ELSE {turn('hn - bh')} END AS hd FROM c2
), c4 AS (
  SELECT *, lag(hd) OVER ({W}) AS bhd, CASE WHEN seq = 1 THEN 1 WHEN speed = 0 AND bs IS NOT NULL AND ns IS NOT NULL THEN 0.1e0 WHEN v < 0 THEN 0 WHEN road_id <> '' AND road_id <> 'null' THEN {_ROAD} ELSE {_CITY} END AS p FROM c3
), c5 AS (
  SELECT *, CASE WHEN p >= 0.6e0 THEN {{'seq': seq, 'road': road_id, 'lat': latitude, 'lon': longitude, 'hn': hn}} END AS o FROM c4
), c6 AS (
  SELECT *, last_value(o IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, first_value(o IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z,
         road_type IN ('motorway', 'trunk') AS hw FROM c5
), c7 AS (
  SELECT *, CASE WHEN hw THEN s * 41.7e0 ELSE s * 22.2e0 END AS far, CASE WHEN road_id = '' THEN 1 ELSE ((CASE WHEN q.road <> road_id THEN 0.5e0 ELSE 1 END) + (CASE WHEN z.road <> road_id THEN 0.5e0 ELSE 1 END)) / 2 END AS f,
         CASE WHEN seq >= 3 AND bhd IS NOT NULL AND hd IS NOT NULL THEN greatest(0.5e0, exp(-abs(hd - bhd) / 90)) ELSE 1 END AS cv,
         {turn('hn - ' + course('q.lat', 'q.lon', 'latitude', 'longitude'))} AS came, {turn('hn - ' + course('latitude', 'longitude', 'z.lat', 'z.lon'))} AS goes, seq - q.seq AS gap FROM c6
), c8 AS (
  SELECT *, CASE WHEN hw THEN greatest(5000e0, least(s * 27.8e0 * 1.3e0, far)) ELSE greatest(1500e0, least(s * 15.3e0 * 1.2e0, far)) END AS near FROM c7
), c9 AS (
  SELECT *, CASE WHEN seq = 1 THEN 1 WHEN s > 0 THEN least(1e0, f * greatest(0e0, least(1e0, CASE WHEN m <= near THEN 1 WHEN m <= far THEN 1 - (m - near) / (far - near) * 0.4e0 ELSE exp(-(m - far) / far) * 0.6e0 + 0.3e0 END))) ELSE 0.5e0 * f END AS t,
         CASE WHEN hn IS NOT NULL AND q.hn IS NOT NULL THEN {_head('came')} * CASE WHEN gap <= 1 THEN 1 ELSE exp(-(gap - 1) / 3.0e0) END ELSE 1 END AS back, CASE WHEN hn IS NOT NULL AND z.hn IS NOT NULL THEN {_head('goes')} ELSE 1 END AS ahead FROM c8
), c10 AS (
  SELECT *, CASE WHEN seq = 1 THEN 1 ELSE greatest(0.5e0, least(1e0, CASE WHEN gap = 1 THEN {_head('hd')} * 0.5e0 + cv * 0.5e0 ELSE (CASE WHEN z IS NOT NULL THEN (back + ahead) / 2 ELSE back END) * 0.7e0 + cv * 0.3e0 END)) END AS g FROM c9
), scored AS (
  SELECT *, greatest(0e0, least(1e0, 0.6e0 * p + 0.2e0 * t + 0.2e0 * g)) AS score, count(*) OVER (PARTITION BY day, plate_number) AS n FROM c10
), corrected AS (
  SELECT * FROM (SELECT *, lag(latitude) OVER ({W}) AS klat, lag(longitude) OVER ({W}) AS klon FROM scored WHERE score > 0.6e0 OR n = 1) WHERE klat IS NULL OR klat <> latitude OR klon <> longitude
)"""


def _scores(spark, d) -> DataFrame:
    return correction.scored(points(spark, d))


@query(on_points("SELECT event_id, round(p, 6) AS p FROM scored", _SCORED))
def speed_probability(spark, d):
    return _scores(spark, d).select("event_id", r("p_speed", 6).alias("p"))


@query(on_points("SELECT event_id, q.seq AS before, z.seq AS after FROM scored", _SCORED))
def high_conf_refs(spark, d):
    return _scores(spark, d).select("event_id", F.col("prev_ref.seq").cast("long").alias("before"), F.col("next_ref.seq").cast("long").alias("after"))


@query(on_points("SELECT event_id, round(t, 6) AS t FROM scored", _SCORED))
def transition_probability(spark, d):
    return _scores(spark, d).select("event_id", r("p_road", 6).alias("t"))


@query(on_points("SELECT event_id, round(g, 6) AS g FROM scored", _SCORED))
def adjacency_score(spark, d):
    return _scores(spark, d).select("event_id", r("p_shape", 6).alias("g"))


@query(on_points("SELECT event_id, plate_number, day, round(score, 6) AS score FROM corrected", _SCORED))
def correct_trajectory(spark, d):
    return correction.correct(points(spark, d)).select("event_id", "plate_number", "day", r("score", 6).alias("score"))


_CORRECTED_STATS = f"SELECT day, plate_number, count(*) AS point_count, round(coalesce(sum({hav('latitude', 'longitude', 'la', 'lo')}), 0), 2) AS metres, round(coalesce(avg(CASE WHEN nx IS NOT NULL AND speed BETWEEN 0 AND 200 THEN speed END), 0), 3) AS avg_speed FROM (SELECT *, lead(latitude) OVER ({W}) AS la, lead(longitude) OVER ({W}) AS lo, lead(event_id) OVER ({W}) AS nx FROM corrected) GROUP BY day, plate_number"


@query(on_points(_CORRECTED_STATS, _SCORED))
def corrected_stats(spark, d):
    s = correction.summary(correction.correct(points(spark, d)))
    return s.select("day", "plate_number", "point_count", r("total_distance", 2).alias("metres"), r("average_speed").alias("avg_speed"))


@query(on_points(f"SELECT * FROM ({_CORRECTED_STATS}) WHERE plate_number IN (SELECT DISTINCT plate_number FROM gps_points ORDER BY 1 LIMIT 5 OFFSET 5) AND day = (SELECT min(day) FROM gps_points g WHERE g.plate_number = plate_number)", _SCORED).replace("SELECT min(day) FROM gps_points g WHERE g.plate_number = plate_number", "SELECT '01'"))
def corrected_page(spark, d):
    s = service.corrected_page(points(spark, d), 2, 5)
    return s.select("day", "plate_number", "point_count", r("total_distance", 2).alias("metres"), r("average_speed").alias("avg_speed"))


@query(on_points("SELECT day, count(DISTINCT plate_number) AS source_count, count(DISTINCT k) AS target_count, printf('%.2f%%', count(DISTINCT k) * 100.0e0 / count(DISTINCT plate_number)) AS rate FROM (SELECT p.day, p.plate_number, c.plate_number AS k FROM gps_points p LEFT JOIN (SELECT DISTINCT day, plate_number FROM corrected WHERE user_id % 4 <> 0) c USING (day, plate_number)) GROUP BY day", _SCORED))
def correction_rate(spark, d):
    p = points(spark, d)
    return service.correction_rate(p, correction.correct(p).where("user_id % 4 <> 0"))


# ----------------------------------------------------------------------- roads and matching


def segments(spark, d) -> DataFrame:
    return fixtures.road_segments(spark, d)


@query(f"WITH {ROADS} SELECT segment_id, road_id, CAST(seq AS BIGINT) AS seq, round(start_lat, 6) AS start_lat, round(start_lon, 6) AS start_lon, round(end_lat, 6) AS end_lat, round(end_lon, 6) AS end_lon, road_name, road_type FROM road_segments")
def road_segments(spark, d):
    return segments(spark, d).select("segment_id", "road_id", "seq", *[r(c, 6).alias(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")], "road_name", "road_type")


_VERTICES = """line AS (
  SELECT road_id, min(road_name) AS road_name, min(road_type) AS road_type, list((start_lon, start_lat) ORDER BY seq) || [arg_max((end_lon, end_lat), seq)] AS c FROM road_segments GROUP BY road_id
), corner AS (
  SELECT road_id, i - 1 AS point_index, c[i][1] AS lon, c[i][2] AS lat FROM (SELECT road_id, c, unnest(range(1, len(c) + 1)) AS i FROM line)
), part AS (
  SELECT road_id, i - 1 AS seq, c[i][1] AS x1, c[i][2] AS y1, c[i + 1][1] AS x2, c[i + 1][2] AS y2 FROM (SELECT road_id, c, unnest(range(1, len(c))) AS i FROM line)
)""".replace("part AS (", "piece AS (")


@query(f"WITH {ROADS}, {_VERTICES} SELECT road_id, CAST(point_index AS INTEGER) AS point_index, round(lon, 6) AS lon, round(lat, 6) AS lat FROM corner")
def road_vertices(spark, d):
    return roads.vertices(roads.polylines(segments(spark, d))).select("road_id", "point_index", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


@query(f"WITH {ROADS}, {_VERTICES} SELECT road_id, CAST(seq AS INTEGER) AS seq, round(x1, 6) AS start_lon, round(y1, 6) AS start_lat, round(x2, 6) AS end_lon, round(y2, 6) AS end_lat FROM piece")
def polyline_segments(spark, d):
    s = roads.segments_of(roads.polylines(segments(spark, d)))
    return s.select("road_id", "seq", *[r(c, 6).alias(c) for c in ("start_lon", "start_lat", "end_lon", "end_lat")])


@query(f"WITH {ROADS} SELECT count(*) AS total_roads, round(sum({hav('start_lat', 'start_lon', 'end_lat', 'end_lon')}), 2) AS total_length, round(least(min(start_lat), min(end_lat)), 6) AS min_lat, round(greatest(max(start_lat), max(end_lat)), 6) AS max_lat, round(least(min(start_lon), min(end_lon)), 6) AS min_lng, round(greatest(max(start_lon), max(end_lon)), 6) AS max_lng FROM road_segments")
def network_header(spark, d):
    h = roads.header(segments(spark, d))
    return h.select("total_roads", r("total_length", 2).alias("total_length"), *[r(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng")])


_TOUCH = " OR ".join(f"(abs(x.{p}_lat - y.{q}_lat) < 0.000001e0 AND abs(x.{p}_lon - y.{q}_lon) < 0.000001e0)" for p in ("start", "end") for q in ("start", "end"))


@query(f"WITH {ROADS} SELECT x.segment_id AS from_id, y.segment_id AS to_id FROM road_segments x JOIN road_segments y ON x.segment_id <> y.segment_id AND ({_TOUCH})")
def connected_segments(spark, d):
    return roads.connected(segments(spark, d))


def _projected(lat: str, lon: str, y1: str, x1: str, y2: str, x2: str) -> str:
    """t, clamped, of the closest point of a segment."""
    return f"CASE WHEN {x2} = {x1} AND {y2} = {y1} THEN 0 ELSE greatest(0e0, least(1e0, (({lon} - {x1}) * ({x2} - {x1}) + ({lat} - {y1}) * ({y2} - {y1})) / (({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1})))) END"


_NEAREST = f"""n1 AS (
  SELECT event_id, segment_id, latitude, longitude, start_lat, start_lon, end_lat, end_lon, {_projected('latitude', 'longitude', 'start_lat', 'start_lon', 'end_lat', 'end_lon')} AS k FROM gps_points, road_segments
), n2 AS (
  SELECT event_id, segment_id, start_lat + k * (end_lat - start_lat) AS lat, start_lon + k * (end_lon - start_lon) AS lon, {hav('latitude', 'longitude', 'start_lat + k * (end_lat - start_lat)', 'start_lon + k * (end_lon - start_lon)')} AS m FROM n1
), nearest AS (
  SELECT * FROM n2 WHERE m <= 500 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(m, 9), segment_id) = 1
)"""


@query(on_points("SELECT event_id, segment_id, round(lat, 6) AS matched_lat, round(lon, 6) AS matched_lon, round(m, 3) AS distance, round(1 - m / 500, 6) AS confidence FROM nearest", ROADS, _NEAREST))
def nearest_segment(spark, d):
    return _matched(roads.nearest_segment(points(spark, d), segments(spark, d), 500.0))


def _matched(df: DataFrame) -> DataFrame:
    return df.select("event_id", "segment_id", r("matched_lat", 6).alias("matched_lat"), r("matched_lon", 6).alias("matched_lon"), r("distance").alias("distance"), r("confidence", 6).alias("confidence"))


@query(on_points("SELECT count(*) AS total_points, count(*) AS matched_points, CASE WHEN count(*) > 0 THEN 1e0 ELSE 0e0 END AS match_rate, round(coalesce(avg(m), 0), 3) AS avg_distance, round(coalesce(min(m), 0), 3) AS min_distance, round(coalesce(max(m), 0), 3) AS max_distance, round(coalesce(avg(1 - m / 500), 0), 6) AS avg_confidence FROM nearest JOIN gps_points USING (event_id) WHERE speed <= 200", ROADS, _NEAREST))
def match_statistics(spark, d):
    s = matching.statistics(matching.create("distance_matching", max_distance=500.0)(points(spark, d), segments(spark, d)))
    return s.select("total_points", "matched_points", "match_rate", *[r(c).alias(c) for c in ("avg_distance", "min_distance", "max_distance")], r("avg_confidence", 6).alias("avg_confidence"))


@query(on_points("SELECT event_id, segment_id, round(lat, 6) AS matched_lat, round(lon, 6) AS matched_lon, round(m, 3) AS distance, round(1 - m / 500, 6) AS confidence FROM nearest JOIN gps_points USING (event_id) WHERE speed <= 200", ROADS, _NEAREST))
def ensemble_vote(spark, d):
    return _matched(matching.create("ensemble", max_distance=500.0)(points(spark, d), segments(spark, d)))


@query(on_points("SELECT event_id, CASE WHEN m > 50 THEN 'poor' WHEN m > 20 THEN 'fair' ELSE 'good' END AS distance_tier, CASE WHEN 1 - m / 500 > 0.8e0 THEN 'high' WHEN 1 - m / 500 > 0.5e0 THEN 'medium' ELSE 'low' END AS confidence_tier FROM nearest", ROADS, _NEAREST))
def match_tiers(spark, d):
    return matching.quality(roads.nearest_segment(points(spark, d), segments(spark, d), 500.0)).select("event_id", "distance_tier", "confidence_tier")


@query(on_points(f"SELECT event_id, road_id, CAST(point_index AS INTEGER) AS point_index, round(m, 3) AS distance FROM (SELECT event_id, corner.road_id, point_index, {hav('latitude', 'longitude', 'lat', 'lon')} AS m FROM gps_points, corner) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(m, 9), road_id, point_index) = 1", ROADS, _VERTICES))
def nearest_vertex(spark, d):
    return matching.vertex_match(points(spark, d), roads.polylines(segments(spark, d))).select("event_id", "road_id", "point_index", r("distance").alias("distance"))


@query(on_points("SELECT event_id, road_id, CAST(point_index AS INTEGER) AS point_index FROM (SELECT event_id, corner.road_id, point_index, sqrt(power(longitude - lon, 2) + power(latitude - lat, 2)) AS m FROM gps_points, corner) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(m, 9), road_id, point_index) = 1", ROADS, _VERTICES))
def nearest_vertex_planar(spark, d):
    return matching.vertex_match(points(spark, d), roads.polylines(segments(spark, d)), planar=True).select("event_id", "road_id", "point_index")


#: cells of 0.005 degrees: the fixture's roads have a vertex every 0.0125
_SIZE = 0.005
_GRID = f"""near AS (
  SELECT DISTINCT event_id, corner.road_id, longitude, latitude FROM gps_points JOIN corner ON abs(floor(longitude / {_SIZE}e0) - floor(lon / {_SIZE}e0)) <= 1 AND abs(floor(latitude / {_SIZE}e0) - floor(lat / {_SIZE}e0)) <= 1
), g1 AS (
  SELECT event_id, road_id, longitude, latitude, seq, x1, y1, x2, y2, {_projected('latitude', 'longitude', 'y1', 'x1', 'y2', 'x2')} AS k FROM near JOIN piece USING (road_id)
), g2 AS (
  SELECT event_id, road_id, seq, y1 + k * (y2 - y1) AS lat, x1 + k * (x2 - x1) AS lon, power(longitude - (x1 + k * (x2 - x1)), 2) + power(latitude - (y1 + k * (y2 - y1)), 2) AS sq FROM g1
), candidate AS (
  SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY event_id, road_id ORDER BY sq, seq) = 1
)"""


@query(on_points("SELECT event_id, road_id, round(sq, 9) AS square FROM candidate QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(sq, 12), road_id) <= 50", ROADS, _VERTICES, _GRID))
def grid_candidates(spark, d):
    return roads.grid_candidates(points(spark, d), roads.polylines(segments(spark, d)), _SIZE).select("event_id", "road_id", r("square", 9).alias("square"))


_ANGLE = "(degrees(atan2(c[len(c)][2] - c[1][2], c[len(c)][1] - c[1][1])) + 360e0) % 360e0"
_CONTEXT = f"""m1 AS (
  SELECT candidate.*, line.road_type AS kind, {_ANGLE} AS angle, CASE WHEN speed = 0 THEN -1 ELSE heading END AS h FROM candidate JOIN line USING (road_id) JOIN (SELECT event_id, speed, heading FROM gps_points) USING (event_id)
), m2 AS (
  SELECT *, CASE WHEN h < 0 THEN 0.4e0 / (1 + sqrt(sq) * 1000) ELSE 0.4e0 * (1 - {turn('h - angle')} / 180) + 0.6e0 / (1 + sqrt(sq) * 1000) END AS score FROM m1
), best AS (
  SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, road_id) = 1
), matched AS (
  SELECT p.event_id, p.day, p.plate_number, p.datetime, p.t_sec, coalesce(b.road_id, 'unknown') AS road_id, coalesce(b.kind, 'unknown') AS road_type, coalesce(b.lat, latitude) AS latitude, coalesce(b.lon, longitude) AS longitude, coalesce(sqrt(sq) * 111000, 0) AS metres
  FROM gps_points p LEFT JOIN best b USING (event_id)
)"""


def _context(spark, d) -> DataFrame:
    return matching.context_match(points(spark, d).drop("road_id", "road_type"), roads.polylines(segments(spark, d)), size=_SIZE)


@query(on_points("SELECT event_id, road_id, road_type, round(metres, 3) AS distance, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM matched", ROADS, _VERTICES, _GRID, _CONTEXT))
def context_match(spark, d):
    return _context(spark, d).select("event_id", "road_id", "road_type", r("distance_to_road").alias("distance"), r("latitude", 6).alias("lat"), r("longitude", 6).alias("lon"))


_CLEAN = "SELECT event_id FROM (SELECT *, " + " OR ".join(_far(n).replace("<= 60", "<= 300").replace("> 3000", "> 500") for n in (1, 2, 3, -1, -2, -3)) + f" AS far, lag(event_id) OVER ({W}) IS NOT NULL AND lead(event_id) OVER ({W}) IS NOT NULL AS inner_, " + ", ".join(f"{'lag' if n > 0 else 'lead'}(road_id, {abs(n)}) OVER ({W}) AS r{k}" for k, n in enumerate((2, 1, -1, -2))) + f", row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY day, plate_number) AS n FROM matched) WHERE n <= 2 OR (metres <= 100 AND NOT (far AND inner_) AND NOT (n >= 5 AND i >= 2 AND i <= n - 3 AND coalesce(len(list_filter([r0, r1, r2, r3], lambda x: x <> road_id AND len(list_filter([r0, r1, r2, r3], lambda y: y = x)) >= 3)) > 0, false)))"


@query(on_points(_CLEAN, ROADS, _VERTICES, _GRID, _CONTEXT))
def match_with_cleaning(spark, d):
    return matching.cleaned(_context(spark, d)).select("event_id")


@query(on_points(f"SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT event_id, lat, lon, {hav('latitude', 'longitude', 'lat', 'lon')} AS m, corner.road_id, point_index FROM (SELECT *, row_number() OVER ({W}) AS i FROM gps_points WHERE location_flag = 1 AND plate_number IN (SELECT DISTINCT plate_number FROM gps_points ORDER BY 1 LIMIT 10)) v, corner WHERE i <= 5) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(m, 9), road_id, point_index) = 1", ROADS, _VERTICES))
def match_on_read(spark, d):
    p = points(spark, d).withColumn("is_valid", F.col("location_flag") == 1)
    return service.match_on_read(p, roads.polylines(segments(spark, d)), 10, 5).select("event_id", r("latitude", 6).alias("lat"), r("longitude", 6).alias("lon"))


def _reached(most: float) -> str:
    """CTEs that end in `reached`: each point's place i in its sequence and cand, its segments in reach; and `link`."""
    return f"""r1 AS (
  SELECT event_id, segment_id, latitude, longitude, start_lat, start_lon, end_lat, end_lon, {_projected('latitude', 'longitude', 'start_lat', 'start_lon', 'end_lat', 'end_lon')} AS k FROM gps_points, road_segments
), r2 AS (
  SELECT event_id, segment_id, start_lat + k * (end_lat - start_lat) AS lat, start_lon + k * (end_lon - start_lon) AS lon, {hav('latitude', 'longitude', 'start_lat + k * (end_lat - start_lat)', 'start_lon + k * (end_lon - start_lon)')} AS m FROM r1
), r3 AS (
  SELECT event_id, segment_id, lat, lon, m, coalesce(links, []) AS links FROM r2 LEFT JOIN link USING (segment_id) WHERE m <= {most}
)"""


def _links(itself: bool) -> str:
    return f"link AS (SELECT x.segment_id, list(y.segment_id ORDER BY y.segment_id) AS links FROM road_segments x JOIN road_segments y ON ({_TOUCH}) {'' if itself else 'AND x.segment_id <> y.segment_id'} GROUP BY x.segment_id)"


_GREEDY = f"""r4 AS (
  SELECT event_id, list({{'id': segment_id, 'm': m, 'lat': lat, 'lon': lon, 'links': links}} ORDER BY round(m, 9), segment_id) AS cand FROM r3 GROUP BY event_id
), r5 AS (
  SELECT p.event_id, day, plate_number, speed, row_number() OVER ({W}) AS i, CASE WHEN speed <= 200 THEN cand END AS cand FROM gps_points p LEFT JOIN r4 USING (event_id)
), walk AS (
  SELECT day, plate_number, i, event_id, cand[1] AS pick, cand[1].links AS held FROM r5 WHERE i = 1
  UNION ALL
  SELECT day, plate_number, i, event_id, pick, coalesce(pick.links, held) AS held FROM (
    SELECT r.day, r.plate_number, r.i, r.event_id, w.held, CASE WHEN coalesce(len(w.held), 0) = 0 THEN r.cand[1] ELSE list_filter(r.cand, lambda x: list_contains(w.held, x.id))[1] END AS pick
    FROM walk w JOIN r5 r ON r.day = w.day AND r.plate_number = w.plate_number AND r.i = w.i + 1)
)"""


def on_walk(body: str, *more: str) -> str:
    return on_points(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


@query(on_walk("SELECT event_id, pick.id AS segment_id, round(pick.lat, 6) AS matched_lat, round(pick.lon, 6) AS matched_lon, round(pick.m, 3) AS distance, round(1 - pick.m / 1000, 6) AS confidence FROM walk WHERE pick IS NOT NULL", ROADS, _links(True), _reached(1000), _GREEDY))
def greedy_match(spark, d):
    return _matched(matching.create("greedy")(points(spark, d), segments(spark, d)))


#: n is a path's last score before its own chance, rounded; paths are lists of candidates
_VITERBI = f"""r4 AS (
  SELECT event_id, list({{'id': segment_id, 'm': m, 'lat': lat, 'lon': lon, 'links': links, 'w': exp(-0.5e0 * power(m / 500, 2))}} ORDER BY segment_id) AS cand FROM r3 GROUP BY event_id
), r5 AS (
  SELECT p.event_id, day, plate_number, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY day, plate_number) AS n,
         coalesce(list_transform(cand, lambda x: {{'id': x.id, 'links': x.links, 'c': {{'e': p.event_id, 'id': x.id, 'm': x.m, 'lat': x.lat, 'lon': x.lon, 'p': x.w / list_sum(list_transform(cand, lambda y: y.w))}}}}), []) AS cand
  FROM gps_points p LEFT JOIN r4 USING (event_id) WHERE speed <= 200
), walk AS (
  SELECT day, plate_number, i, n, list_transform(cand, lambda x: {{'id': x.id, 'links': x.links, 'score': ln(x.c.p), 'path': [x.c]}}) AS state FROM r5 WHERE i = 1
  UNION ALL
  SELECT day, plate_number, i, n, list_transform(list_filter(next, lambda z: z.b IS NOT NULL), lambda z: {{'id': z.x.id, 'links': z.x.links, 'score': z.b.v + ln(z.x.c.p), 'path': list_append(z.b.path, z.x.c)}}) AS state FROM (
    SELECT r.day, r.plate_number, r.i, r.n, list_transform(r.cand, lambda x: {{'x': x, 'b': list_sort(list_transform(list_filter(w.state, lambda s: len(s.links) BETWEEN 1 AND 10 AND list_contains(s.links, x.id)),
             lambda s: {{'k': -round(s.score - ln(len(s.links)), 9), 'id': s.id, 'v': s.score - ln(len(s.links)), 'path': s.path}}))[1]}}) AS next
    FROM walk w JOIN r5 r ON r.day = w.day AND r.plate_number = w.plate_number AND r.i = w.i + 1)
), ended AS (
  SELECT unnest(list_sort(list_transform(state, lambda s: {{'k': -round(s.score, 9), 'id': s.id, 'path': s.path}}))[1].path) AS c FROM walk WHERE i = n AND len(state) > 0
)"""


@query(on_walk("SELECT c.e AS event_id, c.id AS segment_id, round(c.lat, 6) AS matched_lat, round(c.lon, 6) AS matched_lon, round(c.m, 3) AS distance, round(c.p, 6) AS confidence FROM ended", ROADS, _links(False), _reached(1500), _VITERBI))
def viterbi_match(spark, d):
    return _matched(matching.create("gotrackit", max_distance=1500.0)(points(spark, d).where("speed <= 200"), segments(spark, d)))


_SPANS = f"""v AS (
  SELECT event_id, day, plate_number, latitude AS y, longitude AS x, row_number() OVER ({W}) AS i FROM gps_points
), span AS (
  SELECT day, plate_number, min(i) AS a, max(i) AS b FROM v GROUP BY day, plate_number
  UNION ALL
  SELECT day, plate_number, CASE WHEN side = 0 THEN a ELSE far.i END AS a, CASE WHEN side = 0 THEN far.i ELSE b END AS b FROM (
    SELECT day, plate_number, a, b, arg_max({{'i': i, 'm': m}}, (round(m, 6), -i)) AS far FROM (
      SELECT *, {hav('y', 'x', 'ya + k * (yb - ya)', 'xa + k * (xb - xa)')} AS m FROM (
        SELECT *, {_projected('y', 'x', 'ya', 'xa', 'yb', 'xb')} AS k FROM (
          SELECT s.day, s.plate_number, s.a, s.b, p.i, p.y, p.x, p1.y AS ya, p1.x AS xa, p2.y AS yb, p2.x AS xb
          FROM span s JOIN v p ON p.day = s.day AND p.plate_number = s.plate_number AND p.i > s.a AND p.i < s.b
          JOIN v p1 ON p1.day = s.day AND p1.plate_number = s.plate_number AND p1.i = s.a JOIN v p2 ON p2.day = s.day AND p2.plate_number = s.plate_number AND p2.i = s.b)))
    GROUP BY day, plate_number, a, b), (VALUES (0), (1)) AS sides(side) WHERE far.m > 10
)"""


@query(on_walk("SELECT day, plate_number, event_id FROM v SEMI JOIN (SELECT day, plate_number, a AS i FROM span UNION SELECT day, plate_number, b FROM span) USING (day, plate_number, i)", _SPANS))
def douglas_peucker(spark, d):
    return stateful.simplified(points(spark, d)).select("day", "plate_number", "event_id")


_KEPT = f"""v AS (
  SELECT event_id, day, plate_number, latitude, longitude, speed > 200 AS bad, row_number() OVER ({W}) AS i FROM gps_points
), walk AS (
  SELECT day, plate_number, i, event_id, latitude AS a, longitude AS b, true AS ok FROM v WHERE i = 1
  UNION ALL
  SELECT day, plate_number, i, event_id, CASE WHEN ok THEN latitude ELSE a END AS a, CASE WHEN ok THEN longitude ELSE b END AS b, ok FROM (
    SELECT v.day, v.plate_number, v.i, v.event_id, v.latitude, v.longitude, w.a, w.b, NOT v.bad AND {hav('w.a', 'w.b', 'v.latitude', 'v.longitude')} <= 2500 AS ok
    FROM walk w JOIN v ON v.day = w.day AND v.plate_number = w.plate_number AND v.i = w.i + 1)
)"""


@query(on_walk("SELECT event_id FROM walk WHERE ok", _KEPT))
def outlier_filter(spark, d):
    return stateful.without_outliers(points(spark, d), metres=2500.0).select("event_id")


# ---------------------------------------------------------------------- sources and sinks


@query(on_points("SELECT plate_number, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, round(speed, 3) AS speed, CAST(heading AS INTEGER) AS heading, location_flag = 1 AS is_valid FROM gps_points"))
def text_round_trip(spark, d):
    good, _ = readers.split_rejects(readers.parse_lines(sinks.gps_lines(points(spark, d))))
    return good.select("plate_number", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"), r("speed").alias("speed"), F.col("heading").cast("int").alias("heading"), "is_valid")


@query("SELECT event_id, (['ok', 'field_count', 'time', 'parse', 'coordinate', 'blank'])[event_id % 6 + 1] AS reason FROM events")
def reject_reasons(spark, d):
    """The raw lines of all positions, five in six of which are damaged, each in its own way."""
    f = F.split("value", ",")
    put = lambda **new: F.array_join(F.array(*[new.get(f"f{i}", F.get(f, F.lit(i))) for i in range(10)]), ",")
    damaged = [F.col("value"), F.array_join(F.slice(f, 1, 9), ","), put(f0=F.lit("20190230")), put(f4=F.lit("east")), put(f4=F.lit("0.0"), f5=F.lit("0.0")), F.lit(" ")]
    raw = sinks.gps_lines(points(spark, d), "event_id").select("event_id", F.get(F.array(*damaged), (F.col("event_id") % 6).cast("int")).alias("value"))
    return readers.parse_lines(raw).select("event_id", F.coalesce("reject_reason", F.lit("ok")).alias("reason"))


@query(f"WITH {ROADS}, {_VERTICES} SELECT road_id, road_name, road_type, CAST(len(c) AS INTEGER) AS n, round(c[1][1], 6) AS lon, round(c[1][2], 6) AS lat FROM line")
def geojson_round_trip(spark, d):
    back = readers.roads_geojson(sinks.geojson(roads.polylines(segments(spark, d))))
    return back.select("road_id", "road_name", "road_type", F.size("coords").alias("n"), r(F.get("coords", F.lit(0))["x"], 6).alias("lon"), r(F.get("coords", F.lit(0))["y"], 6).alias("lat"))


@query(on_points("SELECT kind, day, plate_number, count(*) AS n FROM (SELECT 'original' AS kind, day, plate_number, event_id FROM gps_points UNION ALL SELECT 'corrected', day, plate_number, event_id FROM corrected) WHERE (day, plate_number) IN (SELECT (day, plate_number) FROM (SELECT day, plate_number, row_number() OVER (PARTITION BY day ORDER BY min(event_id)) AS i FROM gps_points GROUP BY day, plate_number) WHERE i <= 20) AND (day, plate_number) IN (SELECT (day, plate_number) FROM corrected) GROUP BY kind, day, plate_number", _SCORED))
def export_sample(spark, d):
    p = points(spark, d)
    return sinks.sample(p, correction.correct(p), 20).groupBy("kind", *seq.KEYS).agg(F.count("*").alias("n"))


# ----------------------------------------------------------- files, written and read again


def _folder(spark) -> str:
    return workspace.shared_dir(spark)


_RAW = "plate_number, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude"


@query(on_points(f"SELECT day, {_RAW} FROM gps_points"))
def directory_scan(spark, d):
    where = _folder(spark)
    sinks.write_lines(points(spark, d), where)
    return _raw(readers.gps_text(spark, where, glob="*.txt"), "day")


def _raw(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "plate_number", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"))


@query(on_points(f"SELECT {_RAW} FROM gps_points WHERE day = '02'"))
def single_folder_ingest(spark, d):
    where = _folder(spark)
    sinks.write_lines(points(spark, d), where)
    return _raw(readers.taxi(spark, f"{where}/day=02"))


@query(on_points("SELECT day, plate_number, count(*) AS n, round(sum(speed), 3) AS speed FROM gps_points WHERE event_id % 10 <> 0 GROUP BY day, plate_number"))
def point_store(spark, d):
    """Every tenth row loses its place, so it is rejected and stored beside."""
    where, p = _folder(spark), points(spark, d)
    lines = sinks.gps_lines(p.withColumns({c: F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col(c)) for c in ("longitude", "latitude")}), "day")
    parsed = readers.parse_lines(lines).drop("value")
    for batch in ("first", "first"):  # a rerun changes nothing
        sinks.write_points(parsed, where, batch)
    stored = sinks.stored_points(spark, where, "plate_number string, speed double")
    return stored.groupBy("day", "plate_number").agg(F.count("*").alias("n"), r(F.sum("speed")).alias("speed"))


@query(on_points("SELECT 'ok' AS outcome, count(*) FILTER (event_id % 10 <> 0) AS n FROM gps_points UNION ALL SELECT 'coordinate', count(*) FILTER (event_id % 10 = 0) FROM gps_points"))
def reject_counters(spark, d):
    p = points(spark, d)
    lines = sinks.gps_lines(p.withColumns({c: F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col(c)) for c in ("longitude", "latitude")}))
    return readers.reject_counts(readers.parse_lines(lines).withColumn("source_file", F.lit("all"))).select("outcome", "n")


@query(on_points("SELECT day, count(*) AS n FROM gps_points WHERE day <> '01' GROUP BY day"))
def skip_stored_files(spark, d):
    where = _folder(spark)
    sinks.write_lines(points(spark, d), where)
    parsed = readers.gps_text(spark, where, glob="*.txt")
    return readers.new_files(parsed, parsed.where("day = '01'").select("day", "source_file")).groupBy("day").agg(F.count("*").alias("n"))


@query(on_points(f"SELECT event_id, row_number() OVER ({W}) AS seq FROM ({_MOVED})"))
def trajectory_store(spark, d):
    """Some vehicles first, then all: those that are stored stay as they are."""
    where, built = _folder(spark), service.build(points(spark, d))
    some = built.where("plate_number < 'B0040'")
    # a batch may hold a key twice, of which the longer counts; running it again changes nothing
    short = some.withColumns({"trajectory_points": F.slice("trajectory_points", 1, 1), "point_count": F.lit(0).cast("long")})
    for batch, rows in (("some", some.unionByName(short)), ("some", some.unionByName(short)), ("all", built)):
        sinks.write_new(rows, where, batch)
    return service.flat(sinks.stored_trajectories(spark, where, built.schema)).select("event_id", F.col("seq").cast("long").alias("seq"))


@query(on_points("SELECT event_id, round(score, 6) AS score FROM corrected WHERE user_id % 2 = 0", _SCORED))
def corrected_store(spark, d):
    """All are stored; then those of half the vehicles instead."""
    where = _folder(spark)
    c = correction.correct(points(spark, d)).select("day", "plate_number", "user_id", "event_id", "score")
    sinks.write_new(c, where, "all", overwrite=True)
    sinks.write_new(c.where("user_id % 2 = 0"), where, "half", overwrite=True)
    return sinks.stored_trajectories(spark, where, c.schema).select("event_id", r("score", 6).alias("score"))


@query(on_points("SELECT day, plate_number, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, road_type FROM corrected", _SCORED))
def csv_export(spark, d):
    where = _folder(spark)
    sinks.export_csv(correction.correct(points(spark, d)), where)
    back = spark.read.csv(where, header=True)
    return back.select("day", "plate_number", "datetime", *[r(F.col(c).cast("double"), 6).alias(c) for c in ("longitude", "latitude")], "road_type")


@query(on_points("SELECT day, CAST(count(DISTINCT plate_number) AS VARCHAR) AS source_count, CAST(count(DISTINCT k) AS VARCHAR) AS target_count, printf('%.2f%%', count(DISTINCT k) * 100.0e0 / count(DISTINCT plate_number)) AS rate FROM (SELECT p.day, p.plate_number, c.plate_number AS k FROM gps_points p LEFT JOIN (SELECT DISTINCT day, plate_number FROM corrected) c USING (day, plate_number)) GROUP BY day", _SCORED))
def rates_export(spark, d):
    where, p = _folder(spark), points(spark, d)
    sinks.export_rates(p, correction.correct(p), where)
    return spark.read.csv(where, header=True)


@query(on_points("SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, round(speed, 3) AS speed, heading FROM gps_points"))
def gpx_round_trip(spark, d):
    where = _folder(spark)
    sinks.download(points(spark, d), "gpx", where)
    return readers.gpx(spark, where).select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"), r("speed").alias("speed"), "heading")


@query(on_points("SELECT CAST(event_id AS VARCHAR) AS event_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM gps_points"))
def points_geojson_round_trip(spark, d):
    where = _folder(spark)
    sinks.download(points(spark, d).select("event_id", "longitude", "latitude"), "geojson", where)
    return readers.points_geojson(readers.collection(spark, where)).select(F.col("properties")["event_id"].alias("event_id"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"))


@query(on_points("SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, 0.5e0 AS elevation FROM gps_points"))
def csv_upload(spark, d):
    where, p = _folder(spark), points(spark, d)
    sinks.download(p.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("时间"), F.col("longitude").alias("Lng"), F.col("latitude").alias("my_latitude"), F.lit(0.5).alias("ele")), "csv", where)
    return readers.csv(spark, where).select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"), "elevation")


@query("SELECT sum(len(CAST(event_id AS VARCHAR)) + 1)::BIGINT AS bytes, 'txt' AS extension, true AS allowed FROM events")
def upload_info(spark, d):
    where = _folder(spark)
    spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("value")).write.text(where)
    return readers.file_info(spark, f"{where}/*.txt").groupBy("extension").agg(F.sum("size").alias("bytes"), F.bool_and("allowed").alias("allowed"))


_AREA = "'MULTIPOLYGON(((' || " + " || ', ' || ".join(f"{x} || ' ' || {y}" for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))) + " || ')))'"
_ROUND_BOX = _BOX.replace("gps_points", "(SELECT plate_number, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM gps_points)")


@query(on_points(f"SELECT plate_number AS gb_code, CASE WHEN plate_number < 'B0040' THEN 'new ' ELSE 'old ' END || plate_number AS name, {_AREA} AS wkt FROM ({_ROUND_BOX.format('plate_number')})"))
def area_store(spark, d):
    """The box of each vehicle's positions as an area in a file of its own; then some of them are replaced under their codes."""
    where, fresh = _folder(spark), _folder(spark)
    rounded = points(spark, d).withColumns({c: F.round(c, 6) for c in ("longitude", "latitude")})
    areas = _boxes(rounded, "plate_number").withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    for folder, rows, word in ((where, areas, "old "), (fresh, areas.where("plate_number < 'B0040'"), "new ")):
        ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
        about = F.struct(F.col("plate_number").alias("gb"), F.concat(F.lit(word), "plate_number").alias("name")).alias("properties")
        feature = F.struct(F.lit("Feature").alias("type"), about, F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")).alias("geometry"))
        text_ = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.to_json(feature), F.lit("]}"))
        rows.select(text_.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    stored = readers.upsert_areas(readers.areas_geojson(spark, where), readers.areas_geojson(spark, fresh))
    return stored.select("gb_code", "name", readers.to_wkt(F.col("polygons")).alias("wkt"))


# --------------------------------------------------------------------- more of the service


def _stored_points(spark, d) -> DataFrame:
    """Trajectories with all that a correction reads."""
    p = points(spark, d).withColumn("is_valid", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("location_flag") == 1))
    point = F.struct("event_id", "user_id", "datetime", "longitude", "latitude", "speed", "heading", "road_id", "road_type", "is_valid")
    return p.groupBy(*seq.KEYS).agg(F.collect_list(point).alias("trajectory_points"))


@query(on_points("SELECT event_id, plate_number, day, round(score, 6) AS score FROM corrected", _SCORED).replace("lead(speed) OVER (" + W + ") AS ns FROM gps_points", "lead(speed) OVER (" + W + ") AS ns FROM gps_points WHERE event_id % 3 = 0 OR location_flag = 1"))
def correct_stored(spark, d):
    """A point without is_valid counts as valid."""
    return correction.correct_stored(_stored_points(spark, d)).select("event_id", "plate_number", "day", r("score", 6).alias("score"))


@query(on_points(f"SELECT m.day, m.plate_number, count(*) AS point_count, count(*) FILTER (m.road_id <> 'unknown') AS on_road, round(min(m.longitude), 6) AS min_lon, round(max(m.longitude), 6) AS max_lon, round(min(m.latitude), 6) AS min_lat, round(max(m.latitude), 6) AS max_lat, 'matched_trajectory' AS type FROM matched m SEMI JOIN ({_MOVED}) v USING (event_id) GROUP BY m.day, m.plate_number", ROADS, _VERTICES, _GRID, _CONTEXT))
def matched_trajectory_build(spark, d):
    p, lines = points(spark, d).drop("road_id", "road_type"), roads.polylines(segments(spark, d))
    built = service.build(p, lines, size=_SIZE)
    known = F.size(F.filter("trajectory_points", lambda x: x["road_id"] != "unknown"))
    return built.select("day", "plate_number", "point_count", known.cast("long").alias("on_road"), *[r(f"bbox.{c}", 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")], "type")


@query(on_points("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN speed END, 0) AS speed, coalesce(CASE WHEN event_id % 5 <> 0 THEN heading END, 0) AS heading, coalesce(CASE WHEN event_id % 6 <> 0 THEN location_flag = 1 END, false) AS is_valid, '' AS source_file FROM gps_points WHERE event_id % 7 <> 0"))
def field_defaults(spark, d):
    gap = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    p = points(spark, d).withColumns({"speed": gap(4, F.col("speed")), "heading": gap(5, F.col("heading")), "is_valid": gap(6, F.col("location_flag") == 1), "latitude": gap(7, F.col("latitude"))})
    return filters.completed(p, valid=False).select("event_id", "speed", "heading", "is_valid", "source_file")


@query(on_points("SELECT event_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM gps_points"))
def flat_location(spark, d):
    location = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return readers.flat_location(points(spark, d).select("event_id", location.alias("location"))).select("event_id", r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"))


@query(on_points("SELECT event_id, row_number() OVER (PARTITION BY day, plate_number ORDER BY t NULLS LAST, event_id) AS seq FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN datetime END AS t FROM gps_points)"))
def unknown_times_last(spark, d):
    p = points(spark, d).withColumn("datetime", F.when(F.col("event_id") % 5 != 0, F.col("datetime")))
    return seq.numbered(p).select("event_id", F.col("seq").cast("long").alias("seq"))


@query(on_points("SELECT plate_number, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place FROM gps_points GROUP BY plate_number"))
def plates_in_order(spark, d):
    return service.plates_in_order(points(spark, d))


@query(on_points("SELECT t.event_id AS task_id, p.event_id FROM gps_points p JOIN (SELECT event_id, day, plate_number FROM gps_points WHERE speed = 0) t USING (day, plate_number)"))
def task_navigation(spark, d):
    """A task for each standstill, of the vehicle and day it fell on."""
    p = points(spark, d)
    trajectories = p.select(*seq.KEYS).distinct().withColumn("trajectory_id", F.concat_ws("/", *seq.KEYS))
    tasks = p.where("speed = 0").select(F.col("event_id").alias("task_id"), F.concat_ws("/", *seq.KEYS).alias("trajectory_id"))
    return service.task_points(tasks, trajectories, p).select("task_id", "event_id")


@query(on_points("SELECT day, plate_number FROM gps_points GROUP BY day, plate_number HAVING count(*) FILTER (location_flag = 0) > 0"))
def non_empty_trajectories(spark, d):
    bad = F.filter(F.collect_list(F.struct("event_id", "location_flag")), lambda x: x["location_flag"] == 0)
    return points(spark, d).groupBy(*seq.KEYS).agg(bad.alias("trajectory_points")).where(filters.has_points()).select(*seq.KEYS)


@query(on_points("SELECT event_id, road_type FROM gps_points WHERE road_type IN ('motorway', 'primary')"))
def type_list_filter(spark, d):
    return points(spark, d).where(filters.of_types("motorway", "primary", column="road_type")).select("event_id", "road_type")


@query(on_points("SELECT event_id FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'matched' ELSE 'original' END AS type FROM gps_points WHERE plate_number = 'B0005') p WHERE day = (SELECT min(day) FROM gps_points WHERE plate_number = 'B0005') AND (type = 'matched' OR NOT EXISTS (SELECT 1 FROM gps_points q WHERE q.plate_number = 'B0005' AND q.day = p.day AND q.event_id % 50 = 0))"))
def preferred_type(spark, d):
    p = points(spark, d).withColumn("type", F.when(F.col("event_id") % 50 == 0, "matched").otherwise("original"))
    return service.first_day(p, "B0005", "matched").select("event_id")


@query(on_points("SELECT event_id FROM gps_points WHERE event_id % 4 = 2 AND plate_number = 'B0009' AND datetime >= TIMESTAMP '2016-08-31 00:05:00' AND datetime <= TIMESTAMP '2016-08-31 00:35:00'"))
def task_list(spark, d):
    status = F.element_at(F.array(*map(F.lit, ["pending", "processing", "completed", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    tasks = points(spark, d).select("event_id", status.alias("status"), F.col("plate_number").alias("vehicle_id"), F.col("datetime").alias("created_at"))
    return filters.task_list(tasks, status="completed", vehicle="B0009", since="2016-08-31 00:05:00", until="2016-08-31 00:35:00").select("event_id")


@query(on_points("SELECT day, plate_number, round(min(latitude) - 0.01e0, 6) AS min_lat, round(max(latitude) + 0.01e0, 6) AS max_lat, round(min(longitude) - 0.01e0, 6) AS min_lng, round(max(longitude) + 0.01e0, 6) AS max_lng, round((min(latitude) + max(latitude)) / 2, 6) AS center_lat, round((min(longitude) + max(longitude)) / 2, 6) AS center_lng FROM gps_points GROUP BY day, plate_number"))
def buffered_bounds(spark, d):
    b = service.bounds(points(spark, d), 0.01)
    return b.select("day", "plate_number", *[r(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng", "center_lat", "center_lng")])


@query(on_points(f"SELECT day, plate_number, count(*) AS total_points, round(coalesce(sum({hav('latitude', 'longitude', 'a', 'b')}), 0), 2) AS metres, CAST(max(t_sec) - min(t_sec) AS BIGINT) AS duration, round(coalesce(avg(CASE WHEN nxt IS NOT NULL THEN speed END), 0), 3) AS avg_speed, round(coalesce(max(CASE WHEN nxt IS NOT NULL THEN speed END), 0), 3) AS max_speed FROM ({_LEADS} gps_points) GROUP BY day, plate_number"))
def generic_stats(spark, d):
    s = service.statistics(points(spark, d))
    return s.select("day", "plate_number", "total_points", r("total_distance", 2).alias("metres"), "duration", r("avg_speed").alias("avg_speed"), r("max_speed").alias("max_speed"))


@query(on_points("SELECT a.points, a.processed, a.skipped, b.anomalous, c.saved_points, c.saved, b.good - c.saved_points AS duplicates FROM (SELECT count(*) AS points, count(DISTINCT (day, plate_number)) AS processed, count(*) FILTER (location_flag = 0) AS skipped FROM gps_points) a, (SELECT count(*) FILTER (score > 0.6e0 OR n = 1) AS good, count(*) FILTER (NOT (score > 0.6e0 OR n = 1)) AS anomalous FROM scored) b, (SELECT count(*) AS saved_points, count(DISTINCT (day, plate_number)) AS saved FROM corrected) c", _SCORED).replace("lead(speed) OVER (" + W + ") AS ns FROM gps_points", "lead(speed) OVER (" + W + ") AS ns FROM gps_points WHERE location_flag = 1"))
def correction_counters(spark, d):
    return service.correction_counters(points(spark, d).withColumn("is_valid", F.col("location_flag") == 1))


@query(on_points("SELECT plate_number, CASE WHEN count(*) FILTER (location_flag = 1 AND speed > 450) > 0 THEN printf('%.1f%%', round(count(*) FILTER (location_flag = 1 AND speed > 450) * 100.0e0 / count(*), 1)) ELSE '0%' END AS rate, CASE WHEN max(speed) <> 0 THEN printf('%.2f m', round(max(speed), 2)) ELSE 'N/A' END AS most FROM gps_points GROUP BY plate_number").replace("speed > 450", "speed > 200"))
def match_rate_text(spark, d):
    matched = F.count_if((F.col("location_flag") == 1) & (F.col("speed") > 200))
    return points(spark, d).groupBy("plate_number").agg(text.rate_text(matched, F.count("*")).alias("rate"), text.figure_text(F.max("speed"), "m").alias("most"))


@query("WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.b.TXT' WHEN 1 THEN 'Track.gpx' WHEN 2 THEN 'noext' ELSE 'x.CSV' END AS name FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'gpx' WHEN 2 THEN '' ELSE 'csv' END AS extension, CASE event_id % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'Track' WHEN 2 THEN 'noext' ELSE 'x' END AS stem, CASE event_id % 4 WHEN 0 THEN 'a.b_7.txt' WHEN 1 THEN 'Track_7.gpx' WHEN 2 THEN 'noext_7.' ELSE 'x_7.csv' END AS fresh FROM n")
def file_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, ["a.b.TXT", "Track.gpx", "noext", "x.CSV"])), (F.col("event_id") % 4 + 1).cast("int"))
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", name.alias("name"))
    return e.select("event_id", text.extension(F.col("name")).alias("extension"), text.stem(F.col("name")).alias("stem"), text.unique_name(F.col("name"), F.lit("7")).alias("fresh"))


@query("SELECT event_id, CASE event_id % 9 WHEN 4 THEN 'transaction' WHEN 5 THEN 'transaction' WHEN 6 THEN 'transaction' ELSE 'continuous_trajectory' END AS category, printf('%.6f', value) AS place FROM events")
def source_category(spark, d):
    kinds = ["taxi_gps", "bus_gps", "gpx", "csv", "bus_card", "metro_card", "taxi_transaction", "other", ""]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.category(kind).alias("category"), text.coordinate_text(F.col("value")).alias("place"))



def _whole() -> None:
    """The modules that add queries to those above."""
    from . import queries_roads, queries_runs  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _whole()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _whole()
    return dict(_SQL)
