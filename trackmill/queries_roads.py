"""Queries over road networks: ways along roads, matching by them, and network files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import ROADS
from .functions import sql
from .operators import matching, roads, routing
from .queries import _NEAREST, _VERTICES, W, _ellipsoid, _folder, _matched, _projected, hav, on_points, on_walk, points, query, r, segments
from .sources import readers, sinks

_REACH = 4000


def _junction(lat: str, lon: str) -> str:
    return f"(CAST(floor(({lat} + 90) * 1000000 + 0.5e0) AS BIGINT) * 360000000 + CAST(floor(({lon} + 180) * 1000000 + 0.5e0) AS BIGINT) % 360000000)"


#: shortest ways between junctions, by following all of them up to the bound
_ROUTES = f"""node AS (
  SELECT segment_id, {_junction('start_lat', 'start_lon')} AS a, {_junction('end_lat', 'end_lon')} AS b, {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS len FROM road_segments
), hop AS (
  SELECT u, v, min(len) AS w FROM (SELECT a AS u, b AS v, len FROM node UNION ALL SELECT b, a, len FROM node) GROUP BY u, v
), walked AS (
  SELECT DISTINCT u, u AS v, 0e0 AS d FROM hop UNION ALL SELECT x.u, hop.v, x.d + hop.w FROM walked x JOIN hop ON hop.u = x.v WHERE x.d + hop.w <= {_REACH}
), route AS (SELECT u, v, min(d) AS d FROM walked GROUP BY u, v)"""


@query(on_walk("SELECT u AS origin, v AS target, round(d, 3) AS metres FROM route", ROADS, _ROUTES))
def road_routes(spark, d):
    return routing.routes(segments(spark, d), float(_REACH)).select("origin", "target", F.round("metres", 3).alias("metres"))


_ENDS = [(e, f) for e in "ab" for f in "ab"]
_HMM = f"""h1 AS (
  SELECT event_id, segment_id, {_projected('latitude', 'longitude', 'start_lat', 'start_lon', 'end_lat', 'end_lon')} AS k FROM gps_points, road_segments WHERE speed <= 200
), h2 AS (
  SELECT event_id, segment_id, start_lat, start_lon, end_lat, end_lon, start_lat + k * (end_lat - start_lat) AS lat, start_lon + k * (end_lon - start_lon) AS lon FROM h1 JOIN road_segments USING (segment_id)
), h3 AS (
  SELECT p.event_id, day, plate_number, datetime, latitude, longitude, segment_id, lat, lon, {hav('latitude', 'longitude', 'lat', 'lon')} AS m,
         {hav('start_lat', 'start_lon', 'lat', 'lon')} AS fa, {hav('lat', 'lon', 'end_lat', 'end_lon')} AS fb, node.a, node.b
  FROM h2 JOIN gps_points p USING (event_id) JOIN node USING (segment_id)
), h4 AS (
  SELECT event_id, day, plate_number, latitude AS y, longitude AS x, row_number() OVER ({W}) AS i, cand FROM (
    SELECT event_id, day, plate_number, datetime, latitude, longitude,
           list({{'id': segment_id, 'm': m, 'lat': lat, 'lon': lon, 'fa': fa, 'fb': fb, 'a': a, 'b': b, 's': -0.5e0 * power(round(m, 3) / 50e0, 2)}} ORDER BY segment_id) AS cand
    FROM h3 WHERE m <= 1000 GROUP BY ALL)
), h5 AS (
  SELECT q.event_id, t.t AS t, s.s AS s, {hav('p.y', 'p.x', 'q.y', 'q.x')} AS straight
  FROM h4 p JOIN h4 q ON p.day = q.day AND p.plate_number = q.plate_number AND q.i = p.i + 1, unnest(p.cand) AS s(s), unnest(q.cand) AS t(t)
), h6 AS (
  SELECT event_id, s.id AS f, t.id AS g, straight, CASE WHEN s.id = t.id THEN {hav('s.lat', 's.lon', 't.lat', 't.lon')} ELSE least({', '.join(f"s.f{e} + r{e}{f}.d + t.f{f}" for e, f in _ENDS)}) END AS way
  FROM h5 {' '.join(f"LEFT JOIN route r{e}{f} ON r{e}{f}.u = s.{e} AND r{e}{f}.v = t.{f}" for e, f in _ENDS)}
), h7 AS (
  SELECT event_id, g, list({{'f': f, 't': round(abs(way - straight), 3) / 200e0}} ORDER BY f) AS before FROM h6 WHERE way IS NOT NULL GROUP BY event_id, g
), h8 AS (
  SELECT h4.event_id, list({{'id': g, 'before': before}}) AS steps FROM h7 JOIN h4 USING (event_id) GROUP BY h4.event_id
), paths AS (
  SELECT day, plate_number, i, list_transform(cand, lambda c: {{'id': c.id, 'score': c.s, 'path': [{{'e': event_id, 'c': c}}]}}) AS state FROM h4 WHERE i = 1
  UNION ALL
  SELECT day, plate_number, i, list_transform(CASE WHEN len(list_filter(next, lambda n: n.b IS NOT NULL)) > 0 THEN list_filter(next, lambda n: n.b IS NOT NULL) ELSE list_transform(next, lambda n: {{'c': n.c, 'b': {{'k': 0e0, 'id': '', 'path': ended}}}}) END,
         lambda n: {{'id': n.c.id, 'score': -n.b.k + n.c.s, 'path': list_append(n.b.path, {{'e': event_id, 'c': n.c}})}}) AS state
  FROM (
    SELECT day, plate_number, i, event_id, list_sort(list_transform(state, lambda s: {{'k': -s.score, 'id': s.id, 'path': s.path}}))[1].path AS ended,
           list_transform(cand, lambda c: {{'c': c, 'b': list_sort(list_filter(list_transform(coalesce(list_filter(steps, lambda z: z.id = c.id)[1].before, []), lambda v: {{'k': -(list_filter(state, lambda s: s.id = v.f)[1].score - v.t), 'id': v.f, 'path': list_filter(state, lambda s: s.id = v.f)[1].path}}), lambda v: v.k IS NOT NULL))[1]}}) AS next
    FROM (SELECT h4.day, h4.plate_number, h4.i, h4.event_id, h4.cand, coalesce(h8.steps, []) AS steps, w.state FROM paths w JOIN h4 ON h4.day = w.day AND h4.plate_number = w.plate_number AND h4.i = w.i + 1 LEFT JOIN h8 ON h8.event_id = h4.event_id))
), matched_path AS (
  SELECT unnest(list_sort(list_transform(state, lambda s: {{'k': -s.score, 'id': s.id, 'path': s.path}}))[1].path) AS p FROM (SELECT *, i = max(i) OVER (PARTITION BY day, plate_number) AS last FROM paths) WHERE last
)"""


@query(on_walk("SELECT p.e AS event_id, p.c.id AS segment_id, round(p.c.lat, 6) AS matched_lat, round(p.c.lon, 6) AS matched_lon, round(p.c.m, 3) AS distance, round(exp(p.c.s) / list_sum(list_transform(cand, lambda c: exp(c.s))), 6) AS confidence FROM matched_path JOIN h4 ON h4.event_id = p.e", ROADS, _ROUTES, _HMM))
def hmm_match(spark, d):
    return _matched(matching.create("hmm", reach=float(_REACH))(points(spark, d), segments(spark, d)))


# ------------------------------------------------------------------------ network files


@query(f"WITH {ROADS}, {_VERTICES} SELECT road_id, road_type, CAST(len(c) AS INTEGER) AS n, round(c[1][1], 6) AS lon, round(c[1][2], 6) AS lat FROM line WHERE road_type IN ('motorway', 'trunk', 'primary', 'residential')")
def road_collection(spark, d):
    """All features as FeatureCollections, written and read by many tasks; then the classes of a street query."""
    where = _folder(spark)
    sinks.write_members(sinks.geojson(roads.polylines(segments(spark, d))), where)
    found = readers.highways(readers.roads_geojson(readers.collection(spark, where)))
    first = F.get("coords", F.lit(0))
    return found.select("road_id", "road_type", F.size("coords").alias("n"), r(first["x"], 6).alias("lon"), r(first["y"], 6).alias("lat"))


_WAY = "CASE WHEN road_id LIKE 'h%' THEN 1000000 ELSE 2000000 END + CAST(substr(road_id, 2) AS BIGINT)"
_CLASS = "road_type || CASE WHEN id % 4 = 1 THEN '_link' ELSE '' END"


@query(f"""WITH {ROADS}, {_VERTICES}, way AS (SELECT {_WAY} AS id, road_name, road_type, c FROM line)
SELECT 'osm_way_' || id AS road_id, CASE WHEN id % 3 = 0 THEN '未命名道路_' || id ELSE road_name END AS road_name, {_CLASS} AS road_type, CAST(len(c) AS INTEGER) AS n,
       round(c[1][1], 6) AS lon, round(c[1][2], 6) AS lat, round(c[len(c)][1], 6) AS end_lon, round(c[len(c)][2], 6) AS end_lat, id % 4 <> 1 AS kept
FROM way WHERE id % 7 <> 0""")
def overpass_roads(spark, d):
    """The network as the answer of a street query: horizontal roads with their places, vertical ones by nodes; every seventh loses all places but one."""
    where = _folder(spark)
    way = roads.polylines(segments(spark, d)).select(F.expr(_WAY).alias("id"), "road_id", "road_name", "road_type", "coords")
    way = way.withColumn("coords", F.when(F.col("id") % 7 == 0, F.slice("coords", 1, 1)).otherwise(F.col("coords")))
    tags = F.struct(F.expr(_CLASS).alias("highway"), F.when(F.col("id") % 3 != 0, F.col("road_name")).alias("name"))
    inline, named = F.col("road_id").startswith("h"), F.col("id") * 10_000
    places = F.transform("coords", lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon")))
    numbers = F.transform("coords", lambda p, i: named + i)
    ways = way.select(F.to_json(F.struct(F.lit("way").alias("type"), "id", tags.alias("tags"), F.when(inline, places).alias("geometry"), F.when(~inline, numbers).alias("nodes"))).alias("value"))
    nodes = way.where(~inline).select("id", F.posexplode("coords").alias("i", "p")).select(F.to_json(F.struct(F.lit("node").alias("type"), (named + F.col("i")).alias("id"), F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))).alias("value"))
    sinks.write_members(ways.union(nodes), where, '{"version":0.6,"elements":[')
    found = readers.overpass(spark, where)
    kept = readers.highways(found).select("road_id", F.lit(True).alias("kept"))
    a, b = F.get("coords", F.lit(0)), F.element_at("coords", -1)
    return found.join(kept, "road_id", "left").select(
        "road_id", "road_name", "road_type", F.size("coords").alias("n"), r(a["x"], 6).alias("lon"), r(a["y"], 6).alias("lat"), r(b["x"], 6).alias("end_lon"), r(b["y"], 6).alias("end_lat"), F.coalesce("kept", F.lit(False)).alias("kept"),
    )


@query(f"WITH {ROADS}, {_VERTICES} SELECT road_id, kind, CAST(len(c) - CASE WHEN kind = 'first' THEN len(c) - len(c) // 2 WHEN kind = 'rest' THEN len(c) // 2 ELSE 0 END AS INTEGER) AS n, round(c[CASE WHEN kind = 'rest' THEN len(c) // 2 + 1 ELSE 1 END][1], 6) AS lon FROM line, (VALUES ('whole'), ('first'), ('rest')) AS k(kind) WHERE kind = 'whole' OR (kind = 'first' AND len(c) // 2 >= 2) OR (kind = 'rest' AND len(c) - len(c) // 2 >= 2)")
def merged_parts(spark, d):
    """Each road as a feature of two parts: read as one road, and as roads of their own."""
    coordinates = F.transform("coords", lambda p: F.array(p["x"], p["y"]))
    half = F.floor(F.size("coords") / 2).cast("int")
    parts_ = F.array(F.slice(coordinates, F.lit(1), half), F.slice(coordinates, half + 1, F.size("coords") - half))
    lines = roads.polylines(segments(spark, d))
    features = lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("road_id").alias("id"), F.struct(F.lit("MultiLineString").alias("type"), parts_.alias("coordinates")).alias("geometry"))).alias("value"))
    first = r(F.get("coords", F.lit(0))["x"], 6)
    whole = readers.roads_geojson(features, merge_parts=True).select("road_id", F.lit("whole").alias("kind"), F.size("coords").alias("n"), first.alias("lon"))
    start = F.get("coords", F.lit(0))
    ends = lines.select("road_id", start.alias("begin"))
    own = readers.roads_geojson(features).select("road_id", F.size("coords").alias("n"), first.alias("lon"), start.alias("start")).join(ends, "road_id")
    return whole.union(own.select("road_id", F.when(F.col("start") == F.col("begin"), "first").otherwise("rest"), "n", "lon"))


_SQL_MATCH = """SELECT e.event_id, m.segment_id, round(ellipsoid_distance(e.latitude, e.longitude, m.matched_lat, m.matched_lon), 2) AS metres
FROM sql_points e JOIN match_distance_matching m ON e.event_id = m.event_id"""


@query(on_points("SELECT event_id, segment_id, round(coalesce(metres, 0), 2) AS metres FROM (SELECT event_id, segment_id FROM nearest WHERE m <= 300) JOIN gps_points p USING (event_id) LEFT JOIN ell USING (event_id) WHERE speed <= 200", ROADS, _NEAREST, "ends AS (SELECT event_id, lat AS latitude, lon AS longitude, latitude AS a, longitude AS b FROM nearest JOIN (SELECT event_id, latitude, longitude FROM gps_points) USING (event_id))", _ellipsoid("ends")))
def sql_surface(spark, d):
    """Matches and their distances on the ellipsoid, asked for in SQL alone."""
    p = points(spark, d)
    sql.register(spark)
    sql.register_matching(p, segments(spark, d), distance_matching={"max_distance": 300.0})
    p.createOrReplaceTempView("sql_points")
    return spark.sql(_SQL_MATCH)
