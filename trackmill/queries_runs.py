"""Queries over stores that are written in batches: matching tasks and their runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import ROADS
from .operators import sequence as seq
from .plans.runs import Runs
from .queries import _NEAREST, _folder, on_points, points, query, r, segments
from .sources import readers, sinks

#: trajectories of two vehicles in three, matched by one of two settings; some that do not exist
_TASKS = """task AS (
  SELECT day || '/' || plate_number AS id, day, plate_number, max(user_id) % 3 AS kind FROM gps_points GROUP BY day, plate_number
), asked AS (
  SELECT 't/' || id AS task_id, day, plate_number, CASE kind WHEN 0 THEN 500 ELSE 250 END AS reach, kind FROM task WHERE kind < 2
)"""


@query(on_points("""SELECT task_id, 'completed' AS status, 100e0 AS progress, count(m) AS matched_points_count, count(*) - count(m) AS unmatched_points_count, round(coalesce(avg(1 - m / reach), 0), 6) AS accuracy, CAST(NULL AS VARCHAR) AS error_message FROM (
  SELECT task_id, reach, CASE WHEN m <= reach THEN m END AS m FROM asked JOIN gps_points USING (day, plate_number) LEFT JOIN (SELECT event_id, m FROM nearest JOIN gps_points USING (event_id) WHERE speed <= 200) USING (event_id)) GROUP BY task_id
UNION ALL SELECT 'gone/' || id, 'failed', 0e0, 0, 0, NULL, 'the trajectory has no points' FROM task WHERE kind = 2""", ROADS, _NEAREST, _TASKS))
def task_runs(spark, d):
    """Tasks queued twice, a run that fails, one that goes through, and both again: what the log tells in the end."""
    runs, p, roads_ = Runs(spark, _folder(spark)), points(spark, d), segments(spark, d)
    each = p.groupBy(*seq.KEYS).agg((F.max("user_id") % 3).alias("kind")).withColumn("id", F.concat_ws("/", *seq.KEYS))
    gone = F.col("kind") == 2
    tasks = each.select(
        F.concat(F.when(gone, "gone/").otherwise("t/"), "id").alias("task_id"), F.when(gone, F.concat("id", F.lit("/none"))).otherwise(F.col("id")).alias("trajectory_id"),
        F.lit("distance_matching").alias("algorithm"), F.when(F.col("kind") == 0, '{"max_distance": 500.0}').otherwise('{"max_distance": 250.0}').alias("parameters"),
    )

    def broken(*_):
        raise RuntimeError("no roads today")

    for batch in ("a", "b"):
        runs.submit(batch, tasks)
    for _ in range(2):
        runs.run("first", p, roads_, {"distance_matching": broken})
        runs.run("second", p, roads_)
    return runs.status().select("task_id", "status", "progress", "matched_points_count", "unmatched_points_count", r("accuracy", 6).alias("accuracy"), "error_message")


@query(on_points("SELECT 't/' || day || '/' || plate_number AS task_id, event_id, segment_id, round(longitude, 6) AS original_longitude, round(lon, 6) AS matched_longitude, round(m, 3) AS distance, road_type FROM (SELECT event_id, segment_id, lat, lon, m FROM nearest WHERE m <= 300) JOIN gps_points p USING (event_id) JOIN (SELECT segment_id, road_type AS road_type FROM road_segments) s USING (segment_id) WHERE speed <= 200 AND user_id % 2 = 0", ROADS, _NEAREST).replace("distance, road_type FROM", "distance, s.road_type AS road_type FROM"))
def task_matches(spark, d):
    """Matches that a run has stored; a later run of nothing new leaves them."""
    runs, p, roads_ = Runs(spark, _folder(spark)), points(spark, d), segments(spark, d)
    trajectory = F.concat_ws("/", *seq.KEYS)
    runs.submit("all", p.where("user_id % 2 = 0").select(F.concat(F.lit("t/"), trajectory).alias("task_id"), trajectory.alias("trajectory_id"), F.lit("distance_matching").alias("algorithm"), F.lit('{"max_distance": 300.0}').alias("parameters")))
    for run in ("one", "two"):
        runs.run(run, p, roads_)
    return runs.matches().select("task_id", "event_id", "segment_id", r("original_longitude", 6).alias("original_longitude"), r("matched_longitude", 6).alias("matched_longitude"), r("distance").alias("distance"), "road_type")


@query(on_points("SELECT kind, event_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM gps_points, (VALUES ('gpx'), ('csv'), ('txt')) AS k(kind)").replace("SELECT kind, event_id", "SELECT kind, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS at"))
def reader_dispatch(spark, d):
    """The positions in three kinds of files, read by what their names end with."""
    where, p, out = _folder(spark), points(spark, d), None
    sinks.download(p, "gpx", f"{where}/a.gpx")
    sinks.download(p.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("time"), "latitude", "longitude"), "csv", f"{where}/b.csv")
    sinks.gps_lines(p).write.text(f"{where}/c.txt")
    for name in ("a.gpx", "b.csv", "c.txt"):
        got = readers.read(spark, f"{where}/{name}").select(F.lit(name[2:]).alias("kind"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), r("longitude", 6).alias("longitude"), r("latitude", 6).alias("latitude"))
        out = got if out is None else out.union(got)
    return out
