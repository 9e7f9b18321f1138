"""Vehicle positions and roads derived from the test tables, the same way in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters

START = 1704067200000000


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per event: 30 days squeezed into 43 minutes, so that steps have plausible speeds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - START) / F.lit(1e9)).cast("long")
    e = e.withColumn("t_sec", t)
    u, i, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    types = F.element_at(F.array(*map(F.lit, ["motorway", "trunk", "primary", "residential"])), (u % 4 + 1).cast("int"))
    return e.select(
        "event_id",
        "user_id",
        F.concat(F.lit("B"), F.lpad(u.cast("string"), 4, "0")).alias("plate_number"),
        F.concat(F.lit("0"), (F.floor(F.col("t_sec") / 864) + 1).cast("string")).alias("day"),
        "t_sec",
        F.timestamp_add("SECOND", F.col("t_sec"), F.lit("2016-08-31 00:00:00").cast("timestamp_ntz")).alias("datetime"),
        (F.lit(113.85) + (u % 30) * 5 / F.lit(1000.0) + F.col("t_sec") * F.lit(0.0001) + F.when(kind == "error", 0.02).otherwise(0.0) + (i % 7) * F.lit(0.00001)).alias("longitude"),
        (F.lit(22.52) + (u % 10) * 2 / F.lit(100.0) + (i % 11 - 5) * F.lit(0.0001)).alias("latitude"),
        F.when(kind == "signup", 0.0).otherwise(F.least("value", F.lit(250.0))).alias("speed"),
        (i * 37 % 360).cast("double").alias("heading"),
        F.when((kind == "purchase") & (i % 5 == 0), 0).otherwise(1).alias("location_flag"),
        F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("r"), (i % 5).cast("string"))).alias("road_id"),
        types.alias("road_type"),
    )


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street grid: 2000 segments make a tile of 40 by 25 blocks, a hundred tiles a row of them, and roads go on from tile to tile."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    k = F.col("p_partkey")
    tile = F.floor(k / 2000)
    p = p.withColumn("x", k % 40 + tile % 100 * 40).withColumn("y", F.floor(k / 40) % 25 + F.floor(tile / 100) * 25).withColumn("o", F.floor(k / 1000) % 2)
    x, y, flat = F.col("x"), F.col("y"), F.col("o") == 0
    types = F.element_at(F.array(*map(F.lit, ["motorway", "trunk", "primary", "residential"])), (F.when(flat, y).otherwise(x) % 4 + 1).cast("int"))
    lon = lambda c: F.lit(113.8) + c * F.lit(0.0125)
    lat = lambda c: F.lit(22.5) + c * F.lit(0.0125)
    return p.select(
        F.concat(F.lit("s"), k.cast("string")).alias("segment_id"),
        F.when(flat, F.concat(F.lit("h"), y.cast("string"))).otherwise(F.concat(F.lit("v"), x.cast("string"))).alias("road_id"),
        F.when(flat, x).otherwise(y).cast("long").alias("seq"),
        lat(y).alias("start_lat"),
        lon(x).alias("start_lon"),
        lat(F.when(flat, y).otherwise(y + 1)).alias("end_lat"),
        lon(F.when(flat, x + 1).otherwise(x)).alias("end_lon"),
        F.col("p_brand").alias("road_name"),
        types.alias("road_type"),
    )


#: one part and one ring each: the survey's default rectangle, and a concave and a two-part area around the city
AREAS = {
    "default": filters.DEFAULT_AREA,
    "concave": [[(113.90, 22.51), (114.20, 22.51), (114.20, 22.69), (114.05, 22.58), (113.90, 22.69)]],
    "parts": [[(113.86, 22.515), (113.99, 22.515), (113.99, 22.605), (113.86, 22.605)], [(114.05, 22.555), (114.25, 22.555), (114.15, 22.705)]],
}

POINTS = """
raw_points AS (
  SELECT *, CAST((epoch_us(ts) - 1704067200000000) // 1000000000 AS BIGINT) AS t_sec FROM events
), gps_points AS (
  SELECT event_id, user_id, 'B' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS plate_number, '0' || CAST(t_sec // 864 + 1 AS VARCHAR) AS day, t_sec,
         TIMESTAMP '2016-08-31 00:00:00' + to_seconds(t_sec) AS datetime,
         113.85e0 + (user_id % 30) * 5 / 1000.0e0 + t_sec * 0.0001e0 + CASE WHEN event_type = 'error' THEN 0.02e0 ELSE 0e0 END + (event_id % 7) * 0.00001e0 AS longitude,
         22.52e0 + (user_id % 10) * 2 / 100.0e0 + (event_id % 11 - 5) * 0.0001e0 AS latitude,
         CASE WHEN event_type = 'signup' THEN 0e0 ELSE least(value, 250e0) END AS speed,
         CAST(event_id * 37 % 360 AS DOUBLE) AS heading,
         CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 0 ELSE 1 END AS location_flag,
         CASE WHEN event_id % 9 = 0 THEN '' ELSE 'r' || CAST(event_id % 5 AS VARCHAR) END AS road_id,
         (['motorway', 'trunk', 'primary', 'residential'])[user_id % 4 + 1] AS road_type
  FROM raw_points
)"""
ROADS = """
raw_parts AS (
  SELECT *, p_partkey % 40 + p_partkey // 2000 % 100 * 40 AS x, p_partkey // 40 % 25 + p_partkey // 200000 * 25 AS y, p_partkey // 1000 % 2 AS o FROM part
), road_segments AS (
  SELECT 's' || CAST(p_partkey AS VARCHAR) AS segment_id, CASE WHEN o = 0 THEN 'h' || CAST(y AS VARCHAR) ELSE 'v' || CAST(x AS VARCHAR) END AS road_id,
         CASE WHEN o = 0 THEN x ELSE y END AS seq,
         22.5e0 + y * 0.0125e0 AS start_lat, 113.8e0 + x * 0.0125e0 AS start_lon,
         22.5e0 + (CASE WHEN o = 0 THEN y ELSE y + 1 END) * 0.0125e0 AS end_lat, 113.8e0 + (CASE WHEN o = 0 THEN x + 1 ELSE x END) * 0.0125e0 AS end_lon,
         p_brand AS road_name, (['motorway', 'trunk', 'primary', 'residential'])[(CASE WHEN o = 0 THEN y ELSE x END) % 4 + 1] AS road_type
  FROM raw_parts
)"""
