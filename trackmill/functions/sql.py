"""The geographic functions and the matching algorithms for Spark SQL: temporary functions that Catalyst inlines, and views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .geo import MERCATOR, RADIUS, vincenty_sql

_ARC = "POW(SIN(RADIANS(lat2 - lat1) / 2), 2) + COS(RADIANS(lat1)) * COS(RADIANS(lat2)) * POW(SIN(RADIANS(lon2 - lon1) / 2), 2)"
_PLACES = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_SQUARE = "POW(lat2 - lat1, 2) + POW(lon2 - lon1, 2)"
_SHARE = f"IF({_SQUARE} = 0, 0D, GREATEST(0D, LEAST(1D, ((lat - lat1) * (lat2 - lat1) + (lon - lon1) * (lon2 - lon1)) / NULLIF({_SQUARE}, 0))))"
FUNCTIONS = {
    "haversine": (_PLACES, "DOUBLE", f"{2 * RADIUS}D * ASIN(SQRT(IF({_ARC} > 1, 1, {_ARC})))"),
    "bearing": (_PLACES, "DOUBLE", "PMOD(DEGREES(ATAN2(SIN(RADIANS(lon2 - lon1)) * COS(RADIANS(lat2)), COS(RADIANS(lat1)) * SIN(RADIANS(lat2)) - SIN(RADIANS(lat1)) * COS(RADIANS(lat2)) * COS(RADIANS(lon2 - lon1)))) + 360, 360)"),
    "grid_cell": ("degrees DOUBLE, size DOUBLE", "BIGINT", "CAST(FLOOR(degrees / size) AS BIGINT)"),
    "ellipsoid_distance": (_PLACES, "DOUBLE", vincenty_sql("lat1", "lon1", "lat2", "lon2")),
    "closest_point": (f"lat DOUBLE, lon DOUBLE, {_PLACES}", "STRUCT<lat: DOUBLE, lon: DOUBLE>", f"NAMED_STRUCT('lat', lat1 + {_SHARE} * (lat2 - lat1), 'lon', lon1 + {_SHARE} * (lon2 - lon1))"),
    "to_mercator": ("lat DOUBLE, lon DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE>", f"NAMED_STRUCT('x', lon * {MERCATOR}D / 180, 'y', LN(TAN((lat + 90) * PI() / 360)) / (PI() / 180) * {MERCATOR}D / 180)"),
}
#: functions that give tables: the cells that a box touches
TABLES = {
    "cells_of_box": ("min_lat DOUBLE, max_lat DOUBLE, min_lon DOUBLE, max_lon DOUBLE, size DOUBLE", "gx BIGINT, gy BIGINT", "SELECT x.gx, y.gy FROM (SELECT EXPLODE(SEQUENCE(CAST(FLOOR(min_lon / size) AS BIGINT), CAST(FLOOR(max_lon / size) AS BIGINT))) AS gx) x CROSS JOIN (SELECT EXPLODE(SEQUENCE(CAST(FLOOR(min_lat / size) AS BIGINT), CAST(FLOOR(max_lat / size) AS BIGINT))) AS gy) y"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (arguments, kind, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({kind}) RETURN {body}")
    return sorted([*FUNCTIONS, *TABLES])


def register_matching(points: DataFrame, segments: DataFrame, **settings: dict) -> list[str]:
    """A view match_<algorithm> of every algorithm's results on these points, worked out when it is read, and the view match_algorithms of their names, descriptions and settings. settings: by algorithm, what differs from its defaults."""
    from ..operators import matching  # the algorithms use the functions beside this module

    spark, told = points.sparkSession, []
    for name in matching.available():
        # a view is as long as its points, which a join with it would broadcast by the size of compressed files
        matching.create(name, **settings.get(name, {}))(points, segments).hint("merge").createOrReplaceTempView(f"match_{name}")
        about = matching.info(name)
        told.append((name, about["description"], json.dumps(about["defaults"] | settings.get(name, {}), sort_keys=True)))
    spark.createDataFrame(told, "name string, description string, settings string").createOrReplaceTempView("match_algorithms")
    return [f"match_{name}" for name in matching.available()]
