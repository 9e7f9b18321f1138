"""Whatever Spark SQL is offered, by SQL alone."""

from pyspark.sql import functions as F

from trackmill import fixtures
from trackmill.functions import geo, sql
from trackmill.operators import matching


def test_functions_equal_the_columns(spark):
    assert {"ellipsoid_distance", "closest_point", "cells_of_box"} <= set(sql.register(spark))
    rows = [(22.5, 114.0, 22.6, 114.1), (0.0, 0.0, 0.0, 1.0), (5.0, 6.0, 5.0, 6.0), (-33.0, 179.9, -33.1, -179.9), (None, 1.0, 2.0, 3.0)]
    spark.createDataFrame(rows, "a double, b double, c double, d double").createOrReplaceTempView("places")
    got = spark.sql("SELECT ellipsoid_distance(a, b, c, d) AS e, haversine(a, b, c, d) AS h, closest_point(22.55, 114.02, a, b, c, d) AS p, to_mercator(a, b) AS m FROM places")
    want = spark.table("places").select(geo.vincenty("a", "b", "c", "d").alias("e"), geo.haversine("a", "b", "c", "d").alias("h"), geo.closest(F.lit(22.55), F.lit(114.02), "a", "b", "c", "d").alias("p"), geo.to_mercator("a", "b").alias("m"))
    for x, y in zip(got.collect(), want.collect(), strict=True):
        for u, v in ((x.e, y.e), (x.h, y.h), (x.p and x.p.lat, y.p and y.p.lat), (x.p and x.p.lon, y.p and y.p.lon), (x.m and x.m.x, y.m and y.m.x), (x.m and x.m.y, y.m and y.m.y)):
            assert (u is None and v is None) or abs(u - v) < 1e-6
    cells = spark.sql("SELECT * FROM cells_of_box(22.495, 22.515, 113.995, 114.005, 0.01)").collect()
    assert sorted((r.gx, r.gy) for r in cells) == [(x, y) for x in (11399, 11400) for y in (2249, 2250, 2251)]


def test_algorithms_are_views(spark, small):
    p, s = fixtures.gps_points(spark, small), fixtures.road_segments(spark, small)
    assert set(sql.register_matching(p, s, distance_matching={"max_distance": 300.0})) == {f"match_{n}" for n in matching.available()}
    assert {r.name for r in spark.sql("SELECT name FROM match_algorithms WHERE settings LIKE '%max_distance%'").collect()} == set(matching.available())
    for name, own in (("distance_matching", {"max_distance": 300.0}), ("hmm", {})):
        got = spark.sql(f"SELECT event_id, segment_id FROM match_{name}").collect()
        want = matching.create(name, **own)(p, s).select("event_id", "segment_id").collect()
        assert sorted(got) == sorted(want) and got
