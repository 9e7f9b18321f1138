import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackmill.functions import geo
from trackmill.operators import filters, stateful


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def haversine(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.RADIUS * math.asin(min(1, math.sqrt(x)))


def test_distances(spark):
    r = one(spark, geo.haversine(0, 0, 0, 1).alias("h"), geo.haversine(39.9087, 116.3974, 39.9087, 116.3974).alias("z"), geo.vincenty(0, 0, 0, 1).alias("v"), geo.vincenty(1, 1, 1, 1).alias("w"), geo.haversine(F.lit(None).cast("double"), 0, 0, 1).alias("n"))
    assert r.h == pytest.approx(111194.93, abs=0.01) and r.z == 0 and r.v == pytest.approx(111319.491, abs=0.001) and r.w == 0 and r.n is None


def test_bearings_and_midpoint(spark):
    r = one(spark, geo.bearing(0, 0, 1, 0).alias("n"), geo.bearing(0, 0, 0, 1).alias("e"), geo.bearing(0, 0, -1, 0).alias("s"), geo.bearing(0, 0, 0, -1).alias("w"), geo.midpoint(0, 0, 0, 10).alias("m"))
    assert [round(x, 9) for x in (r.n, r.e, r.s, r.w)] == [0, 90, 180, 270] and (round(r.m.lat, 9), round(r.m.lon, 9)) == (0, 5)


def test_projection_ends_and_degenerate(spark):
    r = one(spark, geo.project(0.5, 0.5, 0, 0, 0, 1).alias("mid"), geo.project(0, 5, 0, 0, 0, 1).alias("end"), geo.project(1, 1, 0, 0, 0, 0).alias("dot"))
    assert (r.mid.lat, r.mid.lon) == (0, 0.5) and (r.end.lat, r.end.lon) == (0, 1) and (r.dot.lat, r.dot.lon) == (0, 0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-80, 80)] * 2, *[st.floats(-170, 170)] * 2), min_size=1, max_size=30))
def test_haversine_is_symmetric_and_mercator_returns(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, x double, y double")
    m = geo.to_mercator("a", "x")
    for r in df.select("*", geo.haversine("a", "x", "b", "y").alias("d"), geo.haversine("b", "y", "a", "x").alias("e"), geo.from_mercator(m["x"], m["y"]).alias("m")).collect():
        assert r.d == pytest.approx(haversine(r.a, r.x, r.b, r.y), abs=1e-3) and r.d == pytest.approx(r.e, abs=1e-6) and r.d >= 0
        assert (r.m.lat, r.m.lon) == (pytest.approx(r.a, abs=1e-6), pytest.approx(r.x, abs=1e-6))


def test_area_probes(spark):
    box = [[(113.812401, 22.503099), (114.269966, 22.503099), (114.269966, 22.748068), (113.812401, 22.748068)]]
    df = spark.createDataFrame([(114.0579, 22.5431), (113.0, 23.0), (114.1, 22.6), (115.0, 25.0)], "longitude double, latitude double")
    assert [r[0] for r in df.select(filters.in_area(box)).collect()] == [True, False, True, False]
    assert df.where(filters.in_area(None, default_area=True)).count() == 0 and df.where(filters.in_area(None)).count() == 4


def test_wkt(spark):
    assert filters.parse_wkt("POLYGON((0 0, 1 0, 1 1))") == [[[(0, 0), (1, 0), (1, 1)]]]
    assert len(filters.parse_wkt("MULTIPOLYGON(((0 0, 1 0, 1 1)), ((5 5, 6 5, 6 6), (5.1 5.1, 5.2 5.1, 5.2 5.2)))")[1]) == 2
    assert filters.parse_wkt("POINT(1 2)") is None and filters.parse_wkt("POLYGON((a b))") is None


def test_square_area(spark):
    ring = filters.polygons([[(0, 0), (1, 0), (1, 1), (0, 1)]])
    area = one(spark, geo.shoelace_sphere(F.get(ring, F.lit(0))).alias("a"), geo.shoelace_sphere(F.slice(F.get(ring, F.lit(0)), 1, 2)).alias("z"))
    assert area.a == pytest.approx(111194.93**2, rel=2e-4) and area.z == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 0.01), st.floats(0, 0.01)), min_size=1, max_size=40))
def test_simplified_rows_keep_ends_and_tolerance(rows):
    lat, lon = [r[0] for r in rows], [r[1] for r in rows]
    kept = stateful.simplify_rows(lat, lon, 100.0)
    assert kept[0] == 0 and kept[-1] == len(rows) - 1 and kept == sorted(set(kept))
    assert stateful.simplify_rows(lat, lon, 1e9) == sorted({0, len(rows) - 1})


def test_sql_functions_equal_the_columns(spark):
    from trackmill.functions import sql

    assert {"bearing", "grid_cell", "haversine"} <= set(sql.register(spark))
    df = spark.createDataFrame([(22.5, 114.0, 22.6, 114.2), (0.0, 0.0, 0.0, 0.0), (-10.0, 179.0, 10.0, -179.0), (1.0, None, 2.0, 3.0)], "a double, b double, c double, d double")
    for r in df.selectExpr("*", "haversine(a, b, c, d) AS h", "bearing(a, b, c, d) AS g", "grid_cell(d, 0.01D) AS k").select("h", "g", "k", geo.haversine("a", "b", "c", "d").alias("h2"), geo.bearing("a", "b", "c", "d").alias("g2"), geo.cell("d", 0.01).alias("k2")).collect():
        assert (r.h, r.g, r.k) == (r.h2 if r.h2 is None else pytest.approx(r.h2), r.g2 if r.g2 is None else pytest.approx(r.g2), r.k2)


def test_written_out_rounds_equal_the_iteration(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    pairs = [(y, x, y + rng.uniform(-1, 1) * d, x + rng.uniform(-1, 1) * d) for y, x in rows for d in (1e-7, 1e-3, 0.1, 20.0)]
    pairs += [(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 0.3, 179.7), (90.0, 0.0, -90.0, 10.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 0.0, 0.001), (None, 1.0, 2.0, 3.0), (1.0, 1.0, 2.0, None)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double").selectExpr("*", "1 AS x", "2 AS _keep")
    got = geo.with_ellipsoid(df, "m", "a", "b", "c", "d")
    assert got.columns == [*df.columns, "m"]
    for r in got.withColumn("v", geo.vincenty("a", "b", "c", "d")).collect():
        assert (r.m is None and r.v is None) or abs(r.m - r.v) < 1e-5
