import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_geo import haversine
from trackmill import fixtures
from trackmill.operators import correction, filters, matching, roads, stateful
from trackmill.operators import sequence as seq
from trackmill.plans import service


@pytest.fixture(scope="module")
def points(spark, small):
    return fixtures.gps_points(spark, small).cache()


@pytest.fixture(scope="module")
def segments(spark, small):
    return fixtures.road_segments(spark, small).cache()


def vehicles(points):
    out = {}
    for p in sorted(points.collect(), key=lambda p: (p.datetime, p.event_id)):
        out.setdefault((p.day, p.plate_number), []).append(p)
    return out


def test_outliers_follow_the_last_kept_row(points):
    want = set()
    for rows in vehicles(points).values():
        last = None
        for p in rows:
            if last is None or (p.speed <= 200 and haversine(last.latitude, last.longitude, p.latitude, p.longitude) <= 2500):
                want.add(p.event_id)
                last = p
    assert {r.event_id for r in stateful.without_outliers(points, metres=2500.0).collect()} == want


def near(p, s):
    dx, dy = s.end_lon - s.start_lon, s.end_lat - s.start_lat
    t = max(0, min(1, ((p.longitude - s.start_lon) * dx + (p.latitude - s.start_lat) * dy) / (dx * dx + dy * dy)))
    return round(haversine(p.latitude, p.longitude, s.start_lat + t * dy, s.start_lon + t * dx), 9)


def touches(a, b):
    ends = lambda s: ((s.start_lat, s.start_lon), (s.end_lat, s.end_lon))
    return any(abs(x[0] - y[0]) < 1e-6 and abs(x[1] - y[1]) < 1e-6 for x in ends(a) for y in ends(b))


def test_greedy_equals_a_plain_fold(points, segments):
    few = points.where("user_id < 3")
    ss, want = segments.collect(), {}
    by = {a.segment_id: [b for b in ss if touches(a, b)] for a in ss}
    for rows in vehicles(few).values():
        last = None
        for i, p in enumerate(rows):
            if p.speed > 200:
                continue
            d, k = min((near(p, s), s.segment_id) for s in (by[last] if last and i else ss))
            if d <= 1000:
                want[p.event_id] = last = k
    got = {r.event_id: r.segment_id for r in matching.create("greedy")(few, segments).collect()}
    assert got == want and len(want) > 20


def test_viterbi_equals_plain_products(points, segments):
    few = points.where("user_id < 3 AND speed <= 200")
    ss, want = sorted(segments.collect(), key=lambda s: s.segment_id), {}
    by = {a.segment_id: [b.segment_id for b in ss if b.segment_id != a.segment_id and touches(a, b)] for a in ss}
    for rows in vehicles(few).values():
        score, back, seen = {}, [], []
        for t, p in enumerate(rows):
            w = {s.segment_id: math.exp(-0.5 * (near(p, s) / 500) ** 2) for s in ss if near(p, s) <= 1500}
            chance = {k: v / sum(w.values()) for k, v in w.items()}
            seen.append(chance)
            if t == 0:
                score = {k: math.log(v) for k, v in chance.items()}
                back.append({})
                continue
            best = {}
            for b in chance:
                options = [(round(score[a] - math.log(len(by[a])), 9), a, score[a] - math.log(len(by[a]))) for a in score if b in by[a] and 1 / len(by[a]) >= 0.1]
                if options:
                    best[b] = min(options, key=lambda o: (-o[0], o[1]))
            score, before = {b: s + math.log(chance[b]) for b, (_, _, s) in best.items()}, {b: a for b, (_, a, _) in best.items()}
            back.append(before)
        if score:
            k = min(score, key=lambda b: (-round(score[b], 9), b))
            for t in range(len(rows) - 1, -1, -1):
                want[rows[t].event_id] = k
                k = back[t].get(k)
    got = {r.event_id: r.segment_id for r in matching.create("gotrackit", max_distance=1500.0)(few, segments).collect()}
    assert got == want and len(want) > 20


def test_a_fast_point_empties_a_viterbi_path(points, segments):
    few = points.where("user_id = 1 AND day = '01'")
    fast = few.withColumn("speed", F.when(F.col("event_id") == few.agg(F.min("event_id")).first()[0], 500.0).otherwise(10.0))
    assert matching.create("gotrackit")(fast, segments).count() == 0


def test_grid_search_equals_brute_force_at_any_reach(points, segments):
    some, ss = points.where("event_id < 60"), segments.collect()
    for reach in (50.0, 700.0, 20000.0):
        got = {r.event_id: r.segment_id for r in roads.nearest_segment(some, segments, reach).collect()}
        want = {p.event_id: m[1] for p in some.collect() if (m := min((near(p, s), s.segment_id) for s in ss))[0] <= reach}
        assert got == want


def unwrapped(p, s):
    """Distance to a segment in plain degrees, on the side where it is."""
    lons = (s[3], s[3] + 360, s[3] - 360)
    end = min(lons, key=lambda x: abs(x - s[2]))
    out = []
    for lon in (p[2], p[2] + 360, p[2] - 360):
        dx, dy = end - s[2], s[4] - s[1]
        t = max(0, min(1, ((lon - s[2]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy)))
        out.append((abs(lon - s[2]), haversine(p[1], lon, s[1] + t * dy, s[2] + t * dx)))
    return min(out)[1]


@pytest.mark.parametrize("reach", [800.0, 3000.0])
def test_segments_near_the_poles_and_across_180_degrees(spark, reach):
    rng = random.Random(4)
    ends, points = [], []
    for i in range(240):
        lat, lon = rng.choice([-85.0, -60.5, 0.0, 61.0, 75.0, 85.0, 89.0]), rng.choice([-180.0, 179.99, 0.0, 114.0])
        jitter = lambda k: rng.uniform(-k, k)
        wide = 0.02 / max(0.02, math.cos(math.radians(lat)))
        a, b = lat + jitter(0.02), lon + jitter(wide)
        wrap = lambda x: (x + 180) % 360 - 180
        ends.append((f"s{i:03d}", a, wrap(b), wrap(b + jitter(wide)), a + jitter(0.01)))
        points.append((i, lat + jitter(0.03), wrap(lon + jitter(wide))))
    p = spark.createDataFrame(points, "event_id long, latitude double, longitude double")
    s = spark.createDataFrame([(e[0], e[1], e[2], e[4], e[3]) for e in ends], "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double")
    got = {r.event_id: (round(r.distance, 5), -180 <= r.matched_lon <= 180) for r in roads.nearest_segment(p, s, reach).collect()}
    want = {x[0]: (round(m, 5), True) for x in points if (m := min(unwrapped(x, e) for e in ends)) <= reach}
    assert got == want and len(want) > 60


def test_vertices_across_180_degrees(spark):
    rng = random.Random(8)
    places = [(i, rng.choice([-70.0, 0.0, 84.0]) + rng.uniform(-1, 1), rng.choice([179.5, -179.5, 10.0]) + rng.uniform(-1, 1)) for i in range(120)]
    wrap = lambda x: (x + 180) % 360 - 180
    corners, points = [(i, a, wrap(b)) for i, a, b in places[:80]], [(i, a, wrap(b)) for i, a, b in places[80:]]
    got = roads.nearest_vertex(spark.createDataFrame(points, "event_id long, latitude double, longitude double"), spark.createDataFrame(corners, "vertex_id long, lat double, lon double"))
    want = {p[0]: min((round(haversine(p[1], p[2], c[1], c[2]), 6), c[0]) for c in corners)[1] for p in points}
    assert {r.event_id: r.vertex_id for r in got.collect()} == want


def test_road_fixture_grows(spark, tmp_path):
    spark.range(4500).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    s = fixtures.road_segments(spark, str(tmp_path))
    assert s.count() == s.select("segment_id").distinct().count() == s.select("start_lat", "start_lon", "end_lat", "end_lon").distinct().count() == 4500


def test_far_points_still_find_a_vertex(spark, segments):
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 22.5, 113.8), (3, -60.0, -100.0)], "event_id long, latitude double, longitude double")
    assert matching.vertex_match(far, roads.polylines(segments)).count() == 3


def test_votes(spark):
    row = "event_id long, segment_id string, matched_lat double, matched_lon double, distance double, confidence double"
    a, b, c = (spark.createDataFrame([(1, s, 1.0, 1.0, 5.0, q)], row) for s, q in (("x", 0.2), ("y", 0.9), ("x", 0.4)))
    pick = lambda **o: matching.vote({"a": a, "b": b, "c": c}, **o).first().segment_id
    assert pick() == "x" and pick(method="confidence") == "y" and pick(method="weighted", weights={"b": 5.0}) == "y"
    assert matching.vote({"a": a, "b": b}, "majority").first().segment_id == "y"


def test_registry():
    assert matching.available() == ["distance_matching", "ensemble", "gotrackit", "greedy", "hmm"]
    with pytest.raises(ValueError):
        matching.create("no such")
    matching.register("own", lambda p, s: p, reach=3)
    assert matching.info("own")["defaults"] == {"reach": 3}
    del matching.ALGORITHMS["own"], matching.DEFAULTS["own"]


def test_short_sequences(spark, points):
    one = points.limit(1)
    assert correction.correct(one).count() == 1
    assert correction.summary(one).first().total_distance == 0
    empty = points.where("false")
    assert correction.correct(empty).count() == 0 and matching.statistics(empty.select("event_id", F.lit("s").alias("segment_id"), F.lit(1.0).alias("distance"), F.lit(1.0).alias("confidence"))).first().match_rate == 0


def test_slow_drift_vanishes(spark):
    base = spark.createDataFrame([(i, 113.0 + i * 9e-6, 22.0) for i in range(10)], "event_id long, longitude double, latitude double")
    drift = base.select("*", F.lit("01").alias("day"), F.lit("P").alias("plate_number"), F.timestamp_add("SECOND", F.col("event_id"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("datetime"))
    assert seq.moved(drift).count() == 1


def test_pages(points):
    plates = service.plates(points, None)
    n = plates.count()
    assert service.page(plates, 99, 4).count() == (n - 1) % 4 + 1 and service.page(plates, 99, 4, clamp=False).count() == 0
    assert points.where(filters.between_dates(None, "2016-08-30")).count() == 0
