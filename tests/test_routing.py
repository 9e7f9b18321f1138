"""Ways along roads and the matcher that uses them, against brute force."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest

from trackmill.operators import matching, routing

SEGMENTS = "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double"
POINTS = "day string, plate_number string, event_id long, datetime timestamp_ntz, latitude double, longitude double, speed double"
R = 6371000.0


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def closest(p, a, b):
    dx, dy = b[1] - a[1], b[0] - a[0]
    square = dx * dx + dy * dy
    t = 0 if not square else max(0, min(1, ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / square))
    return a[0] + t * dy, a[1] + t * dx


def network(rng, lat, lon, side=6, step=0.002):
    place = {(i, j): (round(lat + i * step + rng.uniform(-4, 4) * step / 20, 6), round(lon + j * step + rng.uniform(-4, 4) * step / 20, 6)) for i in range(side) for j in range(side)}
    wrapped = {k: (y, x - 360 if x >= 180 else x) for k, (y, x) in place.items()}
    pairs = [((i, j), (i + di, j + dj)) for i in range(side) for j in range(side) for di, dj in ((0, 1), (1, 0), (1, 1)) if i + di < side and j + dj < side and rng.random() < 0.6]
    return [(f"s{n}", *wrapped[a], *wrapped[b]) for n, (a, b) in enumerate(pairs)]


def shortest(segments):
    nodes = {e for s in segments for e in (s[1:3], s[3:5])}
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for s in segments:
        a, b = s[1:3], s[3:5]
        d[a, b] = d[b, a] = min(d[a, b], metres(a, b))
    for k in nodes:
        for a in nodes:
            if d[a, k] < math.inf:
                for b in nodes:
                    d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


@pytest.mark.parametrize("lat, lon", [(22.5, 114.0), (69.99, -0.003), (0.0, 179.995), (-33.0, -180.0)])
def test_routes_are_the_shortest_ways_within_reach(spark, lat, lon):
    segments = network(random.Random(int(lat)), lat, lon)
    got = {(r.origin, r.target): r.metres for r in routing.routes(spark.createDataFrame(segments, SEGMENTS).repartition(3), 900.0).collect()}
    number = {}
    for r in spark.createDataFrame([(*e,) for s in segments for e in (s[1:3], s[3:5])], "lat double, lon double").select("lat", "lon", routing.junction("lat", "lon").alias("n")).distinct().collect():
        number[r.lat, r.lon] = r.n
    assert len(set(number.values())) == len(number)
    want = {(number[a], number[b]): d for (a, b), d in shortest(segments).items() if d <= 900}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def likelihood(path, far, sigma, beta, reach):
    """The sum over a sequence of (point, segment), -inf if some step has no way."""
    total, before = 0.0, None
    for p, s in path:
        a, b = s[1:3], s[3:5]
        q = closest(p, a, b)
        total -= 0.5 * (round(metres(p, q), 3) / sigma) ** 2
        if before:
            p0, s0, q0 = before
            way = metres(q0, q) if s0 == s else min(metres(q0, e) + far[e, f] + metres(f, q) if far[e, f] <= reach else math.inf for e in (s0[1:3], s0[3:5]) for f in (a, b))
            total -= round(abs(way - metres(p0, p)), 3) / beta if way < math.inf else math.inf
        before = p, s, q
    return total


def test_hmm_finds_the_likeliest_path(spark):
    rng = random.Random(4)
    segments = network(rng, 22.5, 114.0, 5)
    far, by = shortest(segments), {s[0]: s for s in segments}
    points, begun = [], datetime(2016, 8, 31)
    for v in range(12):
        y, x = 22.5 + rng.random() * 0.008, 114.0 + rng.random() * 0.008
        for i in range(6):
            y, x = y + rng.uniform(-1, 1) * 0.0015, x + rng.uniform(-1, 1) * 0.0015
            points.append(("01", f"B{v}", v * 100 + i, begun + timedelta(seconds=i), y, x, 300.0 if rng.random() < 0.1 else 30.0))
    points += [("01", "far", 5000 + i, begun, 40.0, 100.0 + i, 20.0) for i in range(3)] + [("02", "B0", 6000, None, 22.504, 114.004, None)]
    options = {"max_distance": 130.0, "sigma": 40.0, "beta": 90.0, "reach": 700.0}
    got = {r.event_id: r for r in matching.create("hmm", **options)(spark.createDataFrame(points, POINTS).repartition(5), spark.createDataFrame(segments, SEGMENTS)).collect()}
    seen = 0
    for v in range(12):
        own = [(p[2], p[4:6]) for p in points if p[1] == f"B{v}" and p[0] == "01" and p[6] <= 200]
        near = [(e, p, [s for s in segments if metres(p, closest(p, s[1:3], s[3:5])) <= 130]) for e, p in own]
        near = [x for x in near if x[2]]
        assert {e for e, *_ in near} == {e for e, _ in own} & set(got)
        while near:  # paths end where nothing leads on
            n = next((n for n in range(len(near), 0, -1) if any(likelihood(list(zip([p for _, p, _ in near[:n]], c, strict=True)), far, 40, 90, 700) > -math.inf for c in itertools.product(*(x[2] for x in near[:n])))), 1)
            best = max(likelihood(list(zip([p for _, p, _ in near[:n]], c, strict=True)), far, 40, 90, 700) for c in itertools.product(*(x[2] for x in near[:n])))
            found = likelihood([(p, by[got[e].segment_id]) for e, p, _ in near[:n]], far, 40, 90, 700)
            assert abs(found - best) < 1e-6
            for e, p, some in near[:n]:
                own_share = [math.exp(-0.5 * (metres(p, closest(p, s[1:3], s[3:5])) / 40) ** 2) for s in some]
                mine = math.exp(-0.5 * (got[e].distance / 40) ** 2)
                assert abs(got[e].confidence - mine / sum(own_share)) < 1e-4
            seen += n
            near = near[n:]
    assert seen > 30 and 6000 in got and not any(e in got for e in range(5000, 5003))


def test_an_empty_network_or_table_matches_nothing(spark):
    points = spark.createDataFrame([("01", "a", 1, datetime(2016, 8, 31), 22.5, 114.0, 1.0)], POINTS)
    none = spark.createDataFrame([], SEGMENTS)
    assert matching.create("hmm")(points, none).collect() == []
    assert matching.create("hmm")(points.where("false"), spark.createDataFrame(network(random.Random(1), 22.5, 114.0), SEGMENTS)).collect() == []


def test_points_cross_one_exchange_by_vehicle(spark):
    points = spark.createDataFrame([("01", "a", 1, datetime(2016, 8, 31), 22.5, 114.0, 1.0)], POINTS)
    plan = matching.create("hmm")(points, spark.createDataFrame(network(random.Random(1), 22.5, 114.0), SEGMENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [day#") == 1


def test_candidates_are_made_once_and_not_in_the_join(spark):
    """No distance stands in a join's condition, where each use of a place computes it again, and junctions are found without distances."""
    points = spark.createDataFrame([("01", "a", 1, datetime(2016, 8, 31), 22.5, 114.0, 1.0)], POINTS)
    plan = matching.create("hmm")(points, spark.createDataFrame(network(random.Random(1), 22.5, 114.0), SEGMENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join " in line and "ASIN" in line.upper()]
    assert sum("from_a" in line and "Project" in line and "ASIN" in line.upper() for line in plan.split("\n")) == 1


def test_roads_that_no_point_is_near_to_are_not_searched(spark):
    near, far = network(random.Random(1), 22.5, 114.0), network(random.Random(2), 40.0, 100.0)
    segments = spark.createDataFrame([*near, *((f"x{s[0]}", *s[1:]) for s in far)], SEGMENTS)
    all_, own = (routing.routes(segments, 700.0, *x) for x in ((), (segments.where("start_lat < 30").select(routing.junction("start_lat", "start_lon").alias("origin")),)))
    wanted = {(r.origin, r.target, r.metres) for r in all_.collect()}
    found = {(r.origin, r.target, r.metres) for r in own.collect()}
    begins = {r.origin for r in segments.where("start_lat < 30").select(routing.junction("start_lat", "start_lon").alias("origin")).collect()}
    assert {r for r in wanted if r[0] in begins} <= found <= {r for r in wanted if r[0] // (360 * routing.UNIT) < 120 * routing.UNIT} < wanted


def test_many_steps_are_weighed_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    segments = spark.createDataFrame(network(rng, 22.5, 114.0, 5), SEGMENTS)
    rows = [("01", f"B{v}", v * 100 + i, datetime(2016, 8, 31) + timedelta(seconds=i), 22.5 + rng.random() * 0.008, 114.0 + rng.random() * 0.008, 30.0) for v in range(3) for i in range(40)]
    points = spark.createDataFrame(rows, POINTS)
    whole = sorted(map(tuple, matching.create("hmm", max_distance=300.0)(points, segments).collect()))
    monkeypatch.setattr(routing, "PAIRS", 7)
    assert len(whole) == 120 and sorted(map(tuple, matching.create("hmm", max_distance=300.0)(points, segments).collect())) == whole
