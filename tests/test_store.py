"""Batches that count once, and matching tasks that are resumed."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trackmill.plans.runs import Runs
from trackmill.sources.store import Store, unique


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    store, df = Store(spark, f"{tmp_path}/s"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, day string")
    read = lambda t: sorted(r.k for r in store.read(t, "k int, day string").collect())
    assert read("a") == []
    assert store.append("one", {"a": df, "b": df.where("k = 1")}, {"a": ["day"]})
    assert not store.append("one", {"a": df})
    assert read("a") == [1, 2] and read("b") == [1] and store.batches() == ["one"]
    folder = store.stage("a", df)  # a writer that died before its commit
    assert read("a") == [1, 2]
    with pytest.raises(Exception, match="boom"):  # one that died between two tables
        store.append("two", {"a": df, "b": df.select(F.raise_error(F.lit("boom")).cast("int").alias("k"), "day")})
    assert read("a") == [1, 2] and read("b") == [1]
    assert store.append("two", {"a": df.limit(1)}, {"a": ["day"]}) and len(read("a")) == 3
    assert store.commit("three", {"a": folder}, replace=True) and read("a") == [1, 2] and read("b") == []
    with pytest.raises(ValueError):
        store.append("../x", {"a": df})


def test_one_row_a_key(spark):
    rows = [("p", 1, 3, "b", [1]), ("p", 1, 5, "a", [2]), ("p", 1, 5, "c", [3]), ("p", None, 1, "x", None), ("p", None, 1, "x", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, j int, n int, t string, v array<int>")
    got = sorted(map(str, unique(df, ["k", "j"], ["n"]).collect()))
    assert len(got) == 3 and any("t='c', v=[3]" in g for g in got)


SEGMENTS = [("s1", 22.5, 114.0, 22.5, 114.01, "A", "primary"), ("s2", 22.6, 114.0, 22.6, 114.01, "B", "trunk")]


@pytest.fixture
def world(spark):
    begun = datetime(2016, 8, 31)
    points = [("01", "a", i, begun, 22.5001 if i < 3 else 23.0, 114.001 * 1.0 + i / 1000, 10.0, 0.0) for i in range(4)] + [("01", "b", 10, begun, 22.6, 114.005, 10.0, 0.0)]
    return spark.createDataFrame(points, "day string, plate_number string, event_id long, datetime timestamp_ntz, latitude double, longitude double, speed double, heading double"), spark.createDataFrame(SEGMENTS, "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double, road_name string, road_type string")


def test_runs_are_resumed_and_commit_once(spark, tmp_path, world):
    points, segments = world
    tasks = spark.createDataFrame([("t1", "01/a", "distance_matching", '{"max_distance": 100.0}'), ("t2", "01/b", "greedy", None), ("t3", "09/none", "greedy", None), ("t1", "01/a", "distance_matching", '{"max_distance": 100.0}')], "task_id string, trajectory_id string, algorithm string, parameters string")
    runs = Runs(spark, f"{tmp_path}/r")
    runs.submit("x", tasks)
    runs.submit("y", tasks)
    state = lambda: {r.task_id: (r.status, r.matched_points_count, r.unmatched_points_count, r.error_message) for r in runs.status().collect()}
    assert state() == {t: ("queued", 0, 0, None) for t in ("t1", "t2", "t3")}

    class Died(BaseException):
        pass

    def dies(*_):
        raise Died

    with pytest.raises(Died):
        runs.run("r1", points, segments, {"greedy": dies})
    assert {s[0] for s in state().values()} == {"running"} and runs.matches().count() == 0

    def fails(*_):
        raise ValueError("bad\nroads")

    assert not runs.run("r2", points, segments, {"greedy": fails})
    assert state() == {t: ("failed", 0, 0, "ValueError: bad") for t in ("t1", "t2", "t3")}
    assert runs.run("r1", points, segments)  # the run that died goes on
    want = {"t1": ("completed", 3, 1, None), "t2": ("completed", 1, 0, None), "t3": ("failed", 0, 0, "the trajectory has no points")}
    assert state() == want
    assert not runs.run("r1", points, segments) and runs.run("r3", points, segments)
    assert state() == want and sorted((r.task_id, r.event_id, r.segment_id, r.road_name) for r in runs.matches().collect()) == [("t1", i, "s1", "A") for i in range(3)] + [("t2", 10, "s2", "B")]
    with_accuracy = {r.task_id: r.accuracy for r in runs.status().collect()}
    assert abs(with_accuracy["t2"] - 1) < 1e-9 and 0.8 < with_accuracy["t1"] < 1 and with_accuracy["t3"] is None
    late = spark.createDataFrame([("t4", "01/b", "no such way", None)], tasks.schema)
    runs.submit("z", late)
    assert not runs.run("r4", points, segments) and state()["t4"][0] == "failed" and "no algorithm" in state()["t4"][3]
