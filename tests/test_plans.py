"""Lists that grow with a table are shuffled: what Catalyst takes for a small table may be many times its file's size."""

import pytest

from trackmill import queries as own
from trackmill.operators import matching
from trackmill.plans.runs import TASKS, Runs


def nodes(plan) -> list:
    children = plan.children()
    return [plan, *[n for i in range(children.size()) for n in nodes(children.apply(i))]]


def broadcast_lists(df) -> list[str]:
    """Joins whose broadcast side has rows that a list was opened into, or that Python made."""
    found = []
    for join in nodes(df._jdf.queryExecution().sparkPlan()):
        if join.nodeName().startswith("Broadcast"):
            side = join.left() if "Left" in join.buildSide().toString() else join.right()
            found += [f"{join.nodeName()} of {n.nodeName()}" for n in nodes(side) if n.nodeName() in ("Generate", "MapInArrow")]
    return found


@pytest.mark.parametrize("name", ["connected_segments", "nearest_segment", "match_statistics", "match_tiers", "ensemble_vote", "sql_surface", "grid_candidates", "context_match", "greedy_match", "nearest_vertex_planar", "nearest_vertex", "hmm_match", "viterbi_match", "match_with_cleaning", "matched_trajectory_build"])
def test_no_list_is_broadcast(spark, small, name):
    assert broadcast_lists(own.queries()[name](spark, small)) == []


def test_no_list_is_broadcast_in_a_run(spark, small, tmp_path):
    tasks = spark.createDataFrame([("t", "01/B0001", "distance_matching", None)], TASKS)
    matches = Runs(spark, str(tmp_path))._matched(tasks, own.points(spark, small), own.segments(spark, small), {})
    assert broadcast_lists(matches) == []


@pytest.mark.parametrize("name", ["nearest_vertex", "context_match", "match_statistics", "ensemble_vote", "match_tiers", "sql_surface", "greedy_match", "match_with_cleaning", "matched_trajectory_build", "viterbi_match"])
def test_candidates_are_made_by_as_many_tasks_as_there_are_partitions(spark, small, name):
    """Adaptive execution would put points into few tasks, as it sees their bytes before candidates multiply them."""
    origins = [n.shuffleOrigin().toString() for n in nodes(own.queries()[name](spark, small)._jdf.queryExecution().sparkPlan()) if n.nodeName() == "Exchange"]
    assert "REPARTITION_BY_NUM" in origins


def test_votes_are_counted_by_as_many_tasks_as_there_are_partitions(spark):
    results = spark.range(1000).selectExpr("id AS event_id", "'s' AS segment_id", "0D AS matched_lat", "0D AS matched_lon", "0D AS distance", "1D AS confidence").repartition("event_id")
    assert matching.vote({"a": results, "b": results}).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["greedy_match", "viterbi_match"])
def test_vehicles_are_folded_by_as_many_tasks_as_there_are_partitions(spark, small, name):
    """Bytes do not tell how long a fold takes."""
    assert own.queries()[name](spark, small).rdd.getNumPartitions() == 4


def joins(df) -> int:
    return sum("Join" in n.nodeName() for n in nodes(df._jdf.queryExecution().sparkPlan()))


def test_rules_of_cleaning_need_no_join(spark, small):
    """Each join would match all points again, and hold them."""
    assert joins(own.queries()["match_with_cleaning"](spark, small)) == joins(own.queries()["context_match"](spark, small))


def broadcasts_of(df, table: str) -> list[str]:
    """Joins whose broadcast side reads the table."""
    sides = [j.left() if "Left" in j.buildSide().toString() else j.right() for j in nodes(df._jdf.queryExecution().sparkPlan()) if j.nodeName().startswith("Broadcast")]
    return [n.nodeName() for side in sides for n in nodes(side) if f"/{table}.parquet" in n.toString()]


@pytest.mark.parametrize("name", ["context_match", "match_with_cleaning", "matched_trajectory_build", "sql_surface"])
def test_points_are_not_broadcast(spark, small, name):
    assert broadcasts_of(own.queries()[name](spark, small), "events") == []


def test_a_join_with_a_matching_view_may_still_ask_for_a_broadcast(spark, small):
    own.queries()["sql_surface"](spark, small)
    df = spark.sql("SELECT /*+ BROADCAST(few) */ m.segment_id FROM match_distance_matching m JOIN (SELECT event_id FROM sql_points LIMIT 5) few ON few.event_id = m.event_id")
    assert broadcasts_of(df, "events") and df.count() <= 5
