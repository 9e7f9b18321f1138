"""Matching tasks: a log of what was asked for and how it ended, with the matches.

Tasks are queued in batches. A run takes those that have not ended well, marks them as running, matches the points of their trajectories, and commits
the matches together with each task's end. So a task's matches are there once, and only with its status `completed`; a
run that died leaves its tasks `running` and without matches, and the next run takes them again. A run whose matching fails ends its
tasks as `failed` with the message; these are taken again as well. Running an id again changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..operators import sequence as seq
from ..sources.store import Store, unique

TASKS = "task_id string, trajectory_id string, algorithm string, parameters string"
LOG = "task_id string, run long, phase int, status string, progress double, matched_points_count long, unmatched_points_count long, accuracy double, error_message string"
MATCHES = "task_id string, event_id long, segment_id string, original_latitude double, original_longitude double, matched_latitude double, matched_longitude double, distance double, confidence double, road_name string, road_type string"
#: fixed values: the states of a task, in the order of its life
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"


class Runs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def submit(self, batch: str, tasks: DataFrame) -> bool:
        """Queues tasks (task_id, trajectory_id, algorithm, parameters as JSON or null); an id that is known or repeated counts once."""
        fresh = unique(tasks.select(*[F.col(c).cast("string").alias(c) for c in ("task_id", "trajectory_id", "algorithm", "parameters")]), ["task_id"], ["trajectory_id"])
        fresh = fresh.join(self.tasks().select("task_id"), "task_id", "left_anti")
        return self.store.append(f"tasks-{batch}", {"tasks": fresh})

    def tasks(self) -> DataFrame:
        return self.store.read("tasks", TASKS)

    def matches(self) -> DataFrame:
        return self.store.read("matches", MATCHES)

    def status(self) -> DataFrame:
        """One row a task: its last status and what it ended with."""
        last = self.store.read("log", LOG).groupBy("task_id").agg(F.max(F.struct("run", "phase", "status", "progress", "matched_points_count", "unmatched_points_count", "accuracy", "error_message")).alias("l"))
        out = self.tasks().join(last, "task_id", "left")
        zero = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(0))
        return out.select("task_id", "trajectory_id", "algorithm", F.coalesce("l.status", F.lit(QUEUED)).alias("status"), *[zero(c).alias(c) for c in ("progress", "matched_points_count", "unmatched_points_count")], "l.accuracy", "l.error_message")

    def run(self, run_id: str, points: DataFrame, segments: DataFrame, algorithms: dict | None = None) -> bool:
        """Works on all tasks that have not been completed; whether the run was new and went through.

        points: KEYS and event_id among others; a trajectory's id is its KEYS, joined by a slash. algorithms: functions of points and
        segments by name, beside those of the registry. A task whose trajectory has no points fails by itself.
        """
        end, failed = f"{run_id}-end", f"{run_id}-failed"
        done = self.store.batches()
        if end in done or failed in done:
            return False
        number = 1 + sum("-begin-" in b for b in done)  # of attempts, this one included
        self.store.append(f"{run_id}-begin-{number}", {"log": self._log(self.status().where(F.col("status") != COMPLETED), number, RUNNING)})
        open_ = self.tasks().join(self.status().where(F.col("status") == RUNNING).select("task_id"), "task_id")
        try:
            folder = self.store.stage("matches", self._matched(open_, points, segments, algorithms or {}))
            stored = self.store.staged("matches", folder, MATCHES)
            sizes = _by_trajectory(points).join(open_.select("task_id", "trajectory_id"), "trajectory_id").groupBy("task_id").agg(F.count("*").alias("n"))
            found = stored.groupBy("task_id").agg(F.count("segment_id").alias("matched"), F.avg("confidence").alias("accuracy"))
            ended = open_.select("task_id").join(sizes, "task_id", "left").join(found, "task_id", "left")
            matched, empty = F.coalesce("matched", F.lit(0)), F.col("n").isNull()
            log = self._log(
                ended, number, F.when(empty, FAILED).otherwise(COMPLETED), progress=F.when(empty, 0.0).otherwise(100.0), matched_points_count=matched,
                unmatched_points_count=F.coalesce(F.col("n") - matched, F.lit(0)), accuracy=F.when(~empty, F.coalesce("accuracy", F.lit(0.0))), error_message=F.when(empty, "the trajectory has no points"),
            )
            return self.store.commit(end, {"matches": folder, "log": self.store.stage("log", log)})
        except Exception as e:  # whatever went wrong is for the log
            message = f"{type(e).__name__}: {e}".splitlines()[0][:500]
            self.store.append(failed, {"log": self._log(open_, number, FAILED, error_message=F.lit(message))})
            return False

    @staticmethod
    def _log(tasks: DataFrame, number: int, status, **told) -> DataFrame:
        status = F.lit(status) if isinstance(status, str) else status
        own = {"task_id": F.col("task_id"), "run": F.lit(number), "phase": F.when(status == RUNNING, 1).otherwise(2), "status": status, "progress": F.lit(0.0), "matched_points_count": F.lit(0), "unmatched_points_count": F.lit(0), "accuracy": F.lit(None), "error_message": F.lit(None)} | told
        return tasks.select(*[own[name].cast(kind).alias(name) for name, kind in (c.split() for c in LOG.split(", "))])

    def _matched(self, open_: DataFrame, points: DataFrame, segments: DataFrame, algorithms: dict) -> DataFrame:
        """The matches of all these tasks."""
        mine, matches = _by_trajectory(points), self.spark.createDataFrame([], MATCHES)
        # one plan for each algorithm and its settings, of which there are few
        for way in open_.select("algorithm", "parameters").distinct().toLocalIterator():
            tasks = open_.where(F.col("algorithm").eqNullSafe(way.algorithm) & F.col("parameters").eqNullSafe(way.parameters)).select("task_id", "trajectory_id")
            some = mine.join(tasks.select("trajectory_id").distinct(), "trajectory_id", "left_semi")
            run = algorithms.get(way.algorithm) or matching.create(way.algorithm, **json.loads(way.parameters or "{}"))
            place = some.select("trajectory_id", "event_id", F.col("latitude").alias("original_latitude"), F.col("longitude").alias("original_longitude"))
            own = run(some.drop("trajectory_id"), segments).join(place, "event_id").join(tasks, "trajectory_id").join(segments.select("segment_id", "road_name", "road_type").hint("merge"), "segment_id", "left")
            own = own.withColumnsRenamed({"matched_lat": "matched_latitude", "matched_lon": "matched_longitude"})
            matches = matches.unionAll(own.select(*[c.split()[0] for c in MATCHES.split(", ")]))
        return matches


def _by_trajectory(points: DataFrame) -> DataFrame:
    return points.withColumn("trajectory_id", F.concat_ws("/", *seq.KEYS))
