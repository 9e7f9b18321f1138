"""Read queries of the trajectory service. What is not found is an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import correction, filters, matching
from ..operators import sequence as seq


def plates(points: DataFrame, limit: int | None = 10_000) -> DataFrame:
    out = points.select("plate_number").distinct()
    return out.orderBy("plate_number").limit(limit) if limit else out


def plates_in_order(points: DataFrame, order: str = "event_id") -> DataFrame:
    """Every plate with its place, from 1, in the order in which they came in. Plates, unlike positions, are few; but one task numbers them."""
    first = points.groupBy("plate_number").agg(F.min(order).alias("first"))
    return first.select("plate_number", F.row_number().over(Window.orderBy("first", "plate_number")).alias("place"))


def by_plate(points: DataFrame, plate: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return points.where((F.col("plate_number") == plate) & filters.between_dates(start, end)).orderBy(*seq.ORDER)


def page(keys: DataFrame, number: int, size: int, *, clamp: bool = True) -> DataFrame:
    """One page of keys in ascending order; beyond the last it is the last, or nothing without clamp.

    Skipped rows are never collected: the page is a limited sort with an offset.
    """
    column = keys.columns[0]
    number = max(1, number)
    if clamp:
        number = min(number, max(1, -(-keys.count() // size)))
    return keys.orderBy(column).offset((number - 1) * size).limit(size)


def vehicle_page(points: DataFrame, number: int, size: int) -> DataFrame:
    """All rows of a page of vehicles."""
    return points.join(page(plates(points, None), number, size), "plate_number", "left_semi")


def summary(points: DataFrame) -> DataFrame:
    """Per vehicle: count, first and last time, extent."""
    return points.groupBy("plate_number").agg(
        F.count("*").alias("point_count"), F.min("datetime").alias("start_time"), F.max("datetime").alias("end_time"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
    )


def first_day(points: DataFrame, plate: str, kind: str | None = None) -> DataFrame:
    """The rows of the first day on which the vehicle is found; rows of the wanted type if that day has some, else of any."""
    mine = points.where(F.col("plate_number") == plate)
    mine = mine.withColumn("_d", F.min("day").over(Window.partitionBy("plate_number"))).where("day = _d").drop("_d")
    if kind is None:
        return mine
    wanted = F.max((F.col("type") == kind).cast("int")).over(Window.partitionBy("plate_number"))
    return mine.withColumn("_w", wanted).where((F.col("_w") == 0) | (F.col("type") == kind)).drop("_w")


def single_vehicle(points: DataFrame, plate: str, start: str, end: str, kind: str | None = None) -> DataFrame:
    return first_day(points, plate, kind).where(filters.between_times(start, end)).orderBy(*seq.ORDER)


def first_vehicle(points: DataFrame) -> DataFrame:
    """All rows of the first vehicle of the first day that has one."""
    first = points.select("day", "plate_number").orderBy("day", "plate_number").limit(1)
    return points.join(F.broadcast(first), ["day", "plate_number"], "left_semi")


def corrected_page(points: DataFrame, number: int, size: int) -> DataFrame:
    """Corrected trajectories of a page of vehicles, summed up, from the first day of each."""
    mine = points.join(page(plates(points, None), number, size, clamp=False), "plate_number", "left_semi")
    day = F.min("day").over(Window.partitionBy("plate_number"))
    return correction.summary(correction.correct(mine.withColumn("_d", day).where("day = _d").drop("_d")))


def task_points(tasks: DataFrame, trajectories: DataFrame, points: DataFrame) -> DataFrame:
    """task_id and the points of each task's trajectory, in long form. tasks: task_id, trajectory_id; trajectories: trajectory_id and KEYS."""
    return tasks.select("task_id", "trajectory_id").join(trajectories.select("trajectory_id", *seq.KEYS), "trajectory_id").drop("trajectory_id").join(points, list(seq.KEYS))


def bounds(points: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Per sequence: its box, widened by so many degrees, and the middle of that."""
    lo, hi = (lambda c: F.min(c) - buffer), (lambda c: F.max(c) + buffer)
    out = points.groupBy(*seq.KEYS).agg(lo("latitude").alias("min_lat"), hi("latitude").alias("max_lat"), lo("longitude").alias("min_lng"), hi("longitude").alias("max_lng"))
    return out.withColumns({"center_lat": (F.col("min_lat") + F.col("max_lat")) / 2, "center_lng": (F.col("min_lng") + F.col("max_lng")) / 2})


def statistics(points: DataFrame) -> DataFrame:
    """Per sequence: total_points, total_distance, duration (whole seconds from the first to the last row) and average and greatest speed of all rows but the last; zeros for a single row.

    average_kmh is the distance by the duration."""
    w = seq.over()
    out = points.withColumns({"_lat": seq.following("latitude", w=w), "_lon": seq.following("longitude", w=w), "_i": F.row_number().over(w), "_next": seq.following("event_id", w=w)})
    speed = F.when(F.col("_next").isNotNull(), F.col("speed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.groupBy(*seq.KEYS).agg(
        F.count("*").alias("total_points"), zero(F.sum(geo.haversine("latitude", "longitude", "_lat", "_lon"))).alias("total_distance"),
        F.coalesce(seq.seconds(F.min_by("datetime", "_i"), F.max_by("datetime", "_i")).cast("long"), F.lit(0)).alias("duration"), zero(F.avg(speed)).alias("avg_speed"), zero(F.max(speed)).alias("max_speed"),
    )
    return out.withColumn("average_kmh", F.when(F.col("duration") > 0, F.col("total_distance") / F.col("duration") * 3.6).otherwise(0.0))


def correction_counters(points: DataFrame) -> DataFrame:
    """One row: how many rows and vehicles' days were looked at, skipped as invalid, removed as anomalous or as repeats, and saved.

    The chain runs once; what it removes is marked rather than filtered. Beside a correction that is written,
    correction.Counters counts without a query of its own.
    """
    valid = F.coalesce(filters.valid_fix() & F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), F.lit(False))
    marked = correction.judged(points.where(valid))
    before = F.last(F.when(F.col("good"), F.struct("longitude", "latitude")), ignorenulls=True).over(seq.over().rowsBetween(Window.unboundedPreceding, -1))
    same = (F.col("longitude") == F.col("_b.longitude")) & (F.col("latitude") == F.col("_b.latitude"))
    each = marked.withColumn("_b", before).withColumn("_saved", F.col("good") & ~F.coalesce(same, F.lit(False)))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    of_valid = each.groupBy(*seq.KEYS).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("skipped"), count(~F.col("good")).alias("anomalous"), count(F.col("good") & ~F.col("_saved")).alias("duplicates"), count(F.col("_saved")).alias("saved_points"))
    zero = F.lit(0).cast("long")
    rest = points.where(~valid).groupBy(*seq.KEYS).agg(F.count("*").alias("n")).select(*seq.KEYS, "n", F.col("n").alias("skipped"), *[zero.alias(c) for c in ("anomalous", "duplicates", "saved_points")])
    by = of_valid.unionByName(rest).groupBy(*seq.KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "skipped", "anomalous", "duplicates", "saved_points")])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(total("n").alias("points"), F.count("*").alias("processed"), total("skipped").alias("skipped"), total("anomalous").alias("anomalous"), total("saved_points").alias("saved_points"), count(F.col("saved_points") > 0).alias("saved"), total("duplicates").alias("duplicates"))


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n rows of each vehicle's day."""
    return points.withColumn("_r", F.row_number().over(seq.over())).where(F.col("_r") <= n).drop("_r")


def match_on_read(points: DataFrame, lines: DataFrame, vehicles: int, n: int) -> DataFrame:
    """The first vehicles' first valid points at their closest road vertices."""
    mine = points.join(plates(points, vehicles), "plate_number", "left_semi").where(filters.valid_fix())
    some = first_points(mine, n)
    return matching.as_trajectory(some, matching.vertex_match(some, lines))


def completion(tasks: DataFrame) -> DataFrame:
    """Tasks by status and the share, in percent, of those that ended well."""
    done = lambda s: F.count_if(F.col("status") == s)
    return tasks.agg(F.count("*").alias("total"), *[done(s).alias(s) for s in ("pending", "processing", "completed", "failed")], F.coalesce(F.round(done("completed") * 100.0 / F.when(F.count("*") > 0, F.count("*"))), F.lit(0.0)).alias("completion_percent"))


def build(points: DataFrame, lines: DataFrame | None = None, **options) -> DataFrame:
    """One row per vehicle's day: positions without standstill, matched to roads if there are some (with options), with extent and ends."""
    kept = seq.moved(points.where(filters.valid_point()))
    kept = matching.context_match(kept, lines, **options) if lines is not None else kept
    numbered = seq.numbered(kept)
    point = F.struct("seq", "event_id", "datetime", "longitude", "latitude", "speed", "heading", *(("road_id", "road_name", "road_type", "distance_to_road") if lines is not None else ()))
    return numbered.groupBy(*seq.KEYS).agg(
        F.array_sort(F.collect_list(point)).alias("trajectory_points"), F.count("*").alias("point_count"),
        F.min_by("event_id", "seq").alias("first_event"), F.max_by("event_id", "seq").alias("last_event"),
        F.struct(F.min("datetime").alias("start"), F.max("datetime").alias("end")).alias("time_range"),
        F.struct(F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat")).alias("bbox"),
        F.lit("matched_trajectory" if lines is not None else "original_trajectory").alias("type"),
    )


def flat(trajectories: DataFrame) -> DataFrame:
    """Long form again."""
    return trajectories.select(*seq.KEYS, F.inline("trajectory_points"))


def new_plates(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of vehicles' days that the store does not have."""
    return points.join(stored.select(*seq.KEYS).distinct(), list(seq.KEYS), "left_anti")


def correction_rate(points: DataFrame, corrected: DataFrame) -> DataFrame:
    """Per day with any vehicle: how many have a corrected trajectory."""
    count = lambda df, name: df.groupBy("day").agg(F.countDistinct("plate_number").alias(name))
    both = count(points, "source_count").join(count(corrected, "target_count"), "day", "left").withColumn("target_count", F.coalesce("target_count", F.lit(0)))
    return both.where("source_count > 0").withColumn("rate", F.format_string("%.2f%%", F.col("target_count") * 100.0 / F.col("source_count")))
