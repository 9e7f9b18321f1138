"""Operators over each vehicle's time-ordered positions.

All share one window specification, so a chain of them needs one exchange. KEYS bound a window's rows
to a vehicle's day; event_id breaks ties of time, and rows without time come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import geo

KEYS = ("day", "plate_number")
ORDER = ("datetime", "event_id")


def over(keys=KEYS, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])


def prev(c, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(c, n).over(w or over())


def following(c, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(c, n).over(w or over())


def seconds(a: Column, b: Column) -> Column:
    """From a to b; wall-clock times are read as UTC."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(1e6)


def numbered(points: DataFrame) -> DataFrame:
    """seq, from 1."""
    return points.withColumn("seq", F.row_number().over(over()))


def steps(points: DataFrame, distance=geo.vincenty) -> DataFrame:
    """step_m (on the ellipsoid), step_ms and step_kmh from the row before; the first row has zeros, so has the speed of a step without time."""
    gap = F.abs(seconds(prev("datetime"), F.col("datetime")) * 1000)
    out = points.withColumns({"_lat": prev("latitude"), "_lon": prev("longitude"), "step_ms": F.coalesce(gap, F.lit(0.0)).cast("long")})
    if distance is geo.vincenty:
        out = geo.with_ellipsoid(out, "step_m", "_lat", "_lon", "latitude", "longitude")
    else:
        out = out.withColumn("step_m", distance("_lat", "_lon", "latitude", "longitude"))
    out = out.withColumn("step_m", F.coalesce("step_m", F.lit(0.0)))
    speed = F.when(F.col("step_ms") > 0, (F.col("step_m") / 1000) / (F.col("step_ms") / F.lit(3600000.0))).otherwise(0.0)
    return out.withColumn("step_kmh", speed).drop("_lat", "_lon")


def heading_deltas(points: DataFrame) -> DataFrame:
    """heading_now (null where the vehicle stands, but for the first row) and heading_delta; the previous heading counts even if it stood."""
    now = F.when((F.col("speed") == 0) & prev("event_id").isNotNull(), None).otherwise(F.col("heading"))
    out = points.withColumns({"heading_now": now, "_before": prev("heading"), "_first": prev("event_id").isNull()})
    delta = F.when(F.col("_first"), 0.0).otherwise(geo.fold(F.col("heading_now") - F.col("_before")))
    return out.withColumn("heading_delta", delta).drop("_before", "_first")


def moved(points: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows further than the tolerance, in either axis, from the row before them (kept or not); the first stays."""
    far = lambda c: F.abs(F.col(c) - prev(c)) > tolerance
    return points.withColumn("_far", F.coalesce(far("longitude") | far("latitude"), F.lit(True))).where("_far").drop("_far")


def moved_strict(points: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """As moved(), but a difference of exactly the tolerance counts as movement."""
    near = lambda c: F.abs(F.col(c) - prev(c)) < tolerance
    return points.withColumn("_near", F.coalesce(near("longitude") & near("latitude"), F.lit(False))).where(~F.col("_near")).drop("_near")


def changed(points: DataFrame) -> DataFrame:
    """Rows whose coordinates differ at all from the row before."""
    same = lambda c: F.col(c) == prev(c)
    return points.withColumn("_same", F.coalesce(same("longitude") & same("latitude"), F.lit(False))).where(~F.col("_same")).drop("_same")


def without_jumps(points: DataFrame, metres: float) -> DataFrame:
    """Rows whose step from the row before is at most so long."""
    return steps(points, geo.haversine).where(F.col("step_m") <= metres).drop("step_m", "step_ms", "step_kmh")


def smoothed(points: DataFrame, k: int) -> DataFrame:
    """Centred moving average over 2 * (k // 2) + 1 rows; rows near an end, and short sequences, stay."""
    h = k // 2
    near = over().rowsBetween(-h, h)
    full = (F.count("*").over(near) == 2 * h + 1) & (F.count("*").over(Window.partitionBy(*KEYS)) >= k)
    return points.withColumns({f"smooth_{c}": F.when(full, F.avg(c).over(near)).otherwise(F.col(c)) for c in ("latitude", "longitude")})


def derived_speed(points: DataFrame) -> DataFrame:
    """speed from the step where time passed, else the recorded one."""
    return steps(points, geo.haversine).withColumn("speed", F.when(F.col("step_ms") > 0, F.col("step_kmh")).otherwise(F.col("speed"))).drop("step_m", "step_ms", "step_kmh")


#: fixed values: the most points shown up to each zoom level
ZOOM = {8: 5, 10: 8, 12: 15, 14: 30, 16: 60}


def level_of_detail(points: DataFrame, zoom: int) -> DataFrame:
    """First, last and every step-th row, so that about as many remain as the zoom level shows."""
    most = next((m for z, m in ZOOM.items() if zoom <= z), None)
    if most is None:
        return points
    out = points.withColumns({"_i": F.row_number().over(over()) - 1, "_n": F.count("*").over(Window.partitionBy(*KEYS))})
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    keep = (F.col("_n") <= most) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | ((F.col("_i") % step == 0) & (F.col("_i") < F.col("_n") - step))
    return out.where(keep).drop("_i", "_n")


def waypoints(points: DataFrame, parts: int = 100) -> DataFrame:
    """Every interval-th row but the last, at most about so many."""
    out = points.withColumns({"_i": F.row_number().over(over()) - 1, "_n": F.count("*").over(Window.partitionBy(*KEYS))})
    step = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    return out.where((F.col("_i") % step == 0) & (F.col("_i") < F.col("_n") - 1)).drop("_i", "_n")


def chunks(points: DataFrame, size: int = 100, overlap: int = 2) -> DataFrame:
    """chunk and place of each row, from 0; rows of an overlap come once for each chunk."""
    stride = size - overlap
    out = points.withColumn("_i", F.row_number().over(over()) - 1)
    last = F.floor(F.col("_i") / stride)
    first = F.greatest(F.ceil((F.col("_i") - (size - 1)) / F.lit(float(stride))), F.lit(0))
    return out.withColumn("chunk", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("place", F.col("_i") - F.col("chunk") * stride).drop("_i")


def stitched(chunked: DataFrame, overlap: int = 2) -> DataFrame:
    """Chunks as one sequence again: later ones lose what they share with the one before."""
    return chunked.where((F.col("chunk") == 0) | (F.col("place") >= overlap))


def road_context(points: DataFrame) -> DataFrame:
    """context_road: the nearest known road of the neighbours before, after, two before, three before, two and three after."""
    known = F.when(F.col("road_id") != "unknown", F.col("road_id"))
    return points.withColumn("context_road", F.coalesce(*[F.lag(known, n).over(over()) for n in (1, -1, 2, 3, -2, -3)]))


def jumps(seconds_: int = 300, metres: float = 500.0) -> Column:
    """Whether an inner row has, among three neighbours on either side, one close in time but far in place."""
    far = F.lit(False)
    for n in (1, 2, 3, -1, -2, -3):
        lat, lon, t = (F.lag(c, n).over(over()) for c in ("latitude", "longitude", "datetime"))
        far = far | F.coalesce((F.abs(seconds(t, F.col("datetime"))) <= seconds_) & (geo.haversine(lat, lon, "latitude", "longitude") > metres), F.lit(False))
    n = F.count("*").over(Window.partitionBy(*KEYS))
    return prev("event_id").isNotNull() & following("event_id").isNotNull() & (n > 2) & far


def near_in_time(points: DataFrame, seconds_: int = 300, metres: float = 500.0) -> DataFrame:
    """Drops rows that jump."""
    return points.withColumn("_drop", jumps(seconds_, metres)).where(~F.col("_drop")).drop("_drop")


def with_outvoted(points: DataFrame, name: str) -> DataFrame:
    """name: whether three of the four neighbours of a row, two away from either end, agree on another road."""
    around = [F.lag("road_id", n).over(over()) for n in (2, 1, -1, -2)]
    n, i = F.count("*").over(Window.partitionBy(*KEYS)), F.row_number().over(over()) - 1
    out = points.withColumns({"_around": F.array(*around), "_n": n, "_i": i})
    agree = F.exists("_around", lambda r: (r != F.col("road_id")) & (F.size(F.filter("_around", lambda x: x == r)) >= 3))
    inner = (F.col("_n") >= 5) & (F.col("_i") >= 2) & (F.col("_i") <= F.col("_n") - 3)
    return out.withColumn(name, inner & F.coalesce(agree, F.lit(False))).drop("_around", "_n", "_i")


def consistent_roads(points: DataFrame) -> DataFrame:
    """Drops rows whose neighbours agree on another road."""
    return with_outvoted(points, "_drop").where(~F.col("_drop")).drop("_drop")


def confident_references(points: DataFrame, confidence: str, columns: list[str], least: float = 0.6) -> DataFrame:
    """prev_ref and next_ref: structs of seq and columns of the nearest confident row on either side.

    The later one is looked for in descending order: a frame that ends unbounded would be quadratic.
    """
    seen = F.when(F.col(confidence) >= least, F.struct("seq", *columns))
    back = over().rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*KEYS).orderBy(*[F.desc_nulls_first(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_seen", seen).withColumn("prev_ref", F.last("_seen", ignorenulls=True).over(back)).withColumn("next_ref", F.last("_seen", ignorenulls=True).over(ahead)).drop("_seen")


def by_vehicle(rows: DataFrame, fold, schema: str, *, placed: bool = False) -> DataFrame:
    """fold(table, starts) over whole sequences in order, many at a time; table's columns are rows' own, starts where its sequences begin.

    One exchange (none for rows that are placed by KEYS already), and no call per vehicle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            starts = _starts(held, np)
            if len(starts) > 1:  # the last sequence may go on
                yield from fold(held.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield from fold(held.combine_chunks(), _starts(held, np))

    def _starts(table: pa.Table, np):
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in KEYS:
            code = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    return (rows if placed else rows.repartition(*KEYS)).sortWithinPartitions(*KEYS, *[F.asc_nulls_last(c) for c in ORDER]).mapInArrow(run, schema)
