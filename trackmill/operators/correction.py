"""Trajectory correction: speed, road-transition and geometric scores are weighed, low rows go.

Nothing is recursive, so the whole is window functions over one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geo
from . import filters
from . import sequence as seq

#: fixed values: names by which motorways are recognised
HIGHWAY = r"motorway|trunk|高速公路|高速|gao su|expressway"
#: fixed values: weights of the three scores and the score to exceed
WEIGHTS, THRESHOLD = (0.6, 0.2, 0.2), 0.6


def is_highway(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(HIGHWAY), F.lit(False))


def is_named(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "null")


def _pieces(v: Column, *bounds: tuple[float, Column]) -> Column:
    """The first expression whose bound v does not exceed; a bound of None is the rest."""
    out = None
    for most, value in bounds:
        if most is None:
            return out.otherwise(value)
        out = F.when(v <= most, value) if out is None else out.when(v <= most, value)
    return out


def speed_probability(v: Column, named: Column) -> Column:
    """Piecewise linear in km/h; roads with a name allow more."""
    zero = F.lit(0.0)
    city = _pieces(v, (60, 1 - v / 60 * 0.2), (80, 0.8 - (v - 60) / 20 * 0.6), (None, F.greatest(zero, 0.2 - (v - 80) / 80)))
    road = _pieces(v, (120, 1 - v / 120 * 0.3), (150, 0.7 - (v - 120) / 30 * 0.5), (None, F.greatest(zero, 0.2 - (v - 150) / 150)))
    return F.when(v < 0, zero).when(named, road).otherwise(city)


def reach(ms: Column, highway: Column) -> tuple[Column, Column]:
    """The reasonable and the possible distance for a time."""
    s = ms / 1000.0
    possible = F.when(highway, s * 41.7).otherwise(s * 22.2)
    likely = F.when(highway, F.greatest(F.lit(5000.0), F.least(s * 27.8 * 1.3, possible))).otherwise(F.greatest(F.lit(1500.0), F.least(s * 15.3 * 1.2, possible)))
    return likely, possible


def distance_score(d: Column, likely: Column, possible: Column) -> Column:
    """1 up to the reasonable distance, falling to the possible one, decaying beyond."""
    between = 1 - (d - likely) / F.when(possible == likely, 1.0).otherwise(possible - likely) * 0.4
    beyond = F.exp(-(d - possible) / possible) * 0.6 + 0.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(d <= likely, 1.0).when(d <= possible, between).otherwise(beyond)))


def heading_score(x: Column) -> Column:
    score = _pieces(x, (30, 1 - x / 30 * 0.1), (90, 0.9 - (x - 30) / 60 * 0.2), (150, 0.7 - (x - 90) / 60 * 0.1), (None, 0.6 - (x - 150) / 30 * 0.1))
    return F.when(x.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), score))


def scored(points: DataFrame, distance=geo.vincenty) -> DataFrame:
    """points with seq, steps, headings, p_speed, p_road, p_shape and score."""
    out = seq.numbered(seq.heading_deltas(seq.steps(points, distance)))
    first = F.col("seq") == 1
    stands = (F.col("speed") == 0) & seq.prev("speed").isNotNull() & seq.following("speed").isNotNull()
    p = F.when(first, 1.0).when(stands, 0.1).otherwise(speed_probability(F.col("step_kmh"), is_named(F.col("road_id"))))
    out = out.withColumn("p_speed", p).withColumn("_delta_before", seq.prev("heading_delta"))
    out = seq.confident_references(out, "p_speed", ["road_id", "latitude", "longitude", "heading_now"])

    def agrees(ref: str) -> Column:
        road = F.col(f"{ref}.road_id")
        return F.when(road.isNotNull() & (road != F.col("road_id")), 0.5).otherwise(1.0)

    # columns that later ones use several times are named, so that their expressions stand once
    here = ("latitude", "longitude")
    now, ref_head, next_head = F.col("heading_now"), F.col("prev_ref.heading_now"), F.col("next_ref.heading_now")
    likely, possible = reach(F.col("step_ms"), F.col("_highway"))
    out = out.withColumns({
        "_highway": is_highway(F.col("road_type")),
        "_gap": F.col("seq") - F.col("prev_ref.seq"),
        "_bend": F.when(F.col("seq") >= 3, F.abs(F.col("heading_delta") - F.col("_delta_before"))),
        "_came": F.when(ref_head.isNotNull(), now - geo.bearing("prev_ref.latitude", "prev_ref.longitude", *here)),
        "_goes": F.when(next_head.isNotNull(), now - geo.bearing(*here, "next_ref.latitude", "next_ref.longitude")),
        "_factor": F.when(F.col("road_id").isNull() | (F.col("road_id") == ""), 1.0).otherwise((agrees("prev_ref") + agrees("next_ref")) / 2),
    })
    out = out.withColumns({"_likely": likely, "_possible": possible, "_came": geo.fold(F.col("_came")), "_goes": geo.fold(F.col("_goes"))})
    out = out.withColumns({
        "_far": distance_score(F.col("step_m"), F.col("_likely"), F.col("_possible")),
        "_curve": F.when(F.col("_bend").isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.exp(-F.col("_bend") / 90))),
        "_back": F.when(F.col("_came").isNull(), 1.0).otherwise(heading_score(F.col("_came")) * F.when(F.col("_gap") <= 1, 1.0).otherwise(F.exp(-(F.col("_gap") - 1) / 3.0))),
        "_ahead": heading_score(F.col("_goes")),
        "_turn": heading_score(F.col("heading_delta")),
    })
    remote = F.when(F.col("next_ref").isNotNull(), (F.col("_back") + F.col("_ahead")) / 2).otherwise(F.col("_back"))
    shape = F.when(F.col("_gap") == 1, F.col("_turn") * 0.5 + F.col("_curve") * 0.5).otherwise(remote * 0.7 + F.col("_curve") * 0.3)
    out = out.withColumns({
        "p_road": F.when(first, 1.0).when(F.col("step_ms") > 0, F.least(F.lit(1.0), F.col("_far") * F.col("_factor"))).otherwise(F.col("_factor") * 0.5),
        "p_shape": F.when(first, 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), shape))),
    })
    score = F.nanvl(sum(F.col(c) * w for c, w in zip(("p_speed", "p_road", "p_shape"), WEIGHTS, strict=True)), F.lit(0.0))
    own = [c for c in out.columns if c.startswith("_")]
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop(*own)


def judged(points: DataFrame, distance=geo.vincenty) -> DataFrame:
    """What scored() gives, and good: over the threshold, or the only row of a sequence."""
    alone = (F.col("seq") == 1) & F.lead("seq").over(seq.over()).isNull()
    return scored(points, distance).withColumn("good", (F.col("score") > THRESHOLD) | alone)


def correct(points: DataFrame, distance=geo.vincenty, counters: Counters | None = None) -> DataFrame:
    """The rows that stay: those over the threshold (all, of a sequence of one), without exact repeats of the row before. Counters are told once the result has been written."""
    out = judged(points, distance)
    out = out if counters is None else counters.judged(out)
    out = seq.changed(out.where("good")).drop("good", "prev_ref", "next_ref")
    return out if counters is None else counters.saved(out)


class Counters:
    """How many rows a correction judged, removed and saved, counted in passing: the action that writes the result makes them known."""

    def __init__(self):
        self._judged, self._saved = Observation(), Observation()

    def judged(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._judged, F.count(F.lit(1)).alias("valid"), F.count_if(~F.col("good")).alias("anomalous"))

    def saved(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._saved, F.count(F.lit(1)).alias("saved_points"))

    @property
    def get(self) -> dict[str, int]:
        seen, saved = self._judged.get, self._saved.get["saved_points"]
        return {"valid": seen["valid"], "anomalous": seen["anomalous"], "duplicates": seen["valid"] - seen["anomalous"] - saved, "saved_points": saved}


def correct_stored(trajectories: DataFrame) -> DataFrame:
    """Correction of stored trajectories: KEYS and trajectory_points array<struct>. Points get their defaults, invalid ones go."""
    rows = filters.completed(trajectories.where(filters.has_points()).select(*seq.KEYS, F.inline("trajectory_points")), valid=True)
    return correct(rows.where(filters.valid_fix()).drop("seq"))


def summary(points: DataFrame, top_speed: float = 200.0) -> DataFrame:
    """Per sequence: point_count, total_distance and average, max and min of plausible speeds of all rows but the last."""
    out = points.withColumns({"_lat": seq.following("latitude"), "_lon": seq.following("longitude"), "_next": seq.following("event_id")})
    ok = F.when(F.col("_next").isNotNull() & (F.col("speed") >= 0) & (F.col("speed") <= top_speed), F.col("speed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.groupBy(*seq.KEYS).agg(
        F.count("*").alias("point_count"),
        zero(F.sum(geo.haversine("latitude", "longitude", "_lat", "_lon"))).alias("total_distance"),
        zero(F.avg(ok)).alias("average_speed"),
        zero(F.max(ok)).alias("max_speed"),
        zero(F.min(ok)).alias("min_speed"),
    )
