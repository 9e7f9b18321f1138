"""Map matching. Every algorithm is a function of points and segments; ALGORITHMS names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from . import filters, roads, routing
from . import sequence as seq

RESULT = "event_id long, segment_id string, matched_lat double, matched_lon double, distance double, confidence double"


def nearest(points: DataFrame, segments: DataFrame, *, max_distance: float = 1000.0, max_speed: float = 200.0) -> DataFrame:
    """The closest segment in reach of each point that is not too fast."""
    return roads.nearest_segment(points.where(filters.plausible_speed(max_speed)), segments, max_distance)


def _reachable(points: DataFrame, segments: DataFrame, max_distance: float, itself: bool) -> DataFrame:
    """One row per point, placed by vehicle: its order, speed and cand, the segments in reach with their projections and the segments connected with them. Points without one stay."""
    links = roads.connected(segments, itself=itself).groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("links"))
    ends = segments.select("segment_id", "start_lat", "start_lon", "end_lat", "end_lon").join(links, F.col("segment_id") == F.col("from_id"), "left").drop("from_id")
    bare = points.select(*seq.KEYS, "datetime", "event_id", "latitude", "longitude", "speed")
    met = roads.with_candidates(bare, ends, max_distance).withColumn("p", geo.closest("latitude", "longitude", "start_lat", "start_lon", "end_lat", "end_lon"))
    met = met.select(*seq.KEYS, "datetime", "event_id", "speed", "segment_id", "links", "p", geo.haversine("latitude", "longitude", "p.lat", "p.lon").alias("far"))
    hit = F.when(F.col("far") <= max_distance, F.struct("segment_id", F.col("far").alias("distance"), "p.lat", geo.wrapped(F.col("p.lon")).alias("lon"), F.coalesce("links", F.array().cast("array<string>")).alias("links")))
    return roads.dealt(met, *seq.KEYS).groupBy(*seq.KEYS, "datetime", "event_id", "speed").agg(F.array_sort(F.collect_list(hit)).alias("cand"))


class _Candidates:
    """The columns of _reachable() as numbers: segments are codes in the order of their ids, row i has places at[i] to at[i + 1]."""

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cand = table["cand"].combine_chunks()
        flat = cand.flatten()
        names = flat.field("segment_id").to_pylist()
        self.names = sorted(set(names))
        code = {x: i for i, x in enumerate(self.names)}
        self.at = np.r_[0, np.cumsum(pc.list_value_length(cand).to_numpy(zero_copy_only=False))].tolist()
        self.code = [code[x] for x in names]
        self.distance, self.lat, self.lon = (flat.field(c).to_pylist() for c in ("distance", "lat", "lon"))
        first = dict(zip(reversed(names), reversed(range(len(names))), strict=True))
        links = flat.field("links").take(pa.array(first.values(), pa.int64())).to_pylist()
        #: number of connected segments, and the codes of those that are candidates anywhere here
        self.degree = {code[x]: len(to) for x, to in zip(first, links, strict=True)}
        self.links = {code[x]: {code[y] for y in to if y in code} for x, to in zip(first, links, strict=True)}
        self.event = table["event_id"].to_pylist()
        self.speed = table["speed"].to_pylist()

    def rows(self, found: list[tuple[int, int, float]]):
        """Results of (row, place, confidence)."""
        import pyarrow as pa

        i, j, trust = zip(*found, strict=True) if found else ((), (), ())
        columns = [[self.event[x] for x in i], [self.names[self.code[x]] for x in j], *([c[x] for x in j] for c in (self.lat, self.lon, self.distance)), list(trust)]
        kinds = [pa.int64(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def greedy(points: DataFrame, segments: DataFrame, *, max_distance: float = 1000.0, max_speed: float = 200.0) -> DataFrame:
    """Per vehicle, the closest of the segments connected with the last match (itself included), or of all before there is one.

    A miss emits nothing and keeps the state. The first point of a vehicle always searches all. Ties, to a nanometre, go to the smaller id.
    """

    def fold(table, starts):
        c, out, new = _Candidates(table), [], set(starts.tolist())
        last = None
        for i in range(table.num_rows):
            if i in new:
                last = None
            if c.speed[i] is not None and c.speed[i] > max_speed:
                continue
            found = range(c.at[i], c.at[i + 1])
            if last is not None and c.degree[last]:
                found = [j for j in found if c.code[j] in c.links[last]]
            if found:
                j = min(found, key=lambda j: (round(c.distance[j], 9), c.code[j]))
                last = c.code[j]
                out.append((i, j, max(0.0, 1 - c.distance[j] / max_distance)))
        yield c.rows(out)

    return seq.by_vehicle(_reachable(points, segments, max_distance, True), fold, RESULT, placed=True)


def viterbi(points: DataFrame, segments: DataFrame, *, max_distance: float = 1000.0, max_speed: float = 200.0, threshold: float = 0.1) -> DataFrame:
    """Per vehicle, the likeliest path: Gaussian observation, uniform transition to connected segments, none to itself.

    Sums of logarithms instead of products; equally likely ones, to nine digits, go to the smaller id. Segments out of reach have
    no probability, so leaving them out is exact. A point that is too fast, or a break in the path, leaves the vehicle without result.
    """
    n_segments = segments.count()

    def path(c: _Candidates, a: int, b: int) -> list[tuple[int, int, float]]:
        import math

        seen, score, back = [], {}, []
        for i in range(a, b):
            fast = c.speed[i] is not None and c.speed[i] > max_speed
            own = {} if fast else {c.code[j]: j for j in range(c.at[i], c.at[i + 1])}
            weight = {k: math.exp(-0.5 * (c.distance[j] / (max_distance / 3)) ** 2) for k, j in own.items()}
            total = sum(weight.values())
            chance = {k: w / total for k, w in weight.items() if w > 0}
            seen.append((own, chance))
            if i == a:
                score = {k: math.log(p) for k, p in chance.items()}
                back.append({})
                continue
            best: dict[int, tuple[float, int, float]] = {}
            for k in sorted(score):
                n = c.degree[k]
                share = 1 / n if n else 1 / n_segments
                if share < threshold:
                    continue
                value = score[k] + math.log(share)
                for to in c.links[k] if n else chance:
                    if to in chance and (to not in best or round(value, 9) > best[to][0]):
                        best[to] = (round(value, 9), k, value)
            score = {to: value + math.log(chance[to]) for to, (_, _, value) in best.items()}
            back.append({to: k for to, (_, k, _) in best.items()})
        if not score:
            return []
        k, out = min(score, key=lambda x: (-round(score[x], 9), x)), []
        for t in range(b - a - 1, -1, -1):
            out.append((a + t, seen[t][0][k], seen[t][1][k]))
            k = back[t].get(k)
        return out[::-1]

    def fold(table, starts):
        c = _Candidates(table)
        ends = [*starts.tolist()[1:], table.num_rows]
        yield c.rows([x for a, b in zip(starts.tolist(), ends, strict=True) for x in path(c, a, b)])

    return seq.by_vehicle(_reachable(points, segments, max_distance, False), fold, RESULT, placed=True)


def vote(results: dict[str, DataFrame], method: str = "majority", weights: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Combines several algorithms' results per point; n_votes tells how many chose the winner.

    majority: most votes, if they are more than `threshold` of all, else by confidence; weighted: largest sum of the
    algorithms' weights; confidence: largest mean confidence, weighted. Ties go to the smaller segment_id.
    """
    weights = weights or {}
    tagged = None
    for name, df in results.items():
        one = df.withColumns({"w": F.lit(float(weights.get(name, 1.0)))})
        tagged = one if tagged is None else tagged.unionByName(one)
    # counts, sums and windows hold all rows of a task at once; placed by event_id itself, they would stay in the few tasks that adaptive execution made for the results
    by = roads.dealt(tagged.withColumn("_at", F.xxhash64("event_id")), "_at").groupBy("_at", "event_id", "segment_id").agg(
        F.count("*").alias("n_votes"), F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("confidence")) / F.sum("w")).alias("trust"),
        *[F.avg(c).alias(c) for c in ("matched_lat", "matched_lon", "distance", "confidence")],
    )
    whole = by.withColumn("_all", F.sum("n_votes").over(Window.partitionBy("_at", "event_id")))
    wins = whole.withColumn("_clear", F.max(F.col("n_votes") > threshold * F.col("_all")).over(Window.partitionBy("_at", "event_id")))
    key = {"majority": F.when(F.col("_clear"), F.col("n_votes").cast("double")).otherwise(F.col("trust")), "weighted": F.col("weight"), "confidence": F.col("trust")}[method]
    rank = F.row_number().over(Window.partitionBy("_at", "event_id").orderBy(F.desc(F.round(key, 9)), "segment_id"))
    return wins.withColumn("_r", rank).where("_r = 1").select("event_id", "segment_id", "matched_lat", "matched_lon", "distance", "confidence", "n_votes")


def ensemble(points: DataFrame, segments: DataFrame, *, algorithms: tuple[str, ...] = ("distance_matching", "greedy"), method: str = "majority", **options) -> DataFrame:
    """Each point is matched by itself, so algorithms that follow a vehicle start anew and reduce to the nearest segment."""
    alone = nearest(points, segments, **options)
    return vote({a: alone for a in algorithms}, method).drop("n_votes")


def statistics(results: DataFrame) -> DataFrame:
    """One row: counts, rate and distances; points without match are not in results, so the rate is 1 unless there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(
        F.count("*").alias("total_points"), F.count("segment_id").alias("matched_points"), zero(F.count("segment_id") / F.when(F.count("*") > 0, F.count("*"))).alias("match_rate"),
        zero(F.avg("distance")).alias("avg_distance"), zero(F.min("distance")).alias("min_distance"), zero(F.max("distance")).alias("max_distance"), zero(F.avg("confidence")).alias("avg_confidence"),
    )


def context_match(points: DataFrame, lines: DataFrame, *, bearing: str = "math", index: str = "vertex", size: float = 0.001) -> DataFrame:
    """points with road, place and distance of the candidate that scores best on context, direction and distance.

    points may have road_id, a first guess from which the context comes. Points without candidates keep their own place,
    on an unknown road. bearing="compass" compares like with like, where the default takes the road's angle from the east.
    """
    with_context = seq.road_context(points) if "road_id" in points.columns else points.withColumn("context_road", F.lit(None).cast("string"))
    found = roads.grid_candidates(points, lines, size, index=index)
    ends = lines.select("road_id", "road_name", "road_type", F.get("coords", F.lit(0)).alias("a"), F.element_at("coords", -1).alias("b"))
    angle = geo.road_direction(F.col("a"), F.col("b")) if bearing == "math" else geo.bearing("a.y", "a.x", "b.y", "b.x")
    met = found.join(ends.withColumn("angle", angle).select("road_id", "road_name", "road_type", "angle"), "road_id")
    mine = with_context.select("event_id", F.col("context_road").alias("ctx"), F.when(F.col("speed") == 0, -1.0).otherwise(F.coalesce("heading", F.lit(-1.0))).alias("head"))
    # a projection of points may look small enough to be broadcast, by the size of compressed files
    met = met.join(mine.hint("merge"), "event_id")
    near = 1 / (1 + F.sqrt("square") * 1000)
    same = F.when(F.col("ctx") == F.col("road_id"), 1.0).otherwise(0.0)
    turn = F.when(F.col("head") >= 0, 1 - geo.fold(F.col("head") - F.col("angle")) / 180).otherwise(0.0)
    score = F.when(F.col("head") < 0, same * 0.6 + near * 0.4).when(F.col("ctx").isNull(), turn * 0.4 + near * 0.6).otherwise(same * 0.5 + turn * 0.3 + near * 0.2)
    best = met.groupBy("event_id").agg(F.min(F.struct((-F.round(score, 9)).alias("s"), "road_id", "road_name", "road_type", "lat", "lon", "square")).alias("m"))
    kept = points.drop("road_id", "road_name", "road_type").withColumnsRenamed({"longitude": "orig_longitude", "latitude": "orig_latitude"})
    out = kept.join(best, "event_id", "left")
    return out.select(
        *kept.columns,
        F.coalesce("m.lon", "orig_longitude").alias("longitude"), F.coalesce("m.lat", "orig_latitude").alias("latitude"),
        F.coalesce("m.road_id", F.lit("unknown")).alias("road_id"), F.when(F.col("m").isNull(), "未知道路").otherwise(F.col("m.road_name")).alias("road_name"), F.when(F.col("m").isNull(), "unknown").otherwise(F.col("m.road_type")).alias("road_type"),
        F.coalesce(F.sqrt("m.square") * geo.DEGREE, F.lit(0.0)).alias("distance_to_road"), F.lit(True).alias("matched"),
    )


def cleaned(matched: DataFrame, metres: float = 100.0) -> DataFrame:
    """Matched points without those far from their road, in conflict with their neighbours' places, or alone on their road; all rules look at the whole list."""
    n = F.count("*").over(Window.partitionBy(*seq.KEYS))
    marked = seq.with_outvoted(matched.withColumn("_jumps", seq.jumps()), "_outvoted").withColumn("_n", n)
    return marked.where((F.col("_n") <= 2) | ((F.col("distance_to_road") <= metres) & ~F.col("_jumps") & ~F.col("_outvoted"))).drop("_n", "_jumps", "_outvoted")



def vertex_match(points: DataFrame, lines: DataFrame, planar: bool = False) -> DataFrame:
    """event_id with the closest vertex of any road, its road, and the distance."""
    corners = roads.vertices(lines).select(F.struct("road_id", "point_index").alias("vertex_id"), "lat", "lon")
    return roads.nearest_vertex(points, corners, planar=planar).select("event_id", F.col("vertex_id.road_id").alias("road_id"), F.col("vertex_id.point_index").alias("point_index"), F.col("lat").alias("matched_lat"), F.col("lon").alias("matched_lon"), "distance")


def as_trajectory(points: DataFrame, matches: DataFrame) -> DataFrame:
    """The points at their matched places; where they were stays in orig_ columns."""
    m = matches.select("event_id", F.col("matched_lat").alias("_lat"), F.col("matched_lon").alias("_lon"))
    out = points.withColumnsRenamed({"longitude": "orig_longitude", "latitude": "orig_latitude"}).join(m, "event_id", "left")
    return out.withColumns({"longitude": F.coalesce("_lon", "orig_longitude"), "latitude": F.coalesce("_lat", "orig_latitude"), "matched": F.col("_lat").isNotNull()}).drop("_lat", "_lon")


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {"distance_matching": nearest, "greedy": greedy, "gotrackit": viterbi, "hmm": routing.hmm, "ensemble": ensemble}
#: fixed values: what each algorithm takes unless told otherwise
DEFAULTS: dict[str, dict] = {name: {"max_distance": 1000.0, "max_speed": 200.0} for name in ALGORITHMS} | {"gotrackit": {"max_distance": 1000.0, "max_speed": 200.0, "threshold": 0.1}, "hmm": {"max_distance": 1000.0, "max_speed": 200.0, "sigma": 50.0, "beta": 200.0, "reach": 3000.0}}


def register(name: str, algorithm: Callable[..., DataFrame], **defaults) -> None:
    ALGORITHMS[name], DEFAULTS[name] = algorithm, defaults


def create(name: str, **options) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm {name}; there are {', '.join(sorted(ALGORITHMS))}")
    settings = DEFAULTS.get(name, {}) | options
    return lambda points, segments: ALGORITHMS[name](points, segments, **settings)


def available() -> list[str]:
    return sorted(ALGORITHMS)


def info(name: str) -> dict:
    return {"name": name, "description": (ALGORITHMS[name].__doc__ or "").strip().split("\n")[0], "defaults": dict(DEFAULTS.get(name, {}))}


def quality(results: DataFrame, matched: Column | None = None) -> DataFrame:
    """A tier for distance and one for confidence."""
    d, c = F.col("distance"), F.col("confidence")
    return results.withColumns({"distance_tier": F.when(d > 50, "poor").when(d > 20, "fair").otherwise("good"), "confidence_tier": F.when(c > 0.8, "high").when(c > 0.5, "medium").otherwise("low")})
