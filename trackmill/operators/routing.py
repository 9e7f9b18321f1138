"""Distances along roads, up to a bound, and the matching that weighs them against the way that a vehicle went.

Ends of segments that are equal to a millionth of a degree are one junction; roads go both ways. Searches are
made by tile: a path of at most `reach` metres stays within that distance of where it begins, so a tile with all segments
within reach of it holds every path from its own junctions whole. The network is shuffled once, and a tile's
share of it does not grow with the traffic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import filters, roads
from . import sequence as seq

#: places are told apart to this part of a degree
UNIT = 1_000_000
ROUTE = "origin long, target long, metres double"


def junction(lat: str, lon: str) -> Column:
    """A place's number: equal for ends that meet."""
    part = lambda c, by: F.floor((F.col(c) + by) * UNIT + 0.5)
    return (part(lat, 90) * (360 * UNIT) + F.pmod(part(lon, 180), F.lit(360 * UNIT))).cast("long")


def _edges(segments: DataFrame) -> DataFrame:
    length = geo.haversine("start_lat", "start_lon", "end_lat", "end_lon")
    return segments.select("start_lat", "start_lon", "end_lat", "end_lon", junction("start_lat", "start_lon").alias("a"), junction("end_lat", "end_lon").alias("b"), length.alias("metres"))


def _search(reach: float):
    """Of (tile, a, b, metres, whether a and b are the tile's own) rows, tile after tile: all that a junction of the tile reaches."""

    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        import heapq

        near: dict[int, dict[int, float]] = {}
        own = set()
        for a, b, w, a_own, b_own in zip(*(table[c].to_pylist() for c in ("a", "b", "metres", "a_own", "b_own")), strict=True):
            for u, v in ((a, b), (b, a)):
                to = near.setdefault(u, {})
                to[v] = min(w, to.get(v, w))
            own |= ({a} if a_own else set()) | ({b} if b_own else set())
        out: list[tuple[int, int, float]] = []
        for u in sorted(own):
            done: dict[int, float] = {}
            open_ = [(0.0, u)]
            while open_:
                d, v = heapq.heappop(open_)
                if v not in done:
                    done[v] = d
                    for to, w in near[v].items():
                        if to not in done and d + w <= reach:
                            heapq.heappush(open_, (d + w, to))
            out += [(u, v, d) for v, d in done.items()]
            if len(out) > 100_000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["origin", "target", "metres"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            x, y = (held[c].to_numpy() for c in ("_gx", "_gy"))
            ends = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=False):
                yield from tile(held.slice(a, b - a))
            held = held.slice(int(ends[-1])) if len(ends) else held
        if held is not None and held.num_rows:
            yield from tile(held)

    return run


def routes(segments: DataFrame, reach: float, near: DataFrame | None = None) -> DataFrame:
    """origin, target and metres of all pairs of junctions with a way of at most `reach` metres between them, the shortest of which counts; a junction reaches itself.

    With near (origin), junctions whose tile holds none of these are left out as origins.
    """
    size = max(roads.CELL, reach / 110_000.0)

    def tile(c: str) -> tuple[Column, Column]:
        lat, lon = F.floor(F.col(c) / (360 * UNIT)) / UNIT - 90, F.pmod(F.col(c), F.lit(360 * UNIT)) / UNIT - 180
        return geo.cell(lon, size), geo.cell(lat, size)

    def own(c: str) -> Column:
        x, y = tile(c)
        return (x == F.col("_gx")) & (y == F.col("_gy"))

    listed = roads._listed(_edges(segments), reach, size).select("_gx", "_gy", "a", "b", "metres", own("a").alias("a_own"), own("b").alias("b_own"))
    if near is not None:
        x, y = tile("origin")
        listed = listed.join(near.select(x.alias("_gx"), y.alias("_gy")).distinct().hint("merge"), ["_gx", "_gy"], "left_semi")
    # a tile's rows are few bytes and much work: with a number, adaptive execution does not merge them into few tasks (in the join's order of columns this exchange would go)
    return roads.dealt(listed, "_gy", "_gx").sortWithinPartitions("_gx", "_gy").mapInArrow(_search(reach), ROUTE)


#: pairs of candidates, of one point and the next, that are weighed together
PAIRS = 1 << 18


class _Rows:
    """Columns of candidates and ways as numbers. A row without a segment is the ways from a junction; segments are codes in the order of their ids."""

    def __init__(self, table: pa.Table):
        import numpy as np
        import pyarrow.compute as pc

        self.of = {c: table[c].fill_null(0).to_numpy() for c in ("event_id", "a", "b")} | {c: table[c].to_numpy() for c in ("latitude", "longitude", "lat", "lon", "distance", "from_a", "from_b")}
        names = table["segment_id"].combine_chunks().dictionary_encode()
        rank = np.zeros(max(1, len(names.dictionary)), np.int64)
        rank[sorted(range(len(names.dictionary)), key=names.dictionary.to_pylist().__getitem__)] = np.arange(len(names.dictionary))
        self.is_route = names.indices.is_null().to_numpy(zero_copy_only=False)
        self.of["segment"] = rank[names.indices.fill_null(0).to_numpy()]
        self.n_ways = pc.list_value_length(table["targets"]).fill_null(0).to_numpy()
        self.way = np.r_[0, np.cumsum(self.n_ways)]
        self.target, self.metres = (table[c].combine_chunks().flatten().to_numpy() for c in ("targets", "ways"))


def _likeliest(rows: _Rows, a: int, b: int, max_distance: float, sigma: float, beta: float) -> list[tuple[int, float]]:
    """Rows (candidates) of the likeliest path of one vehicle's day, rows a to b, with the share of each among its point's candidates by distance."""
    import numpy as np

    at = a + np.flatnonzero(~rows.is_route[a:b] & (rows.of["distance"][a:b] <= max_distance))
    if not len(at):
        return []
    columns = {c: v[at] for c, v in rows.of.items()}
    segment = columns["segment"]
    node, number = np.unique(np.r_[columns["a"], columns["b"]], return_inverse=True)
    ends = np.stack([number[: len(at)], number[len(at) :]])
    rest = np.stack([columns["from_a"], columns["from_b"]])
    far = np.full((len(node), len(node)), np.inf)  # of the junctions near one vehicle's day
    u, v = np.repeat(rows.of["a"][a:b], rows.n_ways[a:b]), rows.target[rows.way[a] : rows.way[b]]
    i, j = (np.minimum(np.searchsorted(node, x), len(node) - 1) for x in (u, v))
    known = (node[i] == u) & (node[j] == v)
    far[i[known], j[known]] = rows.metres[rows.way[a] : rows.way[b]][known]

    def metres(y1, x1, y2, x2):
        h = np.sin(np.radians(y2 - y1) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(np.radians(x2 - x1) / 2) ** 2
        return 2 * geo.RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))

    weight = -0.5 * (np.round(columns["distance"], 3) / sigma) ** 2
    first = np.r_[0, np.flatnonzero(np.diff(columns["event_id"])) + 1, len(at)]
    # candidates of a point in the order of their ids
    order = np.lexsort((segment, np.repeat(np.arange(len(first) - 1), np.diff(first))))
    spans = [order[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def steps() -> Iterator[np.ndarray]:
        """What each step costs, from each candidate of a point to each of the next: many steps at once."""
        size = np.diff(first)
        pairs = np.r_[0, np.cumsum(size[:-1] * size[1:])]
        t = 0
        while t < len(pairs) - 1:
            e = max(t + 1, int(np.searchsorted(pairs, pairs[t] + PAIRS, "right")) - 1)
            n = size[t:e] * size[t + 1 : e + 1]
            step = np.repeat(np.arange(t, e), n)
            k = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
            p, q = order[first[step] + k // size[step + 1]], order[first[step + 1] + k % size[step + 1]]
            way = np.min([rest[e_, p] + far[ends[e_, p], ends[f, q]] + rest[f, q] for e_ in (0, 1) for f in (0, 1)], axis=0)
            same = np.flatnonzero(segment[p] == segment[q])
            way[same] = metres(*(columns[c][x[same]] for x in (p, q) for c in ("lat", "lon")))
            straight = metres(*(columns[c][order[first[x : x + e - t]]] for x in (t, t + 1) for c in ("latitude", "longitude")))
            cost = np.round(np.abs(way - straight[step - t]), 3) / beta
            for i in range(t, e):
                yield cost[pairs[i] - pairs[t] : pairs[i + 1] - pairs[t]].reshape(size[i], size[i + 1])
            t = e

    path: list[int] = []
    chain: list[np.ndarray] = []  # the best candidate before, for each of a point's, since the last break

    def close(end: int, score: np.ndarray) -> None:
        k, own = int(score.argmax()), []
        for t in range(end, end - len(chain) - 1, -1):
            own.append(int(spans[t][k]))
            k = int(chain[t - end - 1][k]) if t > end - len(chain) else k
        path.extend(own[::-1])
        chain.clear()

    score = weight[spans[0]]
    for t, cost in enumerate(steps(), 1):
        q = spans[t]
        total = score[:, None] - cost
        best = total.argmax(0)
        reached = total[best, np.arange(len(q))]
        if np.isneginf(reached).all():
            close(t - 1, score)
            score = weight[q]
        else:
            chain.append(best)
            score = reached + weight[q]
    close(len(spans) - 1, score)
    share = np.exp(weight - np.repeat(np.maximum.reduceat(weight, first[:-1]), np.diff(first)))
    sums = np.add.reduceat(share, first[:-1])
    return [(int(at[i]), float(share[i] / s)) for i, s in zip(path, sums, strict=True)]


def hmm(points: DataFrame, segments: DataFrame, *, max_distance: float = 1000.0, max_speed: float = 200.0, sigma: float = 50.0, beta: float = 200.0, reach: float = 3000.0) -> DataFrame:
    """Per vehicle, the likeliest path by Gaussian distances to roads and by how far ways along roads differ from straight lines.

    A segment's chance falls with its distance (sigma, in metres), a step's with the difference between the shortest way along the
    roads and the great circle (exponentially, by beta metres). Ways between junctions of more than `reach` metres are none. A point
    that nothing before it leads to begins a new path; points that are too fast or have no segment within
    max_distance are passed over. Distances count to the millimetre, so equally likely candidates are equal, and the smaller id wins.

    Candidates and the ways from the junctions near a vehicle's day meet in one exchange by that day.
    """
    bare = points.where(filters.plausible_speed(max_speed)).select(*seq.KEYS, "datetime", "event_id", "latitude", "longitude")
    ends = segments.select("segment_id", "start_lat", "start_lon", "end_lat", "end_lon", junction("start_lat", "start_lon").alias("a"), junction("end_lat", "end_lon").alias("b"))
    met = roads.with_candidates(bare, ends, max_distance, "inner")
    # a filter by distance would become a part of the join, which computes each expression again wherever it stands: the fold leaves out those too far
    place = geo.closest("latitude", "longitude", "start_lat", "start_lon", "end_lat", "end_lon")
    cand = met.withColumn("p", place).withColumns({"lat": F.col("p.lat"), "x": F.col("p.lon")}).select(
        *seq.KEYS, "datetime", "event_id", "latitude", "longitude", "segment_id", "lat", geo.wrapped(F.col("x")).alias("lon"), geo.haversine("latitude", "longitude", "lat", "x").alias("distance"),
        geo.haversine("start_lat", "start_lon", "lat", "x").alias("from_a"), geo.haversine("lat", "x", "end_lat", "end_lon").alias("from_b"), "a", "b",
    )
    # junctions need no distances
    boxed = roads.with_candidates(bare.select(*seq.KEYS, "latitude", "longitude"), ends.select("start_lat", "start_lon", "end_lat", "end_lon", "a", "b"), max_distance, "inner")
    met_at = boxed.select(*seq.KEYS, F.explode(F.array("a", "b")).alias("origin")).distinct()
    # roads that no point is near to need no search
    size = max(roads.CELL, max_distance / 110_000.0)
    cells = bare.select(geo.cell("longitude", size).alias("_gx"), geo.cell("latitude", size).alias("_gy")).distinct()
    touched = roads._listed(ends, max_distance, size).select("_gx", "_gy", "a", "b").join(cells.hint("merge"), ["_gx", "_gy"], "left_semi")
    ways = routes(segments, reach, touched.select(F.explode(F.array("a", "b")).alias("origin"))).groupBy("origin").agg(F.collect_list("target").alias("targets"), F.collect_list("metres").alias("ways"))
    near = met_at.join(ways.hint("merge"), "origin").select(*seq.KEYS, F.col("origin").alias("a"), "targets", "ways")
    both = cand.unionByName(near, allowMissingColumns=True)

    def fold(table: pa.Table, starts) -> Iterator[pa.RecordBatch]:
        rows, ends = _Rows(table), [*starts.tolist()[1:], table.num_rows]
        found = [x for a, b in zip(starts.tolist(), ends, strict=True) for x in _likeliest(rows, a, b, max_distance, sigma, beta)]
        out = table.select(["event_id", "segment_id", "lat", "lon", "distance"]).take(pa.array([i for i, _ in found], pa.int64()))
        yield from out.rename_columns(["event_id", "segment_id", "matched_lat", "matched_lon", "distance"]).append_column("confidence", pa.array([c for _, c in found], pa.float64())).to_batches()

    return seq.by_vehicle(roads.dealt(both, *seq.KEYS), fold, "event_id long, segment_id string, matched_lat double, matched_lon double, distance double, confidence double", placed=True)
