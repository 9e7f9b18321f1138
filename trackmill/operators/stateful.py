"""Sequence operators with a state that no fixed window frame holds, folded one vehicle at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import RADIUS
from . import sequence as seq


def without_outliers(points: DataFrame, *, metres: float = 10000.0, top_speed: float = 200.0, accuracy: float = 1000.0) -> DataFrame:
    """event_id of rows close enough to the last row that was kept, not too fast and accurate enough; missing and zero values pass."""
    rough = F.coalesce(F.col("accuracy") > accuracy, F.lit(False)) if "accuracy" in points.columns else F.lit(False)
    bad = F.coalesce(F.col("speed") > top_speed, F.lit(False)) | rough
    rows = F.array_sort(F.collect_list(F.struct("datetime", "event_id", "latitude", "longitude", bad.alias("bad"))))
    state = "struct<lat: double, lon: double, ids: array<bigint>>"

    def step(s, p):
        first = F.size(s["ids"]) == 0
        far = geo.haversine(s["lat"], s["lon"], p["latitude"], p["longitude"]) > metres
        keep = first | (~p["bad"] & ~far)
        return F.when(keep, F.struct(p["latitude"].alias("lat"), p["longitude"].alias("lon"), F.concat(s["ids"], F.array(p["event_id"])).alias("ids"))).otherwise(s)

    start = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.array().cast("array<bigint>").alias("ids")).cast(state)
    return points.groupBy(*seq.KEYS).agg(rows.alias("rows")).select(*seq.KEYS, F.explode(F.aggregate("rows", start, step)["ids"]).alias("event_id"))


def simplify_rows(lat: list[float], lon: list[float], metres: float) -> list[int]:
    """Places that Douglas-Peucker keeps; spans wait on a stack."""
    import numpy as np

    n = len(lat)
    if n <= 2:
        return list(range(n))
    y, x = np.asarray(lat, float), np.asarray(lon, float)
    keep, spans = np.zeros(n, bool), [(0, n - 1)]
    keep[[0, -1]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        py, px = y[a + 1 : b], x[a + 1 : b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / square, 0, 1) if square else np.zeros(len(px))
        qy, qx = np.radians(y[a] + t * dy), np.radians(x[a] + t * dx)
        py, px = np.radians(py), np.radians(px)
        h = np.sin((qy - py) / 2) ** 2 + np.cos(py) * np.cos(qy) * np.sin((qx - px) / 2) ** 2
        d = 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))
        i = int(np.round(d, 6).argmax())
        if d[i] > metres:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep).tolist()


def simplified(points: DataFrame, metres: float = 10.0) -> DataFrame:
    """KEYS and event_id of the rows that Douglas-Peucker keeps."""

    def fold(table: pa.Table, starts) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lat, lon = (table[c].to_numpy() for c in ("latitude", "longitude"))
        ends = np.r_[starts[1:], table.num_rows]
        kept = [np.asarray(simplify_rows(lat[a:b], lon[a:b], metres), np.int64) + a for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield from table.select([*seq.KEYS, "event_id"]).take(pa.array(np.concatenate(kept))).to_batches()

    rows = points.select(*seq.KEYS, "datetime", "event_id", "latitude", "longitude")
    return seq.by_vehicle(rows, fold, "day string, plate_number string, event_id long")
