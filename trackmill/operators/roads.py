"""Roads as segments and polylines, and searches for the closest ones.

Searches are equi-joins on grid cells. A segment is listed in every cell that its box, widened by the
search distance at its latitude, touches, so a point looks into its own cell only and misses nothing within
that distance. Cell joins shuffle: Catalyst knows the size of the road table, but not how many cells a
segment is listed in, and would send the driver many times what it expects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo

#: cells are this wide at least, in degrees; much smaller than the search distance they would only multiply rows
CELL = 0.01


def segments_of(roads: DataFrame) -> DataFrame:
    """road_id, road_name, road_type, seq and the two ends of each part of coords array<struct<x, y>>."""
    parts = F.transform(F.sequence(F.lit(0), F.size("coords") - 2), lambda i: F.struct(F.get("coords", i).alias("a"), F.get("coords", i + 1).alias("b")))
    out = roads.where(F.size("coords") >= 2).select("road_id", "road_name", "road_type", F.posexplode(parts).alias("seq", "p"))
    return out.select(
        F.concat_ws("_", "road_id", "seq").alias("segment_id"), "road_id", "seq",
        F.col("p.a.y").alias("start_lat"), F.col("p.a.x").alias("start_lon"), F.col("p.b.y").alias("end_lat"), F.col("p.b.x").alias("end_lon"), "road_name", "road_type",
    )


def polylines(segments: DataFrame) -> DataFrame:
    """road_id, road_name, road_type and coords: each segment's start in order, then the last one's end."""
    ends = F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("start_lon").alias("x"), F.col("start_lat").alias("y")).alias("a"), F.struct(F.col("end_lon").alias("x"), F.col("end_lat").alias("y")).alias("b"))))
    out = segments.groupBy("road_id").agg(F.min("road_name").alias("road_name"), F.min("road_type").alias("road_type"), ends.alias("e"))
    return out.select("road_id", "road_name", "road_type", F.concat(F.transform("e", lambda x: x["a"]), F.array(F.element_at("e", -1)["b"])).alias("coords"))


def vertices(roads: DataFrame) -> DataFrame:
    """One row for each vertex, with its place."""
    return roads.select("road_id", "road_name", "road_type", F.posexplode("coords").alias("point_index", "p")).select("road_id", "road_name", "road_type", "point_index", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def _cells(lo_lat: Column, hi_lat: Column, lo_lon: Column, hi_lon: Column, size: float) -> Column:
    """All cells of a box as array<struct<gx, gy>>."""
    xs = F.sequence(geo.cell(lo_lon, size), geo.cell(hi_lon, size))
    ys = F.sequence(geo.cell(lo_lat, size), geo.cell(hi_lat, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def _listed(segments: DataFrame, max_distance: float, size: float) -> DataFrame:
    """segments in every cell from which one may lie within max_distance, with that box (_lo_lat, _hi_lat, _lo_lon, _hi_lon).

    The box is widened by what the segment's own latitude asks for. Where it passes 180 degrees it comes again
    on the other side, with its longitudes moved by 360 so that they compare with the points' there. A segment
    of more than 180 degrees goes the short way round.
    """
    dlat = max_distance / 110_000.0
    long_way = F.col("end_lon") - F.col("start_lon")
    s = segments.withColumn("end_lon", F.when(long_way > 180, F.col("end_lon") - 360).when(long_way < -180, F.col("end_lon") + 360).otherwise(F.col("end_lon")))
    s = s.withColumns({"_lo_lat": F.least("start_lat", "end_lat") - dlat, "_hi_lat": F.greatest("start_lat", "end_lat") + dlat})
    widest = F.greatest(F.abs("_lo_lat"), F.abs("_hi_lat"))
    # within this angle no meridian is crossed twice; near a pole it is all of them
    sine = math.sin(math.radians(dlat) / 2) / F.cos(F.radians(widest))
    dlon = F.when((widest >= 90) | (sine >= 1), 360.0).otherwise(F.degrees(F.asin(F.when(sine < 1, sine))) * 2.000001)
    lo, hi = F.least("start_lon", "end_lon"), F.greatest("start_lon", "end_lon")
    s = s.withColumns({"_mid": (lo + hi) / 2, "_lo_lon": F.greatest(lo - dlon, (lo + hi) / 2 - 180), "_hi_lon": F.least(hi + dlon, (lo + hi) / 2 + 180)})
    sides = F.filter(F.array(*map(F.lit, (-360.0, 0.0, 360.0))), lambda x: (F.col("_hi_lon") + x >= -180) & (F.col("_lo_lon") + x <= 180))
    s = s.withColumn("_x", F.explode(sides))
    s = s.withColumns({c: F.col(c) + F.col("_x") for c in ("start_lon", "end_lon", "_lo_lon", "_hi_lon")})
    cells = _cells(F.col("_lo_lat"), F.col("_hi_lat"), F.greatest(F.col("_lo_lon"), F.lit(-180.0)), F.least(F.col("_hi_lon"), F.lit(180.0)), size)
    return s.withColumn("_c", F.explode(cells)).withColumns({"_gx": F.col("_c.gx"), "_gy": F.col("_c.gy")}).drop("_c", "_x", "_mid")


def dealt(points: DataFrame, *cells: Column | str) -> DataFrame:
    """points placed by cell (or vehicle), in as many tasks as there are shuffle partitions: candidates multiply a task's rows or work after this exchange, so its bytes must not decide how many tasks are made one."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cells)


def with_candidates(points: DataFrame, segments: DataFrame, max_distance: float, how: str = "left") -> DataFrame:
    """Each point with the segments that may lie within max_distance metres, at any latitude and across 180 degrees."""
    size = max(CELL, max_distance / 110_000.0)
    here = points.withColumns({"_px": geo.cell("longitude", size), "_py": geo.cell("latitude", size)})
    inside = F.col("latitude").between(F.col("_lo_lat"), F.col("_hi_lat")) & F.col("longitude").between(F.col("_lo_lon"), F.col("_hi_lon"))
    met = dealt(here, "_px", "_py").join(_listed(segments, max_distance, size).hint("merge"), (F.col("_px") == F.col("_gx")) & (F.col("_py") == F.col("_gy")) & inside, how)
    return met.drop("_px", "_py", "_gx", "_gy", "_lo_lat", "_hi_lat", "_lo_lon", "_hi_lon")


def nearest_segment(points: DataFrame, segments: DataFrame, max_distance: float = 1000.0, key: str = "event_id") -> DataFrame:
    """key, segment_id, matched_lat, matched_lon, distance and confidence of points with a segment in reach; ties, to a nanometre, go to the smaller id."""
    bare = points.select(key, "latitude", "longitude")
    ends = segments.select("segment_id", "start_lat", "start_lon", "end_lat", "end_lon")
    place = geo.closest("latitude", "longitude", "start_lat", "start_lon", "end_lat", "end_lon")
    met = with_candidates(bare, ends, max_distance, "inner").select(key, "latitude", "longitude", "segment_id", place.alias("p"))
    far = geo.haversine("latitude", "longitude", "p.lat", "p.lon")
    best = met.groupBy(key).agg(F.min(F.struct(F.round(far, 9).alias("r"), "segment_id", far.alias("distance"), "p")).alias("m")).where(F.col("m.distance") <= max_distance)
    distance = F.col("m.distance")
    return best.select(key, "m.segment_id", F.col("m.p.lat").alias("matched_lat"), geo.wrapped(F.col("m.p.lon")).alias("matched_lon"), distance.alias("distance"), F.greatest(F.lit(0.0), 1 - distance / max_distance).alias("confidence"))


def nearest_vertex(points: DataFrame, corners: DataFrame, key: str = "event_id", planar: bool = False, reach: float = 0.01, ring: int = 1) -> DataFrame:
    """key and the closest of all vertices, without a limit: cells around the point first, wider ones for points that found none.

    corners: vertex_id, lat, lon. A find in the rings is final if it is closer than their rim; the rest,
    which a road network that covers its points leaves few of, look through cells 32 times as wide, so that few rounds reach
    any distance. Columns of cells go round the earth; planar distances, in plain degrees, do not.

    All rounds are one plan: a round's result goes on by a filter, so its exchange is made once, and adaptive execution
    leaves out the rounds that nothing comes to.
    """
    left, done = points.select(key, "latitude", "longitude"), None
    while True:
        best = _in_rings(left, corners, key, planar, reach, ring, few=done is not None)
        if reach > 180:
            final = best.where("m IS NOT NULL")
        else:
            # the rim is at least ring cells away; a degree of longitude shrinks with the latitude
            rim = F.lit(ring * reach) if planar else F.lit(ring * reach * geo.DEGREE) * F.cos(F.radians(F.least(F.abs(F.col("latitude")) + ring * reach + 1, F.lit(90.0))))
            within = F.coalesce(F.col("m.distance") <= rim, F.lit(False))
            final, left = best.where(within), best.where(~within).select(key, "latitude", "longitude")
        told = final.select(key, "m.vertex_id", "m.lat", "m.lon", "m.distance")
        done = told if done is None else done.unionByName(told)
        if reach > 180:
            return done
        reach *= 32


def _in_rings(points: DataFrame, corners: DataFrame, key: str, planar: bool, reach: float, ring: int, few: bool) -> DataFrame:
    """Each point with m, the closest vertex of the cells around it, or null. Vertices stand in the cells around them, or, where points are few, these in theirs."""
    n = max(1, math.floor(360 / reach))
    far = lambda lat, lon: F.sqrt(F.pow(F.col("longitude") - lon, 2) + F.pow(F.col("latitude") - lat, 2)) if planar else geo.haversine("latitude", "longitude", lat, lon)
    column = lambda lon: geo.cell(lon, reach) if planar else F.pmod(geo.cell(F.col(lon) + 180, 360 / n), F.lit(n))
    columns = F.sequence(F.col("gx") - ring, F.col("gx") + ring)
    columns = columns if planar else F.array_distinct(F.transform(columns, lambda x: F.pmod(x, F.lit(n))))
    around = F.flatten(F.transform(columns, lambda x: F.transform(F.sequence(F.col("gy") - ring, F.col("gy") + ring), lambda y: F.struct(x.alias("gx"), y.alias("gy")))))
    spread = lambda df: df.withColumn("c", F.explode(around)).withColumns({"gx": F.col("c.gx"), "gy": F.col("c.gy")}).drop("c")
    here = points.withColumns({"gx": column("longitude"), "gy": geo.cell("latitude", reach)})
    listed = corners.withColumns({"gx": column("lon"), "gy": geo.cell("lat", reach)})
    here, listed = (spread(here), listed) if few else (dealt(here, "gx", "gy"), spread(listed))
    met = here.join(listed.hint("merge"), ["gx", "gy"], "left")
    d = far(F.col("lat"), F.col("lon"))
    one = F.when(F.col("vertex_id").isNotNull(), F.struct(F.round(d, 9).alias("r"), "vertex_id", "lat", "lon", d.alias("distance")))
    return met.groupBy(key, "latitude", "longitude").agg(F.min(one).alias("m"))


def connected(segments: DataFrame, tolerance: float = 1e-6, itself: bool = False) -> DataFrame:
    """from_id and to_id of segments that share an end within the tolerance: an equi-join on rounded ends and their neighbours."""
    ends = lambda a, b: segments.select(F.col("segment_id").alias(a), F.explode(F.array(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")))).alias(b))
    mine = ends("from_id", "p").withColumns({"kx": geo.cell(F.col("p.lon"), tolerance), "ky": geo.cell(F.col("p.lat"), tolerance)})
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = ends("to_id", "q").withColumn("s", F.explode(shifts)).withColumns({"kx": geo.cell(F.col("q.lon"), tolerance) + F.col("s.i"), "ky": geo.cell(F.col("q.lat"), tolerance) + F.col("s.j")})
    near = (F.abs(F.col("p.lat") - F.col("q.lat")) < tolerance) & (F.abs(F.col("p.lon") - F.col("q.lon")) < tolerance)
    out = mine.join(other.hint("merge"), ["kx", "ky"]).where(near)
    return (out if itself else out.where("from_id <> to_id")).select("from_id", "to_id").distinct()


def grid_candidates(points: DataFrame, roads: DataFrame, size: float = 0.001, most: int = 50, key: str = "event_id", index: str = "vertex") -> DataFrame:
    """Each point with the roads that have a vertex (or, by option, any part of a segment's box) in the 3 by 3 cells around it; the closest `most` of them.

    Cells start at 0; square is the squared distance to the road in degrees. A road with a vertex around is closer
    than three cells, so segments are looked for up to three cells around and one join finds all that matter, however
    long the road.
    """
    s = segments_of(roads).select("road_id", "seq", "start_lat", "start_lon", "end_lat", "end_lon")
    here = points.select(key, "longitude", "latitude", geo.cell("longitude", size).alias("gx"), geo.cell("latitude", size).alias("gy"))
    lo, hi = (lambda c: F.least(f"start_{c}", f"end_{c}")), (lambda c: F.greatest(f"start_{c}", f"end_{c}"))
    if index == "vertex":
        ends = {f"_{c}{i}": geo.cell(f"{end}_{name}", size) for i, end in enumerate(("start", "end")) for c, name in (("x", "lon"), ("y", "lat"))}
        s = s.withColumns(ends)
        reach = lambda c, f, by: f(f"_{c}0", f"_{c}1") + by
        # the join's own cells are four wide, so that a segment stands in few of them
        wide = lambda c: F.floor(c / 4).cast("long")
        xs, ys = (F.sequence(wide(reach(c, F.least, -3)), wide(reach(c, F.greatest, 3))) for c in "xy")
        listed = s.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))
        close = [F.col(f"g{c}").between(reach(c, F.least, -3), reach(c, F.greatest, 3)) for c in "xy"]
        around = lambda i: (F.abs(F.col("gx") - F.col(f"_x{i}")) <= 1) & (F.abs(F.col("gy") - F.col(f"_y{i}")) <= 1)
        met = dealt(here, wide(F.col("gx")), wide(F.col("gy"))).join(listed.hint("merge"), (wide(F.col("gx")) == F.col("_gx")) & (wide(F.col("gy")) == F.col("_gy")) & close[0] & close[1]).withColumn("near", around(0) | around(1))
    else:
        # a box may be far from its segment, so the road's other segments have to be looked at
        cells = s.select("road_id", F.explode(_cells(lo("lat"), hi("lat"), lo("lon"), hi("lon"), size)).alias("c")).select("c.gx", "c.gy", "road_id").distinct()
        around = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        found = here.select(key, "longitude", "latitude", F.explode(around).alias("c")).select(key, "longitude", "latitude", "c.gx", "c.gy").join(cells.hint("merge"), ["gx", "gy"]).select(key, "longitude", "latitude", "road_id").distinct()
        met = found.join(s.hint("merge"), "road_id").withColumn("near", F.lit(True))
    p = geo.closest("latitude", "longitude", "start_lat", "start_lon", "end_lat", "end_lon")
    square = F.pow(F.col("longitude") - F.col("p.lon"), 2) + F.pow(F.col("latitude") - F.col("p.lat"), 2)
    met = met.withColumn("p", p)
    # a vertex around is closer than that, so is the closest part of its road
    met = met.where(square <= 8.000001 * size * size) if index == "vertex" else met
    each = met.groupBy(key, "road_id").agg(F.min(F.struct(square.alias("square"), "seq", "p.lat", "p.lon")).alias("m"), F.max("near").alias("near")).where("near")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("m.square", 12), "road_id"))
    return each.withColumn("_r", rank).where(F.col("_r") <= most).select(key, "road_id", "m.square", "m.lat", "m.lon")


def header(segments: DataFrame) -> DataFrame:
    """One row: number of roads, total length and bounds."""
    length = geo.haversine("start_lat", "start_lon", "end_lat", "end_lon")
    lo, hi = (lambda c: F.min(F.least(f"start_{c}", f"end_{c}"))), (lambda c: F.max(F.greatest(f"start_{c}", f"end_{c}")))
    return segments.agg(F.count("*").alias("total_roads"), F.sum(length).alias("total_length"), lo("lat").alias("min_lat"), hi("lat").alias("max_lat"), lo("lon").alias("min_lng"), hi("lon").alias("max_lng"))
