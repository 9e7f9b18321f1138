"""Row predicates; each is a Column that Catalyst can push down or fold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def in_range(lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)


def valid_coordinate(lon: str = "longitude", lat: str = "latitude") -> Column:
    """In range and not (0, 0)."""
    return F.coalesce(in_range(lon, lat) & ~((F.col(lon) == 0) & (F.col(lat) == 0)), F.lit(False))


def valid_point() -> Column:
    """In range, with a plate that is not blank."""
    return F.coalesce(in_range() & (F.trim("plate_number") != ""), F.lit(False))


def valid_fix(flag: str = "is_valid") -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def completed(points: DataFrame, *, valid: bool) -> DataFrame:
    """Missing fields with their defaults: speed and heading 0, source_file empty, is_valid as told (true where trajectories are
    corrected, false where they are built); rows without a coordinate go."""
    defaults = {"speed": F.lit(0.0), "heading": F.lit(0.0), "source_file": F.lit(""), "is_valid": F.lit(valid)}
    filled = {c: F.coalesce(c, d) if c in points.columns else d for c, d in defaults.items()}
    return points.where("longitude IS NOT NULL AND latitude IS NOT NULL").withColumns(filled)


def has_points(column: str = "trajectory_points") -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def of_types(*kinds: str, column: str = "type") -> Column:
    return F.col(column).isin(*kinds)


def plausible_speed(most: float = 200.0) -> Column:
    return F.col("speed").isNull() | (F.col("speed") <= most)


def between_dates(start: str | None = None, end: str | None = None, column: str = "datetime") -> Column:
    """Whole days, either of which may be missing."""
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end:
        out = out & (F.col(column) <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return out


def between_times(start: str, end: str, column: str = "datetime") -> Column:
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def in_box(min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> Column:
    return F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lng, max_lng)


#: fixed values: rough extent of the country
CHINA = (3.86, 53.55, 73.66, 135.05)


def in_china() -> Column:
    return in_box(*CHINA)


#: fixed values: the rectangle that stands for the default area until its boundary is stored
DEFAULT_AREA = [[(113.812401, 22.503099), (114.269966, 22.503099), (114.269966, 22.748068), (113.812401, 22.748068)]]


def polygons(rings: list[list[tuple[float, float]]]) -> Column:
    """A literal array<array<struct<x, y>>>."""
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r]) for r in rings])


def in_area(rings: list[list[tuple[float, float]]] | None, *, default_area: bool = False) -> Column:
    """Inside one of an area's exterior rings, its box first. An area without boundary holds nothing if it is the default one, else everything."""
    if not rings:
        return F.lit(not default_area)
    xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
    box = in_box(min(ys), max(ys), min(xs), max(xs))
    whole = [r for r in rings if len(r) >= 3]  # of fewer points there is a box only
    return box & geo.in_rings(F.col("longitude"), F.col("latitude"), polygons(whole)) if whole else box


def parse_wkt(wkt: str) -> list[list[list[tuple[float, float]]]] | None:
    """Rings of each polygon of a POLYGON or MULTIPOLYGON, the exterior first; None if it cannot be read."""
    m = re.fullmatch(r"\s*(MULTIPOLYGON|POLYGON)\s*(\(.*\))\s*", wkt, re.S | re.I)
    if not m:
        return None
    try:
        body = m[2] if m[1].upper() == "MULTIPOLYGON" else f"({m[2]})"
        nested = eval_rings(body)
    except (ValueError, IndexError):
        return None
    return nested or None


def eval_rings(text: str) -> list:
    """Nested parentheses with coordinate lists inside."""
    out, stack, at = [], [], 0
    for token in re.finditer(r"[()]|[^()]+", text):
        t = token[0].strip()
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            (stack[-1] if stack else out).append(done)
        elif t.strip(", ") and stack:
            stack[-1].extend(tuple(map(float, p.split()[:2])) for p in t.split(",") if p.strip())
            if any(len(p) != 2 for p in stack[-1]):
                raise ValueError(t)
        at += 1
    if stack or len(out) != 1:
        raise ValueError(text)
    return out[0]


def in_wkt(wkt: str) -> Column:
    """Inside a WKT polygon, holes left out. What cannot be read holds everything."""
    parsed = parse_wkt(wkt)
    if parsed is None:
        return F.lit(True)
    lon, lat, out = F.col("longitude"), F.col("latitude"), F.lit(False)
    for outer, *holes in parsed:
        inside = geo.in_rings(lon, lat, polygons([outer]))
        out = out | (inside & ~geo.in_rings(lon, lat, polygons(holes)) if holes else inside)
    return out


def checks(points: DataFrame) -> DataFrame:
    """A boolean for each field rule."""
    ok = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    return points.withColumns({"ok_coordinate": F.coalesce(in_range(), F.lit(False)), "ok_speed": ok("speed", 0, 200), "ok_speed_schema": ok("speed", 0, 500), "ok_direction": ok("heading", 0, 360), "ok_time": F.col("datetime").isNotNull()})


def task_list(tasks: DataFrame, *, status: str | None = None, source: str | None = None, vehicle: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Tasks or trajectories by the filters that are given."""
    for column, value in (("status", status), ("source", source), ("vehicle_id", vehicle)):
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    if since:
        tasks = tasks.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return tasks.where(F.col("created_at") <= F.lit(until).cast("timestamp_ntz")) if until else tasks
