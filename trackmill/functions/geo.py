"""Geographic functions as Column expressions; metres and degrees, WGS-84."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: mean earth radius, Web Mercator half extent, metres of a degree in planar matching
RADIUS = 6371000.0
MERCATOR = 20037508.34
DEGREE = 111000.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would turn an unknown place into a known distance
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def midpoint(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle midpoint, struct<lat, lon>; the longitude is not wrapped."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    bx = F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    by = F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1))
    c = F.cos(F.radians(lat1)) + bx
    lat = F.atan2(F.sin(F.radians(lat1)) + F.sin(F.radians(lat2)), F.sqrt(c * c + by * by))
    return F.struct(F.degrees(lat).alias("lat"), (lon1 + F.degrees(F.atan2(by, c))).alias("lon"))


def to_mercator(lat, lon) -> Column:
    lat, lon = col(lat), col(lon)
    y = F.log(F.tan((lat + 90.0) * F.lit(3.141592653589793 / 360))) / F.lit(3.141592653589793 / 180)
    return F.struct((lon * MERCATOR / 180).alias("x"), (y * MERCATOR / 180).alias("y"))


def from_mercator(x, y) -> Column:
    x, y = col(x), col(y)
    lat = F.atan(F.exp(y / MERCATOR * F.lit(3.141592653589793))) * F.lit(360 / 3.141592653589793) - 90
    return F.struct(lat.alias("lat"), (x / MERCATOR * 180).alias("lon"))


def closest(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """The closest point of a segment in plain degrees: struct<lat, lon>. A point-like segment is its start."""
    lat, lon, lat1, lon1, lat2, lon2 = map(col, (lat, lon, lat1, lon1, lat2, lon2))
    dx, dy = lon2 - lon1, lat2 - lat1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - lon1) * dx + (lat - lat1) * dy) / F.when(square == 0, F.lit(1.0)).otherwise(square))))
    return F.struct((lat1 + t * dy).alias("lat"), (lon1 + t * dx).alias("lon"))


def project(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """As closest(), with the distance in metres: struct<distance, lat, lon>."""
    p = closest(lat, lon, lat1, lon1, lat2, lon2)
    return F.struct(haversine(lat, lon, p["lat"], p["lon"]).alias("distance"), p["lat"].alias("lat"), p["lon"].alias("lon"))


def planar_square(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Squared distance to a segment in degrees."""
    p = project(lat, lon, lat1, lon1, lat2, lon2)
    return F.pow(col(lon) - p["lon"], 2) + F.pow(col(lat) - p["lat"], 2)


def fold(diff: Column) -> Column:
    """An angle between directions: at most 180."""
    diff = F.abs(diff)
    return F.when(diff > 180, 360 - diff).otherwise(diff)


def road_direction(first: Column, last: Column) -> Column:
    """Angle from east, counter-clockwise, of a line's ends given as struct<x, y>."""
    return F.pmod(F.degrees(F.atan2(last["y"] - first["y"], last["x"] - first["x"])) + 360.0, F.lit(360.0))


def cell(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(size)).cast("long")


def shoelace_sphere(ring: Column) -> Column:
    """Area in square metres of a ring array<struct<x, y>>; 0 for fewer than 3 vertices."""
    n = F.size(ring)
    term = lambda i: F.radians(F.get(ring, F.pmod(i + 1, n))["x"] - F.get(ring, i)["x"]) * (2 + F.sin(F.radians(F.get(ring, i)["y"])) + F.sin(F.radians(F.get(ring, F.pmod(i + 1, n))["y"])))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(total * (RADIUS * RADIUS / 2)))


def ring_mean(ring: Column) -> Column:
    """Mean of a ring's vertices as they are listed (a closing one counts): struct<lat, lon>."""
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return F.struct(mean("y").alias("lat"), mean("x").alias("lon"))


def in_rings(lon: Column, lat: Column, polygons: Column) -> Column:
    """Even-odd test against any exterior ring of array<array<struct<x, y>>>."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def hit(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
            dy = b["y"] - a["y"]
            at = (b["x"] - a["x"]) * (lat - a["y"]) / F.when(dy == 0, F.lit(1.0)).otherwise(dy) + a["x"]
            return ((a["y"] > lat) != (b["y"] > lat)) & (lon < at)

        return F.size(F.filter(F.sequence(F.lit(0), n - 1), hit)) % 2 == 1

    return F.exists(polygons, crossings)


#: fixed values: the WGS-84 ellipsoid, and how long and how far its distance is iterated
AXIS, FLATTENING, ROUNDS, SETTLED = 6378137.0, 1 / 298.257223563, 100, 1e-12


def _let(var: str, values: dict[str, str], body: str) -> str:
    """SQL of a body in which var is a struct of these values, each of which is evaluated once."""
    return f"get(transform(array(named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())})), {var} -> {body}), 0)"


def vincenty_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of the distance on the WGS-84 ellipsoid by the published inverse series; 0 where places coincide or the iteration does not settle."""
    f, minor = FLATTENING, AXIS * (1 - FLATTENING)
    zeros = ", ".join(f"'{k}', 0D" for k in ("sin", "cos", "arc", "cc", "mid"))
    # one step of the longitude on the auxiliary sphere
    new = f"g.gap + (1D - m.c) * {f!r}D * m.a * (m.arc + m.c * m.sin * (m.mid + m.c * m.cos * (m.mid * m.mid * 2D - 1D)))"
    settled = _let("z", {"new": new}, f"named_struct('lam', z.new, 'done', abs(z.new - s.lam) <= {SETTLED!r}D, 'sin', m.sin, 'cos', m.cos, 'arc', m.arc, 'cc', m.cc, 'mid', m.mid)")
    middle = _let("m", {**{k: f"a.{k}" for k in ("sin", "cos", "arc", "a", "cc")}, "mid": "IF(a.cc = 0D, 0D, a.cos - g.s1 * g.s2 * 2D / nullif(a.cc, 0D))", "c": f"a.cc * {f / 16!r}D * ((4D - a.cc * 3D) * {f!r}D + 4D)"}, settled)
    azimuth = _let("a", {"sin": "p.sin", "cos": "p.cos", "arc": "atan2(p.sin, p.cos)", "a": "p.a", "cc": "1D - p.a * p.a"}, middle)
    sphere = _let("p", {"sin": "x.sin", "cos": "x.cos", "a": "IF(x.sin = 0D, 0D, g.c1 * g.c2 * x.sl / nullif(x.sin, 0D))"}, azimuth)
    ends = _let("x", {"sin": "sqrt(power(g.c2 * w.sl, 2D) + power(g.c1 * g.s2 - g.s1 * g.c2 * w.cl, 2D))", "cos": "g.s1 * g.s2 + g.c1 * g.c2 * w.cl", "sl": "w.sl"}, sphere)
    step = f"IF(s.done, s, {_let('w', {'sl': 'sin(s.lam)', 'cl': 'cos(s.lam)'}, ends)})"
    walk = lambda begin, first, last: f"aggregate(sequence({first}, {last}), {begin}, (s, i) -> {step})"
    start = f"named_struct('lam', g.gap, 'done', false, {zeros})"
    inner = "e.cos * (e.mid * e.mid * 2D - 1D) - b.small / 6D * e.mid * (e.sin * e.sin * 4D - 3D) * (e.mid * e.mid * 4D - 3D)"
    length = _let("b", {"big": "u.uu / 16384D * (u.uu * (u.uu * (320D - u.uu * 175D) - 768D) + 4096D) + 1D", "small": "u.uu / 1024D * (u.uu * (u.uu * (74D - u.uu * 47D) - 128D) + 256D)"}, f"b.big * {minor!r}D * (e.arc - b.small * e.sin * (e.mid + b.small / 4D * ({inner})))")
    whole = f"IF(e.done AND e.sin <> 0D, {_let('u', {'uu': f'e.cc * {(AXIS**2 - minor**2) / minor**2!r}D'}, length)}, 0D)"
    fields = ("lam", "done", "sin", "cos", "arc", "cc", "mid")
    rest = _let("h", {"s": walk(start, 1, 8)}, _let("r", {"s": f"IF(h.s.done, h.s, {walk('h.s', 9, ROUNDS)})"}, _let("e", {k: f"r.s.{k}" for k in fields}, whole)))
    reduced = lambda c: f"atan(tan(radians({c})) * {1 - f!r}D)"
    apart = _let("v", {"u1": reduced(lat1), "u2": reduced(lat2), "gap": f"radians({lon2} - {lon1})"}, _let("g", {"s1": "sin(v.u1)", "c1": "cos(v.u1)", "s2": "sin(v.u2)", "c2": "cos(v.u2)", "gap": "v.gap"}, rest))
    return f"CASE WHEN {lat1} IS NULL OR {lon1} IS NULL OR {lat2} IS NULL OR {lon2} IS NULL THEN NULL WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0D ELSE {apart} END"


def vincenty(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """As vincenty_sql(), of columns by name."""
    return F.expr(vincenty_sql(lat1, lon1, lat2, lon2))


#: rounds that are written out; steps of some tens of kilometres have settled by then
FEW_ROUNDS = 4


def with_ellipsoid(df: DataFrame, name: str, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    """df and the distance that vincenty() gives, in plain columns, which become machine code; the rare rows that a few rounds do not settle (far or nearly opposite places) go through vincenty() itself.

    One projection whose columns build on each other. Its own columns have no nulls, so that no step has to look for them.
    """
    f, minor = FLATTENING, AXIS * (1 - FLATTENING)
    known = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0D)"
    steps = [f"atan(tan(radians({known(c)})) * {1 - f!r}D) AS _u{i}" for i, c in ((1, lat1), (2, lat2))]
    steps += [f"radians({known(lon2)} - {known(lon1)}) AS _l0", "sin(_u1) AS _s1", "cos(_u1) AS _c1", "sin(_u2) AS _s2", "cos(_u2) AS _c2", "_s1 * _s2 AS _ss", "_c1 * _c2 AS _cc"]
    for i in range(1, FEW_ROUNDS + 1):
        steps += [
            f"sin(_l{i - 1}) AS _sl{i}", f"cos(_l{i - 1}) AS _cl{i}", f"_c2 * _sl{i} AS _x{i}", f"_c1 * _s2 - _s1 * _c2 * _cl{i} AS _y{i}", f"_ss + _cc * _cl{i} AS _co{i}", f"sqrt(_x{i} * _x{i} + _y{i} * _y{i}) AS _si{i}",
            f"atan2(_si{i}, _co{i}) AS _arc{i}", f"coalesce(_cc * _sl{i} / nullif(_si{i}, 0D), 0D) AS _a{i}", f"1D - _a{i} * _a{i} AS _q{i}", f"IF(_q{i} = 0D, 0D, _co{i} - coalesce(2D * _ss / nullif(_q{i}, 0D), 0D)) AS _m{i}",
            f"_q{i} * {f / 16!r}D * ((4D - _q{i} * 3D) * {f!r}D + 4D) AS _k{i}", f"_l0 + (1D - _k{i}) * {f!r}D * _a{i} * (_arc{i} + _k{i} * _si{i} * (_m{i} + _k{i} * _co{i} * (_m{i} * _m{i} * 2D - 1D))) AS _n{i}",
            f"IF(abs(_n{i} - _l{i - 1}) <= {SETTLED!r}D, _l{i - 1}, _n{i}) AS _l{i}",  # what has settled stays
        ]
    n = FEW_ROUNDS
    steps += [
        f"_q{n} * {(AXIS**2 - minor**2) / minor**2!r}D AS _w", f"_w * {1 / 16384!r}D * (_w * (_w * (320D - _w * 175D) - 768D) + 4096D) + 1D AS _big", f"_w * {1 / 1024!r}D * (_w * (_w * (74D - _w * 47D) - 128D) + 256D) AS _small",
        f"_co{n} * (_m{n} * _m{n} * 2D - 1D) - _small * {1 / 6!r}D * _m{n} * (_si{n} * _si{n} * 4D - 3D) * (_m{n} * _m{n} * 4D - 3D) AS _in",
        f"IF(_si{n} = 0D, 0D, _big * {minor!r}D * (_arc{n} - _small * _si{n} * (_m{n} + _small * 0.25D * _in))) AS _far", f"_l{n} = _l{n - 1} AS _near",
    ]
    told = " AND ".join(f"{c} IS NOT NULL" for c in (lat1, lon1, lat2, lon2))
    result = F.expr(f"CASE WHEN NOT ({told}) THEN NULL WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0D WHEN _near THEN _far ELSE {vincenty_sql(lat1, lon1, lat2, lon2)} END")
    return df.selectExpr("*", *steps).select(*[F.col(f"`{c}`") for c in df.columns if c != name], result.alias(name))


def wrapped(lon: Column) -> Column:
    """A longitude from -180 to 180."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
