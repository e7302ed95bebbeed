"""Geometry on rings of points as Column expressions, without a geometry library.

A ring is array<struct<x,y>>, closed or not; a polygon is an array of rings, the
first one outer; a line is a ring that stays open. Everything is built from
higher-order functions, so it stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
DEGREE_M_MAP, DEGREE_M_LOG = 111320.0, 111000.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once: a plain Python variable would copy its whole expression to every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points(pairs: Column) -> Column:
    """GeoJSON positions [[x, y], ...] as points."""
    return F.transform(pairs, lambda p: point(p[0], p[1]))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def closed(ring: Column) -> Column:
    """The ring with its first point at the end too."""
    return let(ring, _closed)


def _closed(ring: Column) -> Column:
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))


def without_repeats(ring: Column) -> Column:
    """Drops points equal to the one before."""
    return let(ring, lambda r: F.filter(r, lambda p, i: (i == 0) | ~(p.eqNullSafe(F.try_element_at(r, F.greatest(i, F.lit(1)))))))


def edges(ring: Column) -> Column:
    return let(ring, _edges)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n > 1, F.transform(F.slice(ring, F.lit(1), n - 1), lambda p, i: F.struct(p.alias("a"), F.element_at(ring, i + 2).alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def ring_area(ring: Column) -> Column:
    """Signed area: positive if the ring runs against the clock."""
    return _sum(edges(closed(ring)), _cross) / 2


def area(polygon: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    return F.aggregate(polygon, F.lit(0.0), lambda acc, r: F.when(acc == 0, F.abs(ring_area(r))).otherwise(acc - F.abs(ring_area(r))))


def area_degrees_m2(polygon: Column) -> Column:
    """Degree area times 111320 squared; it overestimates by 1/cos of the latitude."""
    return F.round(area(polygon) * DEGREE_M_MAP**2, 2)


def area_degrees_coarse(polygon: Column) -> Column:
    return area(polygon) * DEGREE_M_LOG**2


def centroid(polygon: Column) -> Column:
    """Area centroid of the outer ring; a flat ring has its vertex mean."""
    return let(polygon[0], lambda outer: let(closed(outer), lambda ring: _centroid(outer, ring)))


def _centroid(outer: Column, ring: Column) -> Column:
    # moments about the first point: coordinates far from zero would cancel otherwise
    o = ring[0]
    local = edges(F.transform(ring, lambda p: point(p["x"] - o["x"], p["y"] - o["y"])))

    def moments(es: Column) -> Column:
        six = F.nullif(3 * _sum(es, _cross), F.lit(0.0))
        cx = _sum(es, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e)) / six
        cy = _sum(es, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e)) / six
        mean = vertex_mean(outer)
        return point(F.coalesce(o["x"] + cx, mean["x"]), F.coalesce(o["y"] + cy, mean["y"]))

    return let(local, moments)


def vertex_mean(ring: Column) -> Column:
    """Mean of the points as listed: a closing point counts twice."""
    n = F.nullif(F.size(ring), F.lit(0))
    return point(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["x"]) / n, F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / n)


def first_vertex(ring: Column) -> Column:
    return F.try_element_at(ring, F.lit(1))


def middle_vertex(line: Column) -> Column:
    return F.try_element_at(line, F.floor(F.size(line) / 2).cast("int") + 1)


def bounds(polygon: Column) -> Column:
    flat = F.flatten(polygon)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def largest(multi: Column) -> Column:
    """The part of a multipolygon with the largest area; of equals the first."""
    ranked = F.transform(multi, lambda p, i: F.struct(area(p).alias("a"), (-i).alias("i"), p.alias("p")))
    return F.array_max(F.transform(ranked, lambda r: F.struct(r["a"].alias("a"), r["i"].alias("i"), r["p"].alias("p"))))["p"]


def most_vertices(multi: Column) -> Column:
    """The part with most vertices in its outer ring; of equals the first."""
    return F.array_max(F.transform(multi, lambda p, i: F.struct(F.size(p[0]).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]


def _on_edge(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def _all_edges(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, lambda r: edges(closed(r))))


def _bounded(es: Column, x: Column, y: Column) -> Column:
    return F.exists(es, lambda e: _on_edge(x, y, e))


def on_boundary(polygon: Column, x: Column, y: Column) -> Column:
    return _bounded(_all_edges(polygon), x, y)


def _odd_crossings(es: Column, x: Column, y: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(es, crosses)) % 2 == 1


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Is the point inside, boundary out? Holes count by the even-odd rule."""
    return let(_all_edges(polygon), lambda es: ~_bounded(es, x, y) & _odd_crossings(es, x, y))


def covers(polygon: Column, x: Column, y: Column) -> Column:
    """Is the point inside or on the boundary?"""
    return let(_all_edges(polygon), lambda es: _covers(es, x, y))


def _covers(es: Column, x: Column, y: Column) -> Column:
    return _bounded(es, x, y) | _odd_crossings(es, x, y)


# Upright rectangles, such as boxes and map tiles, against any polygon: a few comparisons for each of its edges


def is_rectangle(p: Column) -> Column:
    """Is the polygon one closed ring of four upright sides?"""
    r = p[0]
    same = lambda i, j, c: r[i][c] == r[j][c]
    across = same(0, 1, "y") & same(1, 2, "x") & same(2, 3, "y") & same(3, 0, "x")
    up = same(0, 1, "x") & same(1, 2, "y") & same(2, 3, "x") & same(3, 0, "y")
    shape = same(0, 4, "x") & same(0, 4, "y") & ~same(0, 2, "x") & ~same(0, 2, "y") & (across | up)
    return F.coalesce(F.when((F.size(p) == 1) & (F.size(r) == 5), shape), F.lit(False))


def _box(p: Column) -> Column:
    """Bounds of a rectangle, from two opposite corners."""
    a, c = p[0][0], p[0][2]
    return F.struct(F.least(a["x"], c["x"]).alias("x0"), F.least(a["y"], c["y"]).alias("y0"), F.greatest(a["x"], c["x"]).alias("x1"), F.greatest(a["y"], c["y"]).alias("y1"))


def _passes(box: Column, e: Column, border: bool) -> Column:
    """Does an edge have a place in the box, its border counted or not? It has none if all is on one side in x, in y, or of the edge's line."""
    a, b = e["a"], e["b"]
    le = (lambda u, v: u <= v) if border else (lambda u, v: u < v)
    spans = [le(F.least(a[c], b[c]), box[c + "1"]) & le(box[c + "0"], F.greatest(a[c], b[c])) for c in "xy"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    # the corners farthest to the right and to the left of the edge
    reach = lambda u0, u1, v0, v1: dx * (F.when(dx > 0, v0).otherwise(v1) - a["y"]) - dy * (F.when(dy > 0, u0).otherwise(u1) - a["x"])
    least = reach(box["x1"], box["x0"], box["y0"], box["y1"])
    most = reach(box["x0"], box["x1"], box["y1"], box["y0"])
    return spans[0] & spans[1] & le(least, 0.0) & le(F.lit(0.0), most)


def _rectangle_within(p: Column, q: Column) -> Column:
    """Is rectangle p within polygon q? No edge of q passes p's inside, and its middle is in q."""
    test = lambda box, es: ~F.exists(es, lambda e: _passes(box, e, False)) & _odd_crossings(es, (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2)
    return let(_all_edges(q), lambda es: let(_box(p), lambda box: test(box, es)))


def _rectangle_meets(p: Column, q: Column) -> Column:
    """Do rectangle p and polygon q share a place? An edge of q does with p, or all of p is in q."""
    return let(_all_edges(q), lambda es: let(_box(p), lambda box: F.exists(es, lambda e: _passes(box, e, True)) | _odd_crossings(es, box["x0"], box["y0"])))


def _side(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _touch(e: Column, f: Column) -> Column:
    apart = (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) > 0) | (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) > 0)
    boxes = (F.greatest(F.least(e["a"]["x"], e["b"]["x"]), F.least(f["a"]["x"], f["b"]["x"])) <= F.least(F.greatest(e["a"]["x"], e["b"]["x"]), F.greatest(f["a"]["x"], f["b"]["x"]))) & (
        F.greatest(F.least(e["a"]["y"], e["b"]["y"]), F.least(f["a"]["y"], f["b"]["y"])) <= F.least(F.greatest(e["a"]["y"], e["b"]["y"]), F.greatest(f["a"]["y"], f["b"]["y"]))
    )
    return boxes & ~apart


def intersects(p: Column, q: Column) -> Column:
    """Do two polygons share a point? Boxes first, then a vertex in the other, then crossing edges."""

    boxes = lambda bp: let(bounds(q), lambda bq: bounds_meet(bp, bq))
    inside = covers(q, p[0][0]["x"], p[0][0]["y"]) | covers(p, q[0][0]["x"], q[0][0]["y"])
    crossing = let(_all_edges(q), lambda eq: F.exists(_all_edges(p), lambda e: F.exists(eq, lambda f: _touch(e, f))))
    both = F.when(is_rectangle(p), _rectangle_meets(p, q)).when(is_rectangle(q), _rectangle_meets(q, p)).otherwise(inside | crossing)
    return F.when(let(bounds(p), boxes), both).otherwise(F.lit(False))


def bounds_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def bounds_within(a: Column, b: Column) -> Column:
    return (a["x0"] >= b["x0"]) & (a["x1"] <= b["x1"]) & (a["y0"] >= b["y0"]) & (a["y1"] <= b["y1"])


def _cuts(e: Column, f: Column) -> Column:
    """Places along edge e (0 to 1) at which edge f crosses it, touches it, or begins and ends to run along it."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    square = F.nullif(rx * rx + ry * ry, F.lit(0.0))
    along = lambda p: ((p["x"] - a["x"]) * rx + (p["y"] - a["y"]) * ry) / square
    turn = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    # a zero side says exactly that a corner lies on the line through an edge, where the quotient is rounded
    t = F.when(_side(c, d, a) == 0, 0.0).when(_side(c, d, b) == 0, 1.0).when(_side(a, b, c) == 0, along(c)).when(_side(a, b, d) == 0, along(d))
    t = t.otherwise(((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / turn)
    level = (_side(a, b, c) == 0) & (_side(a, b, d) == 0)
    return F.when(level, F.array(along(c), along(d))).otherwise(F.array(t))


def _runs_along(e: Column, t: Column, f: Column) -> Column:
    """Does edge f run along edge e over its place t?"""
    a, b = e["a"], e["b"]
    rx, ry = b["x"] - a["x"], b["y"] - a["y"]
    along = lambda p: ((p["x"] - a["x"]) * rx + (p["y"] - a["y"]) * ry) / F.nullif(rx * rx + ry * ry, F.lit(0.0))
    level = (_side(a, b, f["a"]) == 0) & (_side(a, b, f["b"]) == 0)
    return level & (F.least(along(f["a"]), along(f["b"])) <= t) & (t <= F.greatest(along(f["a"]), along(f["b"])))


def covered_by(p: Column, q: Column) -> Column:
    """Is no place of polygon p outside polygon q?

    p's edges are cut where q's meet them. Each piece must run along q's boundary or
    have its middle inside q. Then p can reach outside q only around a whole hole of q,
    so no hole's inside may lie in p. Polygons are valid; boxes are compared first.
    If p is an upright rectangle, less is to be looked at.
    """

    def edge_inside(e: Column, near: Column) -> Column:
        cuts = F.filter(F.flatten(F.transform(near, lambda f: F.when(_touch(e, f), _cuts(e, f)).otherwise(F.array().cast("array<double>")))), lambda t: (t > 0) & (t < 1))
        places = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))

        def pieces(t: Column) -> Column:
            middles = F.transform(F.slice(t, F.lit(1), F.size(t) - 1), lambda s, i: (s + F.element_at(t, i + 2)) / 2)
            at = lambda m: point(e["a"]["x"] + m * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + m * (e["b"]["y"] - e["a"]["y"]))
            return F.forall(middles, lambda m: let(at(m), lambda c: _covers(near, c["x"], c["y"])) | F.exists(near, lambda f: _runs_along(e, m, f)))

        return let(places, pieces)

    boundary = let(_all_edges(q), lambda near: F.forall(_all_edges(p), lambda e: edge_inside(e, near)))
    around = F.exists(F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(0))), lambda hole: let(inside_point(F.array(hole)), lambda c: contains(p, c["x"], c["y"])))
    boxes = let(bounds(p), lambda a: let(bounds(q), lambda b: bounds_within(a, b)))
    return F.when(boxes, F.when(is_rectangle(p), _rectangle_within(p, q)).otherwise(boundary & ~around)).otherwise(F.lit(False))


def self_crossing(polygon: Column) -> Column:
    """Do two edges meet that aren't neighbours in one ring? Holes that touch at a corner count too; a repair leaves them as they are."""

    def check(es: Column) -> Column:
        apart = lambda s, t: (t["r"] != s["r"]) | ((t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == s["n"] - 1)))
        return F.exists(es, lambda s: F.exists(es, lambda t: (t["r"] >= s["r"]) & apart(s, t) & _touch(s["e"], t["e"])))

    ring = lambda r, k: let(edges(without_repeats(closed(r))), lambda es: F.transform(es, lambda e, i: F.struct(k.alias("r"), i.alias("i"), F.size(es).alias("n"), e.alias("e"))))
    return let(F.flatten(F.transform(polygon, ring)), check)


def spiked(polygon: Column) -> Column:
    """Does a ring turn straight back at a corner?"""

    def turns(ring: Column) -> Column:
        n = F.size(ring)
        before = lambda i: F.element_at(ring, F.when(i == 0, n - 1).otherwise(i))  # noqa: E731  (the last point is the first again)
        back = lambda p, q, r: (_side(p, q, r) == 0) & ((q["x"] - p["x"]) * (r["x"] - q["x"]) + (q["y"] - p["y"]) * (r["y"] - q["y"]) < 0)
        return F.exists(F.transform(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda q, i: back(before(i), q, F.element_at(ring, i + 2))), lambda x: x)

    return F.exists(polygon, lambda r: let(without_repeats(closed(r)), turns))


def repaired(polygon: Column) -> Column:
    """Rings closed and without repeated points; null if fewer than four points are left, or if edges cross or run back (operators.planar repairs those)."""
    clean = F.filter(F.transform(polygon, lambda r: without_repeats(closed(r))), lambda r: F.size(r) >= 4)
    return let(clean, lambda c: F.when((F.size(c) > 0) & ~self_crossing(c) & ~spiked(c), c))


def line_to_polygon(line: Column) -> Column:
    return F.when(F.size(line) >= 3, F.array(closed(line)))


def disc(x: Column, y: Column, radius: float = 0.001, corners: int = 32) -> Column:
    angles = [2 * math.pi * k / corners for k in range(corners)]
    return F.array(F.array(*[point(x + radius * math.cos(a), y + radius * math.sin(a)) for a in [*angles, 0.0]]))


def inside_point(polygon: Column) -> Column:
    """A point surely inside: the middle of the widest stretch near half height, between the heights of vertices."""
    ys = F.transform(F.flatten(polygon), lambda p: p["y"])
    height = let(ys, lambda v: let((F.array_min(v) + F.array_max(v)) / 2, lambda m: (F.array_max(F.filter(v, lambda t: t <= m)) + F.array_min(F.filter(v, lambda t: t > m))) / 2))

    def at(y: Column) -> Column:
        cut = F.filter(_all_edges(polygon), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        xs = F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
        return let(xs, lambda v: point(_widest(v)["x"], y))

    return let(height, at)


def _widest(xs: Column) -> Column:
    """Width and middle of the widest of the stretches xs[0]..xs[1], xs[2]..xs[3], ..."""
    stretch = lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("w"), ((F.get(xs, 2 * k + 1) + F.get(xs, 2 * k)) / 2).alias("x"))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), stretch))


def locate(line: Column, x: Column, y: Column) -> Column:
    """Nearest point of a line: planar distance, fraction along the line, and its coordinates."""

    def near(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        sq = dx * dx + dy * dy
        t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(sq, F.lit(0.0))))).otherwise(F.lit(0.0))
        return let(t, lambda u: F.struct(F.sqrt(F.pow(x - a["x"] - u * dx, 2) + F.pow(y - a["y"] - u * dy, 2)).alias("d"), u.alias("t"), F.sqrt(sq).alias("len"), (a["x"] + u * dx).alias("x"), (a["y"] + u * dy).alias("y")))

    def place(hits: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0.0), lambda s, g: s + g["len"])
        placed = F.transform(hits, lambda h, i: F.struct(h["d"].alias("d"), i.alias("i"), (before(i) + h["t"] * h["len"]).alias("along"), h["x"].alias("x"), h["y"].alias("y")))
        total = F.aggregate(hits, F.lit(0.0), lambda s, g: s + g["len"])
        return let(F.array_min(placed), lambda best: F.struct(best["d"].alias("dist"), F.coalesce(best["along"] / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("frac"), best["x"].alias("x"), best["y"].alias("y")))

    return let(F.transform(edges(line), near), place)


def metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    f1, f2 = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# Transverse Mercator by Krüger's series (WGS 84), the flattening's powers up to the third
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm(x: Column, y: Column, zone: int, south: bool = True) -> Column:
    """Easting and northing in metres of a point in degrees."""
    lam, sin = F.radians(x - (zone * 6 - 183)), F.sin(F.radians(y))
    k = 2 * math.sqrt(_N) / (1 + _N)
    grid = lambda t: let(F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)).alias("eta")), lambda g: _series(g["xi"], g["eta"], south))
    return let(F.sinh(F.atanh(sin) - k * F.atanh(k * sin)), grid)


def _series(xi: Column, eta: Column, south: bool) -> Column:
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(F.lit(500000.0) + 0.9996 * _A * east, F.lit(10000000.0 if south else 0.0) + 0.9996 * _A * north)


def area_utm_m2(polygon: Column, zone: int) -> Column:
    """Planar area after projection, two decimals."""
    return F.round(area(F.transform(polygon, lambda r: F.transform(r, lambda p: utm(p["x"], p["y"], zone)))), 2)


def wkt(polygon: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(polygon, ring), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Rings of a POLYGON's text."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring(r: Column) -> Column:
        return F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: point(F.split(p, r"\s+")[0].try_cast("double"), F.split(p, r"\s+")[1].try_cast("double")))

    return F.transform(rings, ring)


_POSITIONS = "array<array<double>>"


def from_geojson(geometry: Column) -> Column:
    """A geometry's JSON text as polygons: array of polygons of rings; lines are closed, points become discs, other kinds null (lines_from_geojson reads several lines)."""
    coords = F.get_json_object(geometry, "$.coordinates")
    line = points(F.from_json(coords, _POSITIONS))
    spot = F.from_json(coords, "array<double>")

    # a text is parsed once, by the word for several at the depth of one or of several; what that can't read is looked at again
    several = F.contains(geometry, F.lit("Multi"))
    read = lambda text, kind: F.from_json(text, f"type string, coordinates {kind}")
    whole = F.struct(read(F.when(~several, geometry), f"array<{_POSITIONS}>").alias("one"), read(F.when(several, geometry), f"array<array<{_POSITIONS}>>").alias("many"))

    def kinds(d: Column) -> Column:
        kind = F.coalesce(d["one"]["type"], d["many"]["type"], F.get_json_object(geometry, "$.type"))
        rings = F.coalesce(d["one"]["coordinates"], F.from_json(coords, f"array<{_POSITIONS}>"))
        multi = F.coalesce(d["many"]["coordinates"], F.from_json(coords, f"array<array<{_POSITIONS}>>"))
        return (
            F.when(kind == "Polygon", F.array(F.transform(rings, points)))
            .when(kind == "MultiPolygon", F.transform(multi, lambda p: F.transform(p, points)))
            .when((kind == "LineString") & (F.size(line) >= 3), F.array(line_to_polygon(line)))
            .when(kind == "Point", let(spot, lambda s: F.array(disc(s[0], s[1]))))
        )

    return let(whole, kinds)


def lines_from_geojson(geometry: Column) -> Column:
    """The lines of a MultiLineString's JSON text; null for other kinds."""
    coords = F.get_json_object(geometry, "$.coordinates")
    return F.when(F.get_json_object(geometry, "$.type") == "MultiLineString", F.transform(F.from_json(coords, f"array<{_POSITIONS}>"), points))


def geojson(polygon: Column) -> Column:
    coords = F.transform(polygon, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def bbox_around(lat: Column, lng: Column, radius_m: Column) -> Column:
    """Box of a centre and radius, seven decimals."""
    dlat, dlng = radius_m / 111000, radius_m / (111000 * F.cos(F.radians(lat)))
    r = lambda c, n: F.round(c, 7).alias(n)
    return F.struct(r(lat - dlat, "south"), r(lng - dlng, "west"), r(lat + dlat, "north"), r(lng + dlng, "east"))


def bbox_wkt(south: Column, west: Column, north: Column, east: Column) -> Column:
    at = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", at(west, south), at(east, south), at(east, north), at(west, north), at(west, south)), F.lit("))"))


def in_bbox(lat: Column, lng: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def corners(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """A box from two opposite corners in any order."""
    return F.struct(F.least(lat1, lat2).alias("south"), F.least(lng1, lng2).alias("west"), F.greatest(lat1, lat2).alias("north"), F.greatest(lng1, lng2).alias("east"))
