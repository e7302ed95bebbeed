"""Planar graphs of polygons and lines as tables: repair, polygonizing and union.

Edges are rows, keyed by the geometry (or the group of geometries) they belong to.
`noded` splits them where they meet, by a join on grid cells that are sized to each
geometry's count of edges. `walked` follows the faces: a window over a node's edges by
their angle gives each half-edge the one that follows it with the face on its left, and
pointer doubling labels each closed walk by its least half-edge and gives every
half-edge its place in it, in as many joins as the logarithm of the longest walk. What
is left of an edge is inside or outside by the number of edges above its middle.
`polygons` puts walks together: those against the clock are shells, those with it holes
of the least shell around them.

* `repair`: even-odd area of rings that cross, overlap or run back on themselves.
* `polygonize`: the areas that lines enclose, without dangles and bridges.
* `union`: the area that at least one polygon of a group covers, inner borders dissolved.

Coordinates are rounded to DIGITS decimals, the grid on which places count as equal.
Rows whose geometry has no area give no row. Results are arrays of polygons, in order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..runtime import forget, ready, stored, temporary
from . import planar_rows

DIGITS = 9
POLYGON = "array<array<struct<x:double,y:double>>>"
#: A vertex this near to an edge lies on it: less than the grid's step.
NEAR = 0.7 * 10.0**-DIGITS


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join by edges, walks or cells: it isn't broadcast, which would send it through the driver at each step. Only extents may be, a small row per geometry."""
    return df.hint("merge")


def _snapped(p: Column, digits: int) -> Column:
    """A node: place on the grid. Nodes with a tag of their own meet nothing else."""
    return F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y"), F.lit(-1).cast("long").alias("tag"))


def ring_edges(df: DataFrame, key: str, part: str, rings: Column, digits: int = DIGITS) -> DataFrame:
    """(g, part, a, b): the edges of all rings, on the grid, the lesser end first."""
    ring = df.select(F.col(key).alias("g"), F.col(part).alias("part"), F.explode(rings).alias("ring"))
    edge = ring.select("g", "part", F.explode(G.edges(G.closed(F.col("ring")))).alias("e")).select("g", "part", _snapped(F.col("e.a"), digits).alias("p"), _snapped(F.col("e.b"), digits).alias("q"))
    return edge.where("p != q").select("g", "part", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


# Noding


def _extent(edges: DataFrame) -> DataFrame:
    """Per geometry the corner and the side of its cells: about as many cells in a row as the root of its edges."""
    low, high = (lambda c: F.min(F.least(f"a.{c}", f"b.{c}"))), lambda c: F.max(F.greatest(f"a.{c}", f"b.{c}"))
    e = edges.groupBy("g").agg(F.count("*").alias("n"), low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.ceil(F.sqrt("n"))
    return e.select("g", "x0", "y0", F.when(side > 0, side).otherwise(1.0).alias("side"))


def _strips(low: Column, high: Column, origin: Column, side: Column) -> Column:
    return F.sequence(F.floor((low - origin) / side), F.floor((high - origin) / side))


def _celled(edges: DataFrame, extent: DataFrame) -> DataFrame:
    """Edges once for each cell that they pass, column by column."""
    e = edges.select("g", F.struct("a", "b").alias("e")).distinct().join(extent, "g")
    a, b = F.col("e.a"), F.col("e.b")
    e = e.withColumn("cx", F.explode(_strips(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]), F.col("x0"), F.col("side"))))
    left, right = F.col("x0") + F.col("cx") * F.col("side"), F.col("x0") + (F.col("cx") + 1) * F.col("side")
    at = lambda x: a["y"] + (F.greatest(a["x"], F.least(b["x"], x)) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])  # noqa: E731  (a.x <= b.x)
    low, high = F.least(at(left), at(right)), F.greatest(at(left), at(right))
    steep = a["x"] == b["x"]
    slack = F.col("side") * 1e-6
    low, high = F.when(steep, F.least(a["y"], b["y"])).otherwise(low) - slack, F.when(steep, F.greatest(a["y"], b["y"])).otherwise(high) + slack
    return e.withColumn("cy", F.explode(_strips(low, high, F.col("y0"), F.col("side")))).select("g", "cx", "cy", "e")


def _along(p: Column, a: Column, b: Column) -> Column:
    """Place of p along a-b, 0 at a and 1 at b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy)


def _on(p: Column, a: Column, b: Column) -> Column:
    """Does p lie on a-b, between its ends?"""
    dx, dy, px, py = b["x"] - a["x"], b["y"] - a["y"], p["x"] - a["x"], p["y"] - a["y"]
    along, across, square = px * dx + py * dy, px * dy - py * dx, dx * dx + dy * dy
    return (p != a) & (p != b) & (along > 0) & (across * across <= NEAR * NEAR * square) & (along < square)


def _meetings(e: Column, f: Column, digits: int) -> Column:
    """struct(e, p): the places at which edges e and f are to be split."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    ends = F.filter(F.array(*(F.struct(x.alias("e"), p.alias("p"), _on(p, x["a"], x["b"]).alias("on")) for x, p in ((e, c), (e, d), (f, a), (f, b)))), lambda s: s["on"])
    ends = F.transform(ends, lambda s: F.struct(s["e"].alias("e"), s["p"].alias("p")))
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    turn = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / turn, ((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx) / turn
    cross = _snapped(F.struct((a["x"] + t * rx).alias("x"), (a["y"] + t * ry).alias("y")), digits)
    both = F.array(F.struct(e.alias("e"), cross.alias("p")), F.struct(f.alias("e"), cross.alias("p")))
    apart = (a != c) & (a != d) & (b != c) & (b != d)
    return G.let(ends, lambda on: F.when(F.size(on) > 0, on).when(apart & (t > 0) & (t < 1) & (u > 0) & (u < 1), both))


def _split(a: Column, b: Column, cuts: Column) -> Column:
    """struct(a, b): the pieces of the edge a-b between the places in cuts, the lesser end first."""
    places = F.array_union(F.array(a, b), cuts)
    ordered = F.transform(F.sort_array(F.transform(places, lambda p: F.struct(_along(p, a, b).alias("t"), p.alias("p")))), lambda s: s["p"])
    piece = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    several = G.let(ordered, lambda o: F.transform(F.slice(o, F.lit(1), F.size(o) - 1), lambda p, i: piece(p, F.element_at(o, i + 2))))
    return F.when(F.size(cuts) > 0, several).otherwise(F.array(F.struct(a.alias("a"), b.alias("b"))))


def noded(edges: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(g, part, a, b): the edges split where edges of one geometry meet, without pieces that a part runs along an even number of times."""
    cells = _celled(edges, stored(_extent(edges), "extent"))
    low = lambda e, c: F.least(f"{e}.a.{c}", f"{e}.b.{c}")
    high = lambda e, c: F.greatest(f"{e}.a.{c}", f"{e}.b.{c}")
    boxes = [(low("e", c) <= high("f", c) + NEAR) & (low("f", c) <= high("e", c) + NEAR) for c in "xy"]
    pairs = cells.join(_shuffled(cells.withColumnRenamed("e", "f")), ["g", "cx", "cy"]).where((F.col("e") < F.col("f")) & boxes[0] & boxes[1])
    cuts = pairs.select("g", F.explode(_meetings(F.col("e"), F.col("f"), digits)).alias("m")).groupBy("g", F.col("m.e.a").alias("a"), F.col("m.e.b").alias("b")).agg(F.collect_set("m.p").alias("cuts"))
    split = edges.join(_shuffled(cuts), ["g", "a", "b"], "left")
    places = F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double,tag:bigint>>"))
    pieces = split.select("g", "part", F.explode(_split(F.col("a"), F.col("b"), places)).alias("e")).select("g", "part", "e.*")
    return pieces.groupBy("g", "part", "a", "b").agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")


# Walks


def numbered(pieces: DataFrame) -> DataFrame:
    """(g, a, b, id) of the different pieces, written so that ids stay."""
    return stored(pieces.select("g", "a", "b").distinct().withColumn("id", F.monotonically_increasing_id()), "pieces")


def walked(pieces: DataFrame) -> DataFrame:
    """(g, h, u, v, walk, ahead) of both half-edges of each piece (2 id and 2 id + 1): the least half-edge of its walk, and how many steps ahead it is."""
    way = lambda h, u, v: F.struct((F.col("id") * 2 + h).alias("h"), F.col(u).alias("u"), F.col(v).alias("v"))
    halves = pieces.select("g", F.explode(F.array(way(0, "a", "b"), way(1, "b", "a"))).alias("e")).select("g", "e.*")
    around = Window.partitionBy("g", "u").orderBy(F.atan2(F.col("v.y") - F.col("u.y"), F.col("v.x") - F.col("u.x")), "h")
    last = F.last("h").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # who comes in along the twin of h goes on along the edge before h, against the clock
    follow = halves.select(F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h"), F.coalesce(F.lag("h").over(around), last).alias("jump"))
    now, step = stored(follow.select("h", "jump", F.col("h").alias("walk"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("moved")), "walks"), 1
    while not now.where("moved").isEmpty():
        there = now.select(F.col("h").alias("jump"), F.col("jump").alias("jump2"), F.col("walk").alias("walk2"), F.col("ahead").alias("ahead2"))
        less = F.col("walk2") < F.col("walk")
        nxt = now.join(_shuffled(there), "jump").select("h", F.col("jump2").alias("jump"), F.least("walk", "walk2").alias("walk"), F.when(less, F.col("ahead2") + step).otherwise(F.col("ahead")).alias("ahead"), less.alias("moved"))
        nxt = stored(nxt, "walks")
        forget(now)
        now, step = nxt, step * 2
    return stored(halves.join(_shuffled(now.select("h", "walk", "ahead")), "h"), "faces")


def _middle() -> Column:
    """A walk's half-edge that runs farthest in x: its number, middle, and whether what is left of it is below."""
    u, v = F.col("u"), F.col("v")
    here = F.struct("h", ((u["x"] + v["x"]) / 2).alias("x"), ((u["y"] + v["y"]) / 2).alias("y"), (v["x"] < u["x"]).alias("below"))
    return F.max_by(here, F.struct(F.abs(v["x"] - u["x"]), "h"))


def _rings(walks: DataFrame, *more: Column) -> DataFrame:
    """(g, walk, ring, area, at) per walk: its points in order, signed area, and a half-edge to judge it by."""
    place = F.when(F.col("ahead") == 0, F.lit(-1 << 62)).otherwise(-F.col("ahead"))
    points = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), F.col("u").alias("u")))), lambda s: F.struct(s["u"]["x"].alias("x"), s["u"]["y"].alias("y")))
    local = F.transform("ring", lambda p: F.struct((p["x"] - F.col("ring")[0]["x"]).alias("x"), (p["y"] - F.col("ring")[0]["y"]).alias("y")))
    return walks.groupBy("g", "walk").agg(points.alias("ring"), _middle().alias("at"), *more).withColumn("area", G.ring_area(local))


def _odd_above(rings: DataFrame, edges: DataFrame, extent: DataFrame, label: str) -> DataFrame:
    """(g, walk, label): the walks whose left side has an odd number of the label's edges above it. edges: g, id, a, b, label. Both meet in strips of x."""
    reps = rings.select("g", "walk", "at").join(extent, "g").withColumn("strip", F.floor((F.col("at.x") - F.col("x0")) / F.col("side"))).select("g", "walk", "at", "strip")
    low, high = F.least("a.x", "b.x"), F.greatest("a.x", "b.x")
    lines = edges.where("a.x != b.x").join(extent, "g").withColumn("strip", F.explode(_strips(low, high, F.col("x0"), F.col("side")))).select("g", "strip", "id", "a", "b", F.col(label).alias("label"))
    x, y = F.col("at.x"), F.col("at.y")
    height = F.col("a.y") + (x - F.col("a.x")) * (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    own = F.shiftright(F.col("at.h"), 1) == F.col("id")
    above = F.when(own, F.col("at.below")).otherwise(height > y) & (low <= x) & (x < high)
    met = reps.join(_shuffled(lines), ["g", "strip"]).where(above)
    return met.groupBy("g", "walk", "label").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("g", "walk", "label")


# Polygons from walks


def loops(ring: Column) -> Column:
    """The ring cut at places that it passes twice, so that no loop touches itself."""

    def state(path: Column, done: Column) -> Column:
        return F.struct(path.alias("path"), done.alias("done"))

    def step(s: Column, p: Column) -> Column:
        at = F.array_position(s["path"], p).cast("int")
        cut = state(F.slice(s["path"], F.lit(1), at), F.concat(s["done"], F.array(F.slice(s["path"], at, F.size(s["path"]) - at + 1))))
        return F.when(at > 0, cut).otherwise(state(F.concat(s["path"], F.array(p)), s["done"]))

    kind = "array<struct<x:double,y:double>>"
    whole = F.aggregate(ring, state(F.array().cast(kind), F.array().cast(f"array<{kind}>")), step, lambda s: F.concat(s["done"], F.array(s["path"])))
    return F.when(F.size(F.array_distinct(ring)) == F.size(ring), F.array(ring)).otherwise(whole)


def _closed(many: Column) -> Column:
    return F.transform(many, lambda r: F.concat(r, F.array(r[0])))


def _polygon(loops_: Column, holes: Column) -> Column:
    """A shell's loops and its holes as a polygon: those of the loops that run with the clock are holes too."""
    outer, own = F.filter(loops_, lambda r: G.ring_area(r) > 0), F.filter(loops_, lambda r: G.ring_area(r) <= 0)
    return F.concat(outer, F.array_sort(F.concat(own, holes)))


def polygons(walks: DataFrame, extent: DataFrame) -> DataFrame:
    """(g, polygons) from the walks around covered faces: walks has g, h, u, v, walk, ahead and covered."""
    rings = stored(_rings(walks, F.max("covered").alias("covered")).where("covered AND area != 0"), "rings")
    shells, inner = rings.where("area > 0"), rings.where("area < 0")
    edges = walks.join(_shuffled(shells.select(F.col("walk"), F.col("area").alias("size"))), "walk").select("g", F.shiftright("h", 1).alias("id"), F.col("u").alias("a"), F.col("v").alias("b"), F.struct("size", "walk").alias("shell"))
    home = _odd_above(inner, edges, extent, "shell").groupBy("g", "walk").agg(F.min("label")["walk"].alias("shell"))
    shape = shells.select("g", F.col("walk").alias("shell"), _closed(loops(F.col("ring"))).alias("r"))
    holes = inner.join(_shuffled(home), ["g", "walk"]).select("g", "shell", F.explode(_closed(loops(F.col("ring")))).alias("r"))
    holes = holes.groupBy("g", "shell").agg(F.array_sort(F.collect_list("r")).alias("more"))
    whole = _polygon(F.col("r"), F.coalesce("more", F.array().cast("array<array<struct<x:double,y:double>>>")))
    return shape.join(_shuffled(holes), ["g", "shell"], "left").select("g", whole.alias("p")).groupBy("g").agg(F.array_sort(F.collect_list("p")).alias("polygons"))


def _covered(parts: DataFrame) -> DataFrame:
    """(g, polygons): what at least one part covers, each by the even-odd rule. parts: noded g, part, a, b."""
    parts = stored(parts, "noded")
    extent = stored(_extent(parts), "extent")
    pieces = numbered(parts)
    walks = walked(pieces)
    inside = _odd_above(_rings(walks), parts.join(_shuffled(pieces), ["g", "a", "b"]), extent, "part").select("walk").distinct().withColumn("covered", F.lit(True))
    sides = stored(walks.join(_shuffled(inside), "walk", "left").select("h", F.coalesce("covered", F.lit(False)).alias("covered")), "sides")
    twins = sides.select(F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h"), F.col("covered").alias("other"))
    border = sides.join(_shuffled(twins), "h").where("covered != other").select(F.shiftright("h", 1).alias("id")).distinct()
    kept = stored(pieces.join(_shuffled(border), "id", "left_semi"), "border")
    again = walked(kept).join(_shuffled(sides), "h")
    return polygons(again, extent)


def union(df: DataFrame, by: str, part: str, multi: str, digits: int = DIGITS) -> DataFrame:
    """(by, polygons): what the groups' multipolygons (arrays of polygons) cover; `part` tells the rows of a group apart."""
    with temporary():
        whole = stored(ring_edges(df, by, part, F.flatten(F.col(multi)), digits), "edges")
        out = _covered(noded(whole, digits)).withColumnRenamed("g", by)
        return stored(out, "areas", keep=True)


def repair(df: DataFrame, key: str, multi: str, digits: int = DIGITS) -> DataFrame:
    """(key, polygons): the even-odd area of each row's rings, as valid polygons."""
    return union(df.select(key, multi, F.lit(0).alias("_part")), key, "_part", multi, digits)


def repaired(df: DataFrame, multi: str, name: str, digits: int = DIGITS) -> DataFrame:
    """df and `name`: the polygons that `repair` gives, made in the row itself, for shapes of few corners (planar_rows). Nothing is written or shuffled; the work grows with the square of corners and crossings. Null if nothing has an area."""
    return _in_rows(df, multi, name, f"array<{POLYGON}>", partial(planar_rows.repaired, digits=digits))


def largest_valid(df: DataFrame, multi: str, name: str, digits: int = DIGITS) -> DataFrame:
    """df and `name`, struct(polygon, x, y): the largest of the row's polygons, which are repaired as a whole first if one isn't sound (geometry.repaired), and its centroid; in the row itself as `repaired`."""
    return _in_rows(df, multi, name, f"polygon {POLYGON}, x double, y double", partial(planar_rows.largest_valid, digits=digits))


def _in_rows(df: DataFrame, multi: str, name: str, kind: str, work: Callable[[pa.Array], pa.Array]) -> DataFrame:
    def column(shapes: pa.Array) -> pa.Array:
        return work(shapes)

    return ready(df).withColumn(name, F.arrow_udf(column, kind)(F.col(multi)))


def polygonize(df: DataFrame, key: str, lines: str, everywhere: bool = False, digits: int = DIGITS) -> DataFrame:
    """(key, polygons): the faces of each row's lines (an array of lines). Lines join at their ends only, or `everywhere` that they meet.

    Dangles and bridges have the same face on both sides; without them the faces are walked again.
    """
    with temporary():
        line = df.select(F.col(key).alias("g"), F.posexplode(lines).alias("n", "line"))
        last = F.size("line") - 2
        edge = line.select("g", "n", last.alias("last"), F.posexplode(G.edges(F.col("line"))).alias("k", "e"))
        tag = lambda k, end: F.lit(-1).cast("long") if everywhere else F.when(end, F.lit(-1).cast("long")).otherwise(F.col("n").cast("long") * (1 << 32) + k)
        node = lambda p, k, end: F.struct(_snapped(p, digits)["x"].alias("x"), _snapped(p, digits)["y"].alias("y"), tag(k, end).alias("tag"))
        edge = edge.select("g", node(F.col("e.a"), F.col("k"), F.col("k") == 0).alias("p"), node(F.col("e.b"), F.col("k") + 1, F.col("k") == F.col("last")).alias("q"))
        edges = stored(edge.where("p != q").select("g", F.lit(0).alias("part"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        pieces = numbered(noded(edges, digits) if everywhere else edges)
        walks = walked(pieces)
        twins = walks.select(F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h"), F.col("walk").alias("other"))
        two = walks.select("h", "walk").join(_shuffled(twins), "h").where("walk != other").select(F.shiftright("h", 1).alias("id")).distinct()
        kept = stored(pieces.join(_shuffled(two), "id", "left_semi"), "cycles")
        return stored(polygons(walked(kept).withColumn("covered", F.lit(True)), stored(_extent(kept), "extent")).withColumnRenamed("g", key), "areas", keep=True)
