import math
import random

from pyspark.sql import functions as F

from lotespark.functions import geometry as G
from lotespark.operators import clustering, grids, spatial
from lotespark.schemas import LINE, MULTIPOLYGON, POLYGON

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
HOLED = [*SQUARE, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]
TRIANGLE = [[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]]
BOW = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]]


def shapes(spark, *polygons):
    return spark.createDataFrame([(i, p) for i, p in enumerate(polygons)], f"id int, p {POLYGON}")


def test_area_and_centroid(spark):
    p = F.col("p")
    rows = shapes(spark, SQUARE, HOLED, TRIANGLE).select(G.area(p).alias("a"), G.centroid(p).alias("c"), G.vertex_mean(p[0]).alias("m"), G.bounds(p).alias("b")).collect()
    assert [r.a for r in rows] == [16.0, 15.0, 4.5]
    assert (rows[0].c.x, rows[0].c.y, rows[2].c.x, rows[2].c.y) == (2.0, 2.0, 1.0, 1.0)
    assert (rows[0].m.x, rows[0].b.x1) == (1.6, 4.0)


def test_turned_ring_has_the_same_area(spark):
    ring = SQUARE[0][:-1]
    turned = [[*ring[k:], *ring[:k]] for k in range(4)]
    assert {r.a for r in shapes(spark, *[[t] for t in turned]).select(G.area(F.col("p")).alias("a")).collect()} == {16.0}


def test_point_in_polygon(spark):
    p = F.col("p")
    at = lambda x, y: (G.covers(p, F.lit(x), F.lit(y)).alias("in"), G.contains(p, F.lit(x), F.lit(y)).alias("strict"))
    holed = shapes(spark, HOLED)
    assert [tuple(holed.select(*at(x, y)).first()) for x, y in ((3.0, 3.0), (1.5, 1.5), (0.0, 2.0), (4.0, 4.0), (5.0, 1.0))] == [(True, True), (False, False), (True, False), (True, False), (False, False)]


def test_polygons_meet(spark):
    far = [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]]
    inner = [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]]
    cross = [[(-1.0, 1.0), (5.0, 1.0), (5.0, 2.0), (-1.0, 2.0)]]
    touch = [[(4.0, 4.0), (6.0, 4.0), (6.0, 6.0)]]
    df = spark.createDataFrame([(SQUARE, q) for q in (far, inner, cross, touch)], f"p {POLYGON}, q {POLYGON}")
    assert [r[0] for r in df.select(G.intersects(F.col("p"), F.col("q"))).collect()] == [False, True, True, True]


def test_repair(spark):
    rows = shapes(spark, SQUARE, BOW, [[(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]], TRIANGLE).select(G.repaired(F.col("p")).alias("r")).collect()
    assert [r.r is not None for r in rows] == [True, False, False, True]
    assert len(rows[3].r[0]) == 4


def test_parts_lines_and_text(spark):
    multi = spark.createDataFrame([([TRIANGLE, SQUARE],)], f"m {MULTIPOLYGON}")
    assert multi.select(G.area(G.largest(F.col("m")))).first()[0] == 16.0
    line = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)],)], f"l {LINE}")
    got = line.select(G.locate(F.col("l"), F.lit(3.0), F.lit(1.0)).alias("n"), G.middle_vertex(F.col("l")).alias("m")).first()
    assert (got.n.dist, got.n.frac, got.n.x, got.n.y, got.m.x) == (1.0, 0.75, 2.0, 1.0, 2.0)
    back = shapes(spark, HOLED).select(G.from_wkt(G.wkt(F.col("p"))).alias("q"), G.from_geojson(G.geojson(F.col("p"))).alias("g")).first()
    assert [[tuple(v) for v in r] for r in back.q] == HOLED and [[tuple(v) for v in r] for r in back.g[0]] == HOLED
    inside = shapes(spark, HOLED, TRIANGLE).select("p", G.inside_point(F.col("p")).alias("s")).select(G.contains(F.col("p"), F.col("s.x"), F.col("s.y"))).collect()
    assert all(r[0] for r in inside)


def test_projected_area(spark):
    lat, lng, side = -24.8, -65.4, 0.001
    ring = [[(lng, lat), (lng + side, lat), (lng + side, lat + side), (lng, lat + side), (lng, lat)]]
    got = shapes(spark, ring).select(G.area_utm_m2(F.col("p"), 20).alias("u"), G.area_degrees_m2(F.col("p")).alias("d")).first()
    e2 = 2 / 298.257223563 - (1 / 298.257223563) ** 2
    s = math.sin(math.radians(lat + side / 2))
    true = math.radians(side) ** 2 * 6378137.0**2 * (1 - e2) / (1 - e2 * s * s) ** 2 * math.cos(math.radians(lat + side / 2))
    assert abs(got.u / true - 1) < 1e-3 and got.d > got.u
    p = spark.range(1).select(G.utm(F.lit(-63.0), F.lit(0.0), 20).alias("p")).first().p
    assert abs(p.x - 500000) < 1e-6 and abs(p.y - 10000000) < 1e-6


def test_points_meet_polygons_by_cells(spark):
    P = spark.createDataFrame([(0, 1.0, 1.0)], "pid int, x double, y double")
    plan = spatial.point_in_polygon(P, shapes(spark, SQUARE).withColumnRenamed("p", "poly"), "x", "y", "poly", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spatial_join_ops(spark):
    inner = [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]]
    a = spark.createDataFrame([(1, inner), (2, SQUARE)], f"a int, pa {POLYGON}")
    b = spark.createDataFrame([(7, SQUARE)], f"b int, pb {POLYGON}")
    ops = {op: {r.a for r in spatial.spatial_join(a, b, op, "pa", "pb", 1.5, "a", "b").collect()} for op in ("intersects", "within", "contains")}
    assert ops == {"intersects": {1, 2}, "within": {1, 2}, "contains": {2}}
    assert spatial.in_zone(a, b.select(F.col("pb").alias("zone")), "a", "pa", size=1.5).count() == 2


def test_fuzzy_leaders_follow_the_feed(spark):
    rng = random.Random(9)
    rows = [(i, 1, rng.uniform(0, 4e-4), rng.uniform(0, 4e-4)) for i in range(120)]
    got = {r.i: r.leader for r in clustering.leaders(spark.createDataFrame(rows, "i int, g int, lat double, lng double"), "i", "i", ["g"]).collect()}
    want, chosen = {}, []
    for i, _, lat, lng in rows:
        near = [((lng - x) ** 2 + (lat - y) ** 2, k) for k, y, x in chosen if abs(lng - x) < 5e-5 and abs(lat - y) < 5e-5]
        want[i] = min(near)[1] if near else i
        if not near:
            chosen.append((i, lat, lng))
    assert got == want


def test_fuzzy_leaders_of_long_rows_and_full_spots(spark):
    rng = random.Random(10)
    spots = [(k, 0.0, k * 4e-5) for k in range(60)]  # a row of touching cells
    rng.shuffle(spots)
    more = [(0, lat + rng.uniform(-2e-5, 2e-5), lng) for _, lat, lng in spots] + [(0, lat, lng) for _, lat, lng in spots * 3] + [(0, 0.01, 0.01)] * 300
    # the second row on a spot finds a nearer leader than the first did
    more += [(0, 1.0, 1.0), (0, 1.0, 1.0 + 45e-6), (0, 1.0, 1.0 + 55e-6), (0, 1.0, 1.0 + 45e-6)]
    rows = [(i, 1, lat, lng) for i, (_, lat, lng) in enumerate(spots + more)]
    df = clustering.leaders(spark.createDataFrame(rows, "i int, g int, lat double, lng double"), "i", "i", ["g"])
    got = {r.i: r.leader for r in df.collect()}
    want, chosen = {}, []
    for i, _, lat, lng in rows:
        near = [((lng - x) ** 2 + (lat - y) ** 2, k) for k, y, x in chosen if abs(lng - x) < 5e-5 and abs(lat - y) < 5e-5]
        want[i] = min(near)[1] if near else i
        if not near:
            chosen.append((i, lat, lng))
    assert got == want and want[len(rows) - 1] == len(rows) - 2 != want[len(rows) - 3]
    assert "InPandas" not in df._jdf.queryExecution().toString()


def test_grids(spark):
    assert grids.grid_cells(spark, 0.0, 0.0, 1.0, 1.0, 0.5).count() == 4
    assert grids.grid_cells(spark, 0.0, 0.0, 1.0, 1.0, 0.5, 2).count() == 13
    assert grids.plain_grid(spark, 0.0, 0.0, 1.0, 1.0, 0.5).count() == 9
    assert spark.range(1).select(grids.tile_key(F.lit(41.0), F.lit(-87.65), 3)).first()[0] == "030"
    cities = spark.createDataFrame([(0, "a", 0.0, 0.0, 2.0, 2.0), (1, "b", 1.0, 1.0, 3.0, 3.0)], "ord int, slug string, south double, west double, north double, east double")
    at = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.5, 2.5), (3, 9.0, 9.0)], "id int, lat double, lng double")
    assert {r.id: r.slug for r in spatial.route(at, cities, "id", "lat", "lng").collect()} == {1: "a", 2: "b", 3: None}


def test_rectangles_by_their_bounds(spark):
    """Rectangles (also turned the other way round) give what the same shapes with a corner more on a side give, which are compared edge by edge."""
    shapes = [
        [[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]],
        [[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]],
        [[(0, 0), (6, 0), (0, 6), (0, 0)]],
        [[(3, -1), (7, 3), (3, 7), (-1, 3), (3, -1)], [(3, 2), (2, 3), (3, 4), (4, 3), (3, 2)]],
    ]
    many = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in s]) for k, s in enumerate(shapes)], "k int, q array<array<struct<x:double,y:double>>>")
    box = lambda a, b, w, h: [(a, b), (a + w, b), (a + w, b + h), (a, b + h), (a, b)]
    rows = []
    for a in (-1.5, 0, 1, 2, 2.5, 3, 5, 7):
        for b in (-1, 0, 1.5, 2, 4):
            for w, h in ((1, 1), (2, 2), (0.5, 3), (9, 9)):
                ring = box(a, b, w, h)
                rows += [[r, [r[0], ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2), *r[1:]]] for r in (ring, ring[::-1])]
    at = lambda r: [[{"x": float(x), "y": float(y)} for x, y in r]]
    pairs = spark.createDataFrame([(at(r), at(more)) for r, more in rows], "p array<array<struct<x:double,y:double>>>, more array<array<struct<x:double,y:double>>>").crossJoin(many)
    p, more, q = F.col("p"), F.col("more"), F.col("q")
    got = pairs.select(
        G.is_rectangle(p).alias("is"), (~G.is_rectangle(more)).alias("isnt"), G.covered_by(p, q).alias("a"), G.covered_by(more, q).alias("b"), G.intersects(p, q).alias("c"), G.intersects(q, p).alias("d"), G.intersects(more, q).alias("e"), "p", "k",
    ).collect()
    assert all(r["is"] and r.isnt for r in got)
    assert [r for r in got if r.a != r.b or not r.c == r.d == r.e] == []
    assert {(r.a, r.c) for r in got} == {(True, True), (False, True), (False, False)}


def test_routing_shuffles_no_points(spark):
    """Points in one cell stay in their partitions; the first box in the catalogue's order counts."""
    cities = spark.createDataFrame([(1, "b", 0.0, 0.0, 3.0, 3.0), (0, "a", 1.0, 1.0, 2.0, 2.0)], "ord int, slug string, south double, west double, north double, east double")
    at = spark.createDataFrame([(1, 1.5, 1.5), (2, 1.1, 2.1), (3, 9.0, 9.0), (4, None, 1.0)], "id int, lat double, lng double")
    got = spatial.route(at, cities, "id", "lat", "lng")
    assert sorted((r.id, r.slug) for r in got.collect()) == [(1, "a"), (2, "b"), (3, None), (4, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan")[0]
    assert "BroadcastHashJoin" in final and final.count("hashpartitioning") == 1 and "SortMergeJoin" not in final  # the catalogue is grouped by cell


def test_tiles_are_spread(spark):
    """A zone table of one partition doesn't keep the levels of its cover in one task."""
    zone = spark.range(40).coalesce(1).select("id", G.rectangle(F.col("id") * 0.1, F.lit(0.0), F.col("id") * 0.1 + 0.09, F.lit(0.09)).alias("zone"))
    cover = grids.tile_cover(zone, "id", "zone", 9, 11)
    assert len({f.rsplit("/part-")[1][:5] for f in cover.inputFiles()}) > 1
