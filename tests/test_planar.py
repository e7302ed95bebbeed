"""Repair, polygonizing, union and relations of polygons, held against plain even-odd arithmetic."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lotespark.functions import geometry as G
from lotespark.operators import planar, spatial

P = "array<array<struct<x:double,y:double>>>"


def pts(ring):
    return [(float(x), float(y)) for x, y in ring]


def plain_area(groups):
    """Area covered by any of the groups of rings, each by the even-odd rule: slabs between all heights of vertices and crossings, exact."""
    edges = []
    for k, rings in enumerate(groups):
        for ring in rings:
            ring = [tuple(map(Fraction, p)) for p in ring]
            edges += [(k, a, b) for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    ys = {p[1] for _, a, b in edges for p in (a, b)}
    for (_, a, b), (_, c, d) in itertools.combinations(edges, 2):
        rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
        den = rx * sy - ry * sx
        if den:
            t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / den
            ys.add(a[1] + t * ry)
    ys, total = sorted(ys), Fraction(0)
    for y0, y1 in zip(ys, ys[1:]):
        mid, cuts = (y0 + y1) / 2, []
        for k, a, b in edges:
            if min(a[1], b[1]) < mid < max(a[1], b[1]):
                cuts.append((a[0] + (mid - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), k))
        cuts.sort()
        odd, start = set(), None
        for x, k in cuts:
            was = bool(odd)
            odd ^= {k}
            if odd and not was:
                start = x
            if was and not odd:
                total += (x - start) * (y1 - y0)
    return float(total)


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def check_valid(polys):
    """Closed simple rings, shells against the clock, holes with it."""
    for poly in polys:
        for k, ring in enumerate(poly):
            assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 >= 3
            assert (signed(ring) > 0) == (k == 0)


def area(polys):
    return sum(signed(r) for poly in polys for r in poly)


def shapes(df):
    return {r[0]: [[[(p.x, p.y) for p in ring] for ring in poly] for poly in r.polygons] for r in df.collect()}


def frame(spark, rows, kind=f"array<{P}>", more=""):
    return spark.createDataFrame(rows, f"k long, {more}p {kind}").repartition(3)


KNOWN = {
    1: ([[(0, 0), (2, 2), (2, 0), (0, 2)]], 2.0, [1, 1]),  # bow tie
    2: ([[(0, 0), (4, 0), (4, 4), (6, 6), (4, 4), (0, 4)]], 16.0, [1]),  # spike
    3: ([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]], 12.0, [2]),  # a loop within, walked the same way round
    4: ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]], 15.0, [2]),  # valid, a hole
    5: ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 1), (1, 2)]], 14.5, [2]),  # a hole that touches the shell
    6: ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (6, 1), (6, 3), (3, 3)]], 18.0, [1, 1]),  # a hole over the shell's edge
    7: ([[(0, 0), (5, 0)]], 0.0, None),  # no area
    8: ([[(0, 0), (3, 0), (3, 0), (3, 3), (0, 3), (0, 0)]], 9.0, [1]),
    9: ([[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (1, 8)], [(2, 2), (7, 2), (7, 7), (2, 7)], [(3, 3), (4, 3), (4, 4), (3, 4)]], 56.0, [2, 2]),  # an island with a hole in a hole
}


def test_repair_of_known_shapes(spark):
    got = shapes(planar.repair(frame(spark, [(k, [[pts(r) for r in v[0]]]) for k, v in KNOWN.items()] + [(10, None), (11, []), (12, [[]])]), "k", "p"))
    assert set(got) == {k for k, v in KNOWN.items() if v[2]}
    for k, polys in got.items():
        check_valid(polys)
        assert area(polys) == pytest.approx(KNOWN[k][1]) and sorted(map(len, polys)) == KNOWN[k][2], k


def test_repair_of_random_rings(spark):
    rng = random.Random(1)
    rows = {}
    for k in range(40):
        side = rng.choice([4, 8, 1000])
        rows[k] = [[(rng.randint(0, side), rng.randint(0, side)) for _ in range(rng.randint(3, 14))] for _ in range(rng.randint(1, 3))]
    got = shapes(planar.repair(frame(spark, [(k, [[pts(r) for r in v]]) for k, v in rows.items()]), "k", "p"))
    for k, rings in rows.items():
        want = plain_area([rings])
        check_valid(got.get(k, []))
        assert area(got.get(k, [])) == pytest.approx(want, rel=1e-6, abs=1e-6), k


def test_small_shapes_are_repaired_in_their_row(spark, monkeypatch):
    import json

    from lotespark.sources import feeds

    rows = {k: v[0] for k, v in KNOWN.items()}
    df = frame(spark, [(k, [[pts(r) for r in v]]) for k, v in rows.items()] + [(1000, None), (1001, []), (1002, [[]])])
    got = {r.k: [[[(p.x, p.y) for p in ring] for ring in poly] for poly in r.polygons or []] for r in planar.repaired(df, "p", "polygons").collect()}
    assert len(got) == len(rows) + 3
    for k, rings in rows.items():
        check_valid(got[k])
        assert area(got[k]) == pytest.approx(plain_area([rings]), rel=1e-6, abs=1e-6), k
    monkeypatch.setattr(planar, "repair", lambda *_: pytest.fail("a small shape went to the graph, which shuffles every edge at each step"))
    text = [(k, json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": KNOWN[k][0]}})) for k in (1, 2, 7)]
    feed = feeds.parcel_features(spark.createDataFrame(text, "k long, text string"))
    assert {r.k: r.a for r in feed.withColumn("a", G.area(F.col("polygon"))).collect()} == {1: pytest.approx(1.0), 2: pytest.approx(16.0), 7: None}


def test_a_batch_of_shapes_is_repaired_at_once(monkeypatch):
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np
    import pyarrow as pa

    from lotespark.operators import planar_rows as R

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    column = lambda rows: pa.array([r and [q and [[dict(zip("xy", p)) for p in pts(ring)] for ring in q] for q in r] for r in rows], kind)
    plain = lambda polys: [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in polys or []]
    rng = random.Random(9)
    rows = [[v[0]] for v in KNOWN.values()]
    for _ in range(300):
        side = rng.choice([4, 8, 1000])
        rows.append([[[(rng.randint(0, side), rng.randint(0, side)) for _ in range(rng.randint(3, 14))] for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))])
    nan, none = float("nan"), [None, [], [[]], [None]]
    shapes_ = column([*rows, *none, [[[(0, 0), (1, 0), (1, nan), (0, 1)]]], [KNOWN[4][0], None]])
    every, best = R.repaired(shapes_, 9).to_pylist(), R.largest_valid(shapes_, 9).to_pylist()
    assert every[len(rows) :] == [None] * 6 and best[len(rows) :] == [{"polygon": None, "x": None, "y": None}] * 6
    for r, polys, one in zip(rows, every, best):
        got = plain(polys)
        check_valid(got)
        assert got == sorted(got) and area(got) == pytest.approx(plain_area([[ring for q in r for ring in q]]), rel=1e-6, abs=1e-6), r
        if got and len(r) == len(r[0]) == 1:
            assert abs(area(plain([one["polygon"]]))) == pytest.approx(max(area([p]) for p in got))
    monkeypatch.setattr(R, "BLOCK", 40)  # other blocks, same shapes
    assert R.repaired(shapes_, 9).to_pylist() == every and R.largest_valid(shapes_, 9).to_pylist() == best
    # groups whose hashes are one are told apart by their values
    assert R._firsts(np.array([0, 0, 1 << 24, 1 << 24]), np.array([1.5, 1.5, 1.5, 2.5])).tolist() == [0, 0, 2, 3]
    values = [rng.uniform(-180, 180) for _ in range(500)] + [k / 1e10 for k in range(-561234567915, -561234567415)] + [7123456.1234567895, 1e300, -3e-10, 5e-10, -5e-10, 0.0]
    with np.errstate(all="ignore"):
        snapped = R._snapped(np.array(values), 9).tolist()
    assert snapped == [float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP, R._WIDE)) for v in values]


def test_a_feed_is_repaired_by_one_step_over_batches(spark):
    import json

    from lotespark.sources import feeds

    feature = lambda c, kind="Polygon": json.dumps({"type": "Feature", "properties": {"CATASTRO": 7}, "geometry": {"type": kind, "coordinates": c}})
    square, bow, bare = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0, 0], [1, 1], [1, 0], [0, 3], [0, 0]], '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    two = '{"type":"FeatureCollection","features":[' + feature([square]) + "," + feature([bow]) + "]}"
    texts = [feature([square]), feature([bow]), two, feature([[bow], [square]], "MultiPolygon"), bare, bare.replace("[1,1]", '[1,"NaN"]'), feature([square]) + " more", feature([square]) + feature([bow]), bare.replace("[1,1]", "[1,NaN]"), bare[:-9], "", "null", None, feature([square, None]), feature([3, 4], "Point"), feature([3, 4], "\\u0050oint").replace("\\\\", "\\")]
    feed = feeds.parcel_features(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    small = feeds.parcel_features(spark.createDataFrame(list(enumerate(texts[:14])), "k int, text string"))
    got = {}
    for r in feed.withColumn("a", F.round(G.area(F.col("polygon")), 6)).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.a, r.problem))
    disc = got.pop(14)
    assert disc == got.pop(15) and disc[0][0] == pytest.approx(3.12e-6, rel=0.2)
    assert got.pop(3) == [(0.666667, None)]  # what either the square or the bow covers; the bow's tip is largest
    assert got == {0: [(1.0, None)], 1: [(1.125, None)], 2: [(1.0, None), (1.125, None)], 4: [(0.5, None)], 5: [(None, "invalid_geometry")], 13: [(1.0, None)]}
    plan = small.select("k", "lng", "lat", F.size("polygon"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_union_of_random_parts(spark):
    rng = random.Random(2)
    groups = {k: [[[(rng.randint(0, s), rng.randint(0, s)) for _ in range(rng.randint(3, 6))]] for _ in range(rng.randint(1, 7))] for k, s in enumerate([6, 6, 20, 20, 500, 500, 500])}
    groups[7] = [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]] for x in range(5) for y in range(5) if (x, y) != (2, 2)]  # seams go, the gap stays
    rows = [(k, n, [[pts(r) for r in rings]]) for k, parts in groups.items() for n, rings in enumerate(parts)]
    got = shapes(planar.union(frame(spark, rows, more="n int, "), "k", "n", "p"))
    for k, parts in groups.items():
        check_valid(got.get(k, []))
        assert area(got.get(k, [])) == pytest.approx(plain_area(parts), rel=1e-6, abs=1e-6), k
    assert len(got[7]) == 1 and len(got[7][0]) == 2


def test_a_feed_of_large_and_small_shapes(spark):
    import json
    import math

    from lotespark.sources import feeds

    round_ = [(math.cos(2 * math.pi * k / 3000), math.sin(2 * math.pi * k / 3000)) for k in range(3000)]
    shapes_ = {"round": [round_ + round_[:1]], "bow": [[(0, 0), (1, 1), (1, 0), (0, 3), (0, 0)]], "square": [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]], "flat": [[(0, 0), (1, 0), (0, 0)]], "none": None}
    text = [(k, json.dumps({"type": "Feature", "properties": {}, "geometry": c and {"type": "Polygon", "coordinates": c}})) for k, c in shapes_.items()] + [("broken", '{"type":"Feature"'), ("null", None)]
    got = {r.k: r for r in feeds.parcel_features(spark.createDataFrame(text, "k string, text string")).withColumn("a", G.area(F.col("polygon"))).collect()}
    assert {k: r.problem for k, r in got.items()} == {"round": None, "bow": None, "square": None, "flat": "invalid_geometry", "none": "no_geometry"}
    assert got["round"].a == pytest.approx(math.pi, rel=1e-5) and got["bow"].a == pytest.approx(9 / 8) and got["square"].a == 1
    assert (got["bow"].lng, got["bow"].lat) == pytest.approx((0.25, 1.25))


def test_edges_are_not_sent_through_the_driver(spark):
    import re

    rings = frame(spark, [(k, [[pts(r) for r in v[0]]]) for k, v in KNOWN.items()]).withColumn("part", F.lit(0))
    noded = planar.noded(planar.ring_edges(rings, "k", "part", F.flatten("p")))
    assert noded.collect()
    plan = noded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan
    assert all("," not in keys for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan))  # extents, by geometry alone


def test_polygonize(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    inner = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    rows = {
        1: [square[:3], square[2:]],  # two lines that join at their ends
        2: [square, [(0, 0), (-1, -1)], [(4, 4), (5, 5), (6, 5)]],  # dangles
        3: [square, [(4, 4), (6, 6)], [(6, 6), (7, 6), (7, 7), (6, 6)]],  # a bridge between two areas
        4: [square, inner],  # an area and the one around it
        5: [[(0, 0), (4, 0)], [(4, 0), (4, 4), (0, 0)], [(4, 0), (6, 2), (4, 4)]],  # ends at 4,0; the last line's end at 4,4 is within another line
        6: [[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 7)]],
    }
    df = frame(spark, [(k, [pts(x) for x in v]) for k, v in rows.items()], P)
    got = shapes(planar.polygonize(df, "k", "p"))
    assert {k: sorted(round(area([p]), 9) for p in v) for k, v in got.items()} == {1: [16.0], 2: [16.0], 3: [0.5, 16.0], 4: [1.0, 15.0], 5: [8.0]}
    assert [len(p) for p in got[4]] == [2, 1]
    everywhere = shapes(planar.polygonize(df, "k", "p", everywhere=True))
    assert sorted(round(area([p]), 9) for p in everywhere[5]) == [4.0, 8.0]
    for polys in [*got.values(), *everywhere.values()]:
        check_valid(polys)


def test_polygonize_of_a_grid_of_lines(spark):
    lines = [[(0, y), (9, y)] for y in range(10)] + [[(x, -1), (x, 9.5)] for x in range(10)]
    got = shapes(planar.polygonize(frame(spark, [(1, [pts(x) for x in lines])], P), "k", "p", everywhere=True))
    assert len(got[1]) == 81 and area(got[1]) == pytest.approx(81)


# Relations


def on_segment(p, a, b):
    return (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def plain_covers(poly, p):
    edges = [(a, b) for r in poly for a, b in zip(r, r[1:] + r[:1])]
    if any(on_segment(p, a, b) for a, b in edges):
        return True
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1


def plain_within(p, q):
    """p - q has no area: exact areas of p, and of p and q together."""
    frac = lambda poly: [[tuple(map(Fraction, c)) for c in r] for r in poly]
    return abs(plain_area([frac(p), frac(q)]) - plain_area([frac(q)])) < 1e-12


def concave(rng, side):
    """A polygon without crossings, around a point, with a hole in half of the cases."""
    import math

    n, cx, cy = rng.randint(4, 9), rng.randint(3, side - 3), rng.randint(3, side - 3)
    out = [(cx + round(rng.uniform(1, 3) * math.cos(2 * math.pi * k / n), 1), cy + round(rng.uniform(1, 3) * math.sin(2 * math.pi * k / n), 1)) for k in range(n)]
    hole = [[(cx - 0.2, cy - 0.2), (cx + 0.2, cy - 0.2), (cx, cy + 0.3)]] if rng.random() < 0.5 else []
    return [out, *hole]


U_SHAPE = [[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]]
RING = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4)]]
RELATIONS = [
    (U_SHAPE, [[(1, 4), (5, 4), (5, 5), (1, 5)]], False),  # a bar across the gap: all corners are inside
    (U_SHAPE, [[(0, 0), (6, 0), (6, 2), (0, 2)]], True),
    (U_SHAPE, [[(2, 2), (4, 2), (4, 6), (2, 6)]], False),  # the gap itself: its edges run along the boundary
    (RING, [[(1, 1), (5, 1), (5, 5), (1, 5)]], False),  # around the hole: no edges meet
    (RING, [[(1, 1), (5, 1), (5, 5), (1, 5)], [(2, 2), (4, 2), (4, 4), (2, 4)]], True),  # with the same hole
    (RING, [[(1, 1), (5, 1), (5, 5), (1, 5)], [(1.5, 1.5), (4.5, 1.5), (4.5, 4.5), (1.5, 4.5)]], True),  # with a larger one
    (RING, [[(2, 2), (4, 2), (4, 4), (2, 4)]], False),  # the hole itself
    (RING, [[(0, 0), (2, 2), (0, 2)]], True),
    (RING, RING, True),
    ([[(0, 0), (6, 0), (6, 6), (0, 6)]], RING, True),
    (RING, [[(0, 0), (6, 0), (6, 6), (0, 6)]], False),
    (U_SHAPE, [[(1, 2), (3, 1), (5, 2), (3, 1.5)]], True),
]


def test_covered_by_known_and_random_shapes(spark):
    rng = random.Random(3)
    rows = [(q, p) for q, p, _ in RELATIONS] + [(concave(rng, 7), concave(rng, 7)) for _ in range(250)]
    for _ in range(150):  # shapes of half the size about the same centre: many lie within
        q = concave(rng, 6)
        cx, cy = sum(x for x, _ in q[0]) / len(q[0]), sum(y for _, y in q[0]) / len(q[0])
        f = rng.choice([0.3, 0.5, 0.9, 1.0])
        rows.append((q, [q[0] if f == 1.0 else [(round(cx + (x - cx) * f, 2), round(cy + (y - cy) * f, 2)) for x, y in q[0]]]))
    df = spark.createDataFrame([(k, [pts(r) for r in q], [pts(r) for r in p]) for k, (q, p) in enumerate(rows)], f"k int, q {P}, p {P}")
    got = {r.k: r.w for r in df.select("k", G.covered_by(F.col("p"), F.col("q")).alias("w")).collect()}
    for k, (q, p) in enumerate(rows):
        assert got[k] == (RELATIONS[k][2] if k < len(RELATIONS) else plain_within(p, q)), (k, q, p)
    assert 10 < sum(got.values()) < 200


def test_spatial_join_meets_each_pair_once(spark):
    rng = random.Random(4)
    a, b = [(k, [pts(r) for r in concave(rng, 9)]) for k in range(40)], [(k, [pts(r) for r in concave(rng, 9)]) for k in range(40)] + [(40, [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]])]
    l, r = spark.createDataFrame(a, f"a long, p {P}"), spark.createDataFrame(b, f"b long, q {P}")  # noqa: E741
    for op, test in (("within", plain_within), ("contains", lambda p, q: plain_within(q, p))):
        got = sorted(map(tuple, spatial.spatial_join(l, r, op, "p", "q", 0.7, "a", "b").collect()))
        assert got == sorted((i, j) for i, p in a for j, q in b if test(p, q))
    met = sorted(map(tuple, spatial.spatial_join(l, r, "intersects", "p", "q", 0.7, "a", "b").collect()))
    assert len(met) == len(set(met)) > 100


def test_tile_covers(spark):
    from lotespark.operators import grids

    rng = random.Random(8)
    zones = spark.createDataFrame([(1, [[(-56.2, -15.7), (-56.0, -15.7), (-56.2, -15.5), (-56.2, -15.7)]]), (2, [[(-56.1, -15.6), (-55.9, -15.6), (-55.9, -15.4), (-56.1, -15.4)], [(-56.05, -15.55), (-55.95, -15.55), (-55.95, -15.45), (-56.05, -15.45)]])], f"z int, p {P}")
    places = [(k, rng.uniform(-15.75, -15.35), rng.uniform(-56.25, -55.85)) for k in range(800)]
    points = spark.createDataFrame(places, "k int, lat double, lng double")
    cover = grids.tile_cover(zones, "z", "p", 9, 14).cache()
    got = sorted(map(tuple, grids.in_tiles(points, zones, cover, "k", "lat", "lng", "z", "p").collect()))
    rings = {r.z: [[(c.x, c.y) for c in ring] for ring in r.p] for r in zones.collect()}
    want = sorted((k, z) for k, lat, lng in places for z, poly in rings.items() if plain_covers(poly, (lng, lat)))
    assert got == want and len(got) == len(set(got)) > 100
    tiles = [tuple(r) for r in cover.select("z", "tile", "whole").collect()]
    assert len(tiles) == len(set(tiles)) and {len(t) for _, t, w in tiles if w} > {13} and all(len(t) == 14 for _, t, w in tiles if not w)
    assert not any(a != b and z == y and b.startswith(a) for z, a, _ in tiles for y, b, _ in tiles)  # no tile within another
    assert {r.tile for r in grids.feed_tiles(cover).collect()} == {t[:9] for _, t, _ in tiles}
