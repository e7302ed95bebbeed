import math
import random

import pytest
from pyspark.sql import functions as F

from lotespark.functions import geometry as G
from lotespark.operators import quadtree
from lotespark.schemas import LINE

WHERE, LINES = "pid int, x double, y double", f"lid int, line {LINE}"


def dist(x, y, line):
    def part(a, b):
        (ax, ay), (bx, by) = a, b
        sq = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / sq)) if sq else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    return min(part(a, b) for a, b in zip(line, line[1:]))


def brute(points, lines, within=360.0):
    best = {i: min(((dist(x, y, ab), k) for k, ab in lines), default=(math.inf, None)) for i, x, y in points}
    return {i: (k, round(d, 9)) if d <= within else (None, None) for i, (d, k) in best.items()}


def nearest(spark, points, lines, within=360.0):
    P, L = spark.createDataFrame(points, WHERE), spark.createDataFrame(lines, LINES)
    rows = quadtree.nearest_line(P, L, "x", "y", "line", "lid", ["lid"], within=within).collect()
    assert len(rows) == len(points)
    return {r.pid: (r.lid, None if r.dist is None else round(r.dist, 9)) for r in rows}


def strokes(rng, n, x, y, spread, length, first=0):
    out = []
    for k in range(n):
        ax, ay = x + rng.uniform(0, spread), y + rng.uniform(0, spread)
        out.append((first + k, [(ax, ay), (ax + rng.uniform(-length, length), ay + rng.uniform(-length, length))]))
    return out


def test_nearest_line_is_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(60)] + [(99, 30.0, 30.0)]
    lines = strokes(rng, 80, 0, 0, 1, 0.1)
    assert nearest(spark, points, lines) == brute(points, lines)
    assert nearest(spark, points, lines, within=0.05) == brute(points, lines, within=0.05)


@pytest.mark.parametrize("leaf", [1, 8])
def test_nearest_line_on_skewed_space(spark, monkeypatch, leaf):
    """Most lines in one square metre, few over a country, one across all of it; points in both, far off, and on one spot."""
    monkeypatch.setattr(quadtree, "LEAF", leaf)
    rng = random.Random(leaf)
    lines = strokes(rng, 500, 10.0, 10.0, 1e-5, 1e-6) + strokes(rng, 60, 0, 0, 40, 1, 1000) + [(2000, [(-5.0, 3.0), (20.0, 4.0), (45.0, 30.0)])]
    points = [(i, 10 + rng.uniform(-2e-5, 3e-5), 10 + rng.uniform(-2e-5, 3e-5)) for i in range(60)]
    points += [(100 + i, rng.uniform(-10, 50), rng.uniform(-10, 50)) for i in range(60)] + [(300, 170.0, -80.0), (301, -170.0, 80.0)]
    points += [(400 + i, 10.00001, 10.00001) for i in range(50)]
    assert nearest(spark, points, lines) == brute(points, lines)


def test_tree_splits_where_lines_are_dense(spark):
    rng = random.Random(1)
    lines = spark.createDataFrame(strokes(rng, 900, 10.0, 10.0, 1e-3, 1e-5) + strokes(rng, 40, 0, 0, 40, 1, 1000), LINES)
    box = lines.select(F.monotonically_increasing_id().alias("_n"), G.bounds(F.array("line")).alias("b")).select("_n", "b.*", F.lit(0.0).alias("_vx"), F.lit(0.0).alias("_vy"))
    levels = quadtree._levels(box, [])
    cells = quadtree.tree(levels, [])
    leaves = cells.where("NOT splits")
    assert levels.join(leaves, ["_t", "_cx", "_cy"]).groupBy("_n").count().where("count <> 1").count() == 0
    assert leaves.agg(F.sum("n"), F.max("n")).first()[0] == 940 and leaves.agg(F.max("n")).first()[0] <= quadtree.LEAF
    depth = {r._t: r["count"] for r in leaves.groupBy("_t").count().collect()}
    assert min(depth) == 1 and max(depth) >= 5  # lone lines stay in wide cells
    assert cells.count() < 940


def test_keys_ties_and_rows_without_an_answer(spark):
    lines = [(5, "a", [(0.0, 0.0), (1.0, 0.0)]), (3, "a", [(0.0, 2.0), (1.0, 2.0)]), (1, "b", [(0.0, 1.0), (1.0, 1.0)]), (0, None, [(0.0, 1.0), (1.0, 1.0)]), (7, "a", [(0.5, 1.0)]), (8, "a", []), (9, "a", None), (2, "a", [(0.5, 1.0), (None, 1.0)]), (4, "a", [(0.5, 1.0), (math.nan, 1.0)])]
    L = spark.createDataFrame(lines, f"lid int, g string, line {LINE}")
    points = [(1, "a", 0.5, 1.0), (1, "a", 0.5, 1.0), (2, "b", 0.5, 0.5), (3, "c", 0.5, 0.5), (4, None, 0.5, 0.5), (5, "a", None, 0.5), (6, "a", 0.5, math.nan), (None, "a", 0.25, -1.0)]
    P = spark.createDataFrame(points, "pid int, g string, x double, y double")
    got = quadtree.nearest_line(P, L, "x", "y", "line", "lid", ["lid", "g"], on=["g"])
    assert got.columns == ["pid", "g", "x", "y", "lid", "dist", "frac", "px", "py"]
    rows = sorted(((r.pid, r.lid, r.dist, r.frac) for r in got.collect()), key=str)
    assert rows == sorted([(1, 3, 1.0, 0.5), (1, 3, 1.0, 0.5), (2, 1, 0.5, 0.5), (3, None, None, None), (4, None, None, None), (5, None, None, None), (6, None, None, None), (None, 5, 1.0, 0.25)], key=str)
    assert [r.lid for r in quadtree.nearest_line(P, L.limit(0), "x", "y", "line", "lid", ["lid"], on=["g"]).collect()] == [None] * 8
    assert quadtree.nearest_line(P.limit(0), L, "x", "y", "line", "lid", [], on=["g"]).count() == 0


def test_many_lines_on_one_spot(spark, monkeypatch):
    monkeypatch.setattr(quadtree, "LEAF", 2)
    lines = [(k, [(1.0, 1.0), (2.0, 1.0)]) for k in range(100, 40, -1)]
    assert nearest(spark, [(1, 1.5, 1.0), (2, 9.0, 1.0)], lines) == {1: (41, 0.0), 2: (41, 7.0)}
