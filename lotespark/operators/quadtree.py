"""Nearest lines by a tree of cells that split where lines are dense.

A cell with more than LEAF lines splits into 64 (three halvings of each axis);
an empty region has no cell at all, however wide. All levels are counted in one
grouped pass over the lines. A search goes down the tree level by level, all
points at once: a join with the cells' children, then each point keeps what may
still hold its nearest line. A round costs a few rows for each point, and there
are at most as many rounds as levels, wherever the lines are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..runtime import stored, temporary

#: Lines in a cell that doesn't split. It changes the work, not the result.
LEAF = 32
#: Levels of the tree, and binary digits of each axis that a level adds; cells of the last level don't split.
LEVELS, DIGITS = 8, 3

BOX = ("x0", "y0", "x1", "y1")
CELL = ("_t", "_cx", "_cy")


def _least(x: Column, y: Column) -> Column:
    """Distance of a point to the box of columns x0 .. y1; no line in that box is nearer."""
    return F.hypot(F.greatest(x - F.col("x1"), F.col("x0") - x, F.lit(0.0)), F.greatest(y - F.col("y1"), F.col("y0") - y, F.lit(0.0)))


def _most(x: Column, y: Column) -> Column:
    """Distance of a point to the box's farthest corner; every line in that box is nearer."""
    return F.hypot(F.greatest(x - F.col("x0"), F.col("x1") - x), F.greatest(y - F.col("y0"), F.col("y1") - y))


def _slack(bound: Column) -> Column:
    """The bound, and what rounding may have taken off it."""
    return bound * (1 + 1e-9) + 1e-12


def _levels(shapes: DataFrame, on: list[str]) -> DataFrame:
    """A row for each line and level: the cell that holds the middle of the line's box."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    west, south, east, north = shapes.agg(F.min(mx), F.min(my), F.max(mx), F.max(my)).first()
    count, side = 1 << DIGITS * LEVELS, max((east or 0.0) - (west or 0.0), (north or 0.0) - (south or 0.0)) or 1.0
    number = lambda v, low: F.least(F.floor((v - F.lit(low or 0.0)) / side * count).cast("bigint"), F.lit(count - 1))
    rows = shapes.select(*on, "_n", *BOX, "_vx", "_vy", number(mx, west).alias("_fx"), number(my, south).alias("_fy"), F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("_t"))
    up = lambda c: F.expr(f"shiftright({c}, {DIGITS} * ({LEVELS} - _t))")
    return rows.select(*on, "_t", up("_fx").alias("_cx"), up("_fy").alias("_cy"), "_n", *BOX, "_vx", "_vy")


def _parent() -> list[Column]:
    return [(F.col("_t") - 1).alias("_t"), F.shiftright("_cx", DIGITS).alias("_cx"), F.shiftright("_cy", DIGITS).alias("_cy")]


def tree(levels: DataFrame, on: list[str]) -> DataFrame:
    """The cells of the tree with the box of their lines, whether they split, and n, how many lines they hold."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    cells = stored(levels.groupBy(*on, *CELL).agg(F.count("*").alias("n"), *box), "cells")
    split = (F.col("n") > LEAF) & (F.col("_t") < LEVELS)
    below = cells.where(split).select(*on, *[F.col(c).alias(f"{c}_p") for c in CELL])
    kept = cells.select("*", *[c.alias(f"{k}_p") for k, c in zip(CELL, _parent(), strict=True)]).where("_t > 1").join(below, [*on, *[f"{c}_p" for c in CELL]], "left_semi")
    return kept.select(cells.columns).union(cells.where("_t = 1")).withColumn("splits", split)


def nearest_line(points: DataFrame, lines: DataFrame, x: str, y: str, line: str, line_id: str, take: list[str], on: list[str] | None = None, within: float = 360.0) -> DataFrame:
    """Each point with its nearest line by planar distance: `take` columns, dist, frac, and the nearest place (px, py).

    With `on`, only lines that agree on those columns count. Ties go to the
    least line_id. Points with a null, without any line that near, or whose key
    no line has, get nulls; repeated points get the same line each. Lines of
    fewer than two points, or with a coordinate that is null or not finite, are
    never nearest.

    Points on one spot search once. Of a cell or line that very many points are
    near, joins split; no step gathers the lines or points of a place in one task.
    """
    on = on or []
    names = [c for c in take if c not in on]
    finite = lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))  # noqa: E731  (a NaN is above all numbers)
    spot = ["_x", "_y", *on]
    px, py, each = F.col("_x"), F.col("_y"), Window.partitionBy(*spot)

    def closest(rows: DataFrame, most: Column, keep: list[Column | str]) -> DataFrame:
        """Rows whose box may hold the spot's nearest line; of each row `most` bounds the distance of a line in it."""
        rows = rows.withColumn("_near", _least(px, py)).where(F.col("_near") <= _slack(F.col("_most")))
        rows = rows.withColumn("_most", F.least("_most", F.min(most).over(each)))
        return rows.where(F.col("_near") <= _slack(F.col("_most"))).select(*spot, "_most", *keep)

    with temporary():
        sound = lines.where((F.size(line) > 1) & F.forall(line, lambda p: finite(p["x"]) & finite(p["y"])))
        shapes = sound.select(*on, F.col(line).alias("_line"), F.struct(F.col(line_id).alias("_id"), *names).alias("_take"), G.bounds(F.array(F.col(line))).alias("_b"))
        shapes = shapes.select("*", *[F.col(f"_b.{c}") for c in BOX], F.col("_line")[0]["x"].alias("_vx"), F.col("_line")[0]["y"].alias("_vy")).drop("_b")
        shapes = stored(shapes.withColumn("_n", F.monotonically_increasing_id()), "lines")  # numbered once
        levels = _levels(shapes, on)
        cells = stored(tree(levels, on), "tree")
        leaves = cells.where("NOT splits").select(*on, *CELL)
        rows = levels.join(leaves, [*on, *CELL])  # each line is in one leaf
        # what a search goes on to: from a cell that splits to its children, from a leaf to itself
        child = F.struct(*CELL).alias("_child")
        steps = cells.select(*on, *_parent(), child, *BOX).union(leaves.join(cells, [*on, *CELL]).select(*on, *CELL, child, *BOX))
        steps = stored(steps, "steps")
        at = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *on).where(finite(px) & finite(py)).distinct()
        at = at.select(*spot, F.lit(float(within)).alias("_most"), F.lit(0).alias("_t"), F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy"))
        for level in range(cells.agg(F.max("_t")).first()[0] or 0):
            here = steps.where(F.col("_t") <= level)
            if not on and not level:
                here = F.broadcast(here)  # 64 rows at most
            at = closest(at.join(here, [*on, *CELL]), _most(px, py), ["_child.*"])
        vertex = F.hypot(px - F.col("_vx"), py - F.col("_vy"))
        few = closest(at.join(rows, [*on, *CELL]), vertex, ["_n"])
        hits = few.join(shapes.select("_n", "_line", "_take"), "_n").withColumn("_l", G.locate(F.col("_line"), px, py))
        place = F.struct(*[F.col(f"_l.{a}").alias(b) for a, b in (("dist", "dist"), ("frac", "frac"), ("x", "px"), ("y", "py"))])
        best = hits.groupBy(*spot).agg(F.min_by(F.struct("_take", place.alias("_l")), F.struct("_l.dist", "_take._id")).alias("_v")).where(F.col("_v._l.dist") <= within)
        best = best.select(F.col("_x").alias("_kx"), F.col("_y").alias("_ky"), *[F.col(c).alias(f"_on{k}") for k, c in enumerate(on)], *[F.col("_v._take")[c].alias(c) for c in names], F.col("_v._l.*"))
        best = stored(best, "nearest", keep=True)
    same = (points[x] == best["_kx"]) & (points[y] == best["_ky"])
    for k, c in enumerate(on):
        same &= points[c] == best[f"_on{k}"]
    return points.join(best, same, "left").drop("_kx", "_ky", *[f"_on{k}" for k in range(len(on))])
