"""Spatial and band joins as equi-joins on grid cells.

A raw distance or containment predicate plans as a nested loop. Here every side
gets the cells it touches, cells are joined by equality (so Spark shuffles,
broadcasts or splits skew as for any key), and the exact test is a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def with_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float, around: int = 0) -> DataFrame:
    """A row for each cell that a box touches, `around` cells more on every side."""
    xs = F.sequence(cell_of(x0, size) - around, cell_of(x1, size) + around)
    ys = F.sequence(cell_of(y0, size) - around, cell_of(y1, size) + around)
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, polygon: str, size: float, boundary: bool = True) -> DataFrame:
    """All pairs of a point and a polygon that holds it."""
    b = G.bounds(F.col(polygon))
    shapes = with_cells(polygons.withColumn("_b", b), F.col("_b.x0"), F.col("_b.y0"), F.col("_b.x1"), F.col("_b.y1"), size)
    dots = points.withColumn("_cx", cell_of(F.col(x), size)).withColumn("_cy", cell_of(F.col(y), size))
    box = F.col(x).between(F.col("_b.x0"), F.col("_b.x1")) & F.col(y).between(F.col("_b.y0"), F.col("_b.y1"))
    test = G.covers if boundary else G.contains
    return dots.join(shapes, ["_cx", "_cy"]).where(box & test(F.col(polygon), F.col(x), F.col(y))).drop("_cx", "_cy", "_b")


def first_polygon(points: DataFrame, polygons: DataFrame, point_id: str, order: str, take: list[str], **how) -> DataFrame:
    """Each point with columns of the first polygon (least `order`) that holds it; null where none does."""
    hits = point_in_polygon(points.select(point_id, how["x"], how["y"]), polygons, **how)
    best = hits.groupBy(point_id).agg(*[F.min_by(c, order).alias(c) for c in take])
    return points.join(best, point_id, "left")


def spatial_join(left: DataFrame, right: DataFrame, op: str, left_polygon: str, right_polygon: str, size: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of valid polygons by `intersects`, `within` (left in right) or `contains` (right in left).

    A pair is tested in the first cell that both touch, and only if the boxes allow it;
    boundaries and holes decide exactly (`geometry.covered_by`). Both sides are shuffled: rows made by
    exploding a small table come in few partitions, and Spark doesn't see how many they are.
    """

    def side(df: DataFrame, key: str, polygon: str, p: str) -> DataFrame:
        box = df.select(key, F.col(polygon).alias(p)).withColumn(f"{p}b", G.bounds(F.col(p)))
        return with_cells(box, *[F.col(f"{p}b.{c}") for c in ("x0", "y0", "x1", "y1")], size)

    a, b = F.col("_pb"), F.col("_qb")
    first = (F.col("_cx") == cell_of(F.greatest(a["x0"], b["x0"]), size)) & (F.col("_cy") == cell_of(F.greatest(a["y0"], b["y0"]), size))
    boxes, test = {
        "intersects": (G.bounds_meet(a, b), G.intersects(F.col("_p"), F.col("_q"))),
        "within": (G.bounds_within(a, b), G.covered_by(F.col("_p"), F.col("_q"))),
        "contains": (G.bounds_within(b, a), G.covered_by(F.col("_q"), F.col("_p"))),
    }[op]
    met = side(left, left_id, left_polygon, "_p").join(side(right, right_id, right_polygon, "_q").hint("merge"), ["_cx", "_cy"])
    return met.where(first & boxes).where(test).select(left_id, right_id)


def in_zone(df: DataFrame, zone: DataFrame, row_id: str, polygon: str, zone_polygon: str = "zone", size: float = 0.02) -> DataFrame:
    """Rows whose polygon meets any part of the zone; the zone's parts are one row each. Polygons meet in the cells that both touch."""
    hits = spatial_join(df.select(row_id, F.col(polygon).alias("_shape")), zone.select(F.monotonically_increasing_id().alias("_part"), F.col(zone_polygon).alias("_zone")), "intersects", "_shape", "_zone", size, row_id, "_part")
    return df.join(hits.select(row_id), row_id, "left_semi").select(df.columns)


def band_join(left: DataFrame, right: DataFrame, band: float, on: list[str] | None = None, lat: str = "lat", lng: str = "lng", suffix: str = "_r") -> DataFrame:
    """Pairs whose coordinates both differ by less than `band`, and that agree on the other keys.

    Cells are two bands wide, so a row on the right has four on average. Spark sizes rows as if they had one
    each and would send them all through the driver; the hint has both sides shuffled.
    """
    on = on or []
    size, reach = 2 * band, 1.001 * band  # a little more than the band, whose ends are rounded
    r = right.select(*on, *[F.col(c).alias(c + suffix) for c in right.columns if c not in on])
    x, y = F.col(lng + suffix), F.col(lat + suffix)
    r = with_cells(r, x - reach, y - reach, x + reach, y + reach, size)
    l = left.withColumn("_cx", cell_of(F.col(lng), size)).withColumn("_cy", cell_of(F.col(lat), size))  # noqa: E741
    near = (F.abs(F.col(lat) - F.col(lat + suffix)) < band) & (F.abs(F.col(lng) - F.col(lng + suffix)) < band)
    return l.join(r.hint("merge"), [*on, "_cx", "_cy"]).where(near).drop("_cx", "_cy")


def route(points: DataFrame, catalogue: DataFrame, point_id: str, lat: str, lng: str, size: float = 0.5) -> DataFrame:
    """The first city, in the catalogue's order, whose box holds each point; null where none does.

    The catalogue becomes a row for each cell with its boxes in order, so a point meets one row and isn't
    shuffled: many points in few cells, as cities have, are no task's burden. The catalogue is broadcast.
    """
    box = F.struct(*[F.col(c) for c in ("ord", "slug", "south", "west", "north", "east")])
    cells = with_cells(catalogue, F.col("west"), F.col("south"), F.col("east"), F.col("north"), size).groupBy("_cx", "_cy").agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    dots = points.withColumn("_cx", cell_of(F.col(lng), size)).withColumn("_cy", cell_of(F.col(lat), size))
    holds = F.filter("_boxes", lambda b: G.in_bbox(F.col(lat), F.col(lng), b["south"], b["west"], b["north"], b["east"]))
    return dots.join(F.broadcast(cells), ["_cx", "_cy"], "left").select(*points.columns, F.get(holds, 0)["slug"].alias("slug"))
