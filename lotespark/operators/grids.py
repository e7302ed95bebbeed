"""Generated rows: offset grids, id ranges, probe points; map tiles and covers of zones by them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..runtime import spread, stored


def grid_cells(spark: SparkSession, south: float, west: float, north: float, east: float, step: float, passes: int = 1) -> DataFrame:
    """Cells of `passes` grids, each shifted back by its share of a step, cut to the box; flat cells are dropped.

    Latitudes come first in `ord`. Edges are sums of whole steps, not running sums.
    """
    box = spark.range(passes).select(F.col("id").alias("pass"), (F.lit(step) * F.col("id") / passes).alias("shift"))
    lat0, lng0 = F.lit(south) - F.col("shift"), F.lit(west) - F.col("shift")
    rows = lambda low, high: F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.lit(high) - low) / step) - 1, F.lit(0)).cast("long"))
    cells = box.withColumn("i", F.explode(rows(lat0, north))).withColumn("j", F.explode(rows(lng0, east)))
    cells = cells.select("pass", "i", "j", F.greatest(lat0 + F.col("i") * step, F.lit(south)).alias("s"), F.greatest(lng0 + F.col("j") * step, F.lit(west)).alias("w"), F.least(lat0 + (F.col("i") + 1) * step, F.lit(north)).alias("n"), F.least(lng0 + (F.col("j") + 1) * step, F.lit(east)).alias("e"))
    return cells.where((F.col("n") > F.col("s")) & (F.col("e") > F.col("w")))


def plain_grid(spark: SparkSession, south: float, west: float, north: float, east: float, step: float) -> DataFrame:
    """One grid of int(extent / step) + 1 steps each way, cut on the upper side only."""
    count = lambda low, high: int((high - low) / step) + 1
    rows = spark.range(count(south, north)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(count(west, east) - 1))))
    s, w = F.lit(south) + F.col("id") * step, F.lit(west) + F.col("j") * step
    return rows.select(F.col("id").alias("i"), "j", s.alias("s"), w.alias("w"), F.least(s + step, F.lit(north)).alias("n"), F.least(w + step, F.lit(east)).alias("e"))


def padded_ids(spark: SparkSession, first: int, last: int, width: int = 15) -> DataFrame:
    from ..functions.strings import zero_filled

    return spark.range(first, last + 1).select("id", zero_filled(F.col("id"), width).alias("code"))


def probe_points(df: DataFrame, lat: str, lng: str, step: float = 1e-4) -> DataFrame:
    """Six places to ask for each point: itself, four sides, one corner; `pos` is the order."""
    moves = [(0.0, 0.0), (step, 0.0), (-step, 0.0), (0.0, step), (0.0, -step), (step, step)]
    at = F.array(*[F.struct(F.lit(k).alias("pos"), (F.col(lat) + a).alias("plat"), (F.col(lng) + b).alias("plng")) for k, (a, b) in enumerate(moves)])
    return df.select("*", F.inline(at))


def ids_over_cells(hits: DataFrame, ids: str = "ids") -> DataFrame:
    """Different ids found over overlapping cells."""
    return hits.select(F.explode(ids).alias("id")).distinct()


def tile_key(lat, lng, zoom: int):
    """Quadkey of a point: two bits a level, from Web-Mercator tile numbers."""
    side = 1 << zoom
    sin = F.sin(F.radians(lat))
    x = F.least(F.greatest(F.floor((lng + 180) / 360 * side), F.lit(0)), F.lit(side - 1))
    y = F.least(F.greatest(F.floor((F.lit(0.5) - F.log((1 + sin) / (1 - sin)) / (4 * 3.141592653589793)) * side), F.lit(0)), F.lit(side - 1))
    digits = [(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1))).cast("string") for k in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def tile_rectangle(tx: Column, ty: Column, zoom: int) -> Column:
    """A map tile as a polygon in degrees."""
    side = 1 << zoom
    lng = lambda x: x / side * 360 - 180
    lat = lambda y: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / side))))
    return G.rectangle(lng(tx), lat(ty + 1), lng(tx + 1), lat(ty))


def tile_cover(zones: DataFrame, key: str, polygon: str, first: int = 9, last: int = 14) -> DataFrame:
    """(key, tile, whole): the quadkeys of the tiles that cover each zone's polygon, as long as they need be.

    From tiles of zoom `first` on, a tile that lies within the zone stays whole, one that
    meets its boundary is cut in four, down to zoom `last`; tiles outside are dropped. So
    a zone has many tiles along its boundary and few inside. Small tables come in few
    partitions, so each level's tiles are dealt over the cores before they are tested.
    """
    box = G.bounds(F.col(polygon))
    number = lambda lat, lng: tile_key(lat, lng, first)
    place = lambda k, bit: F.aggregate(F.split(k, ""), F.lit(0).cast("long"), lambda n, c: n * 2 + F.shiftright(c.cast("int"), bit).bitwiseAND(F.lit(1)))
    corner = zones.select(key, F.col(polygon).alias("_zone"), box.alias("_b")).withColumns({"_nw": number(F.col("_b.y1"), F.col("_b.x0")), "_se": number(F.col("_b.y0"), F.col("_b.x1"))})
    tiles = corner.withColumn("tx", F.explode(F.sequence(place(F.col("_nw"), 0), place(F.col("_se"), 0)))).withColumn("ty", F.explode(F.sequence(place(F.col("_nw"), 1), place(F.col("_se"), 1))))
    bits = lambda k: F.shiftright("tx", k).bitwiseAND(F.lit(1)) + 2 * F.shiftright("ty", k).bitwiseAND(F.lit(1))
    level, found = tiles.select(key, "_zone", "tx", "ty", F.concat(*(bits(k).cast("string") for k in range(first - 1, -1, -1))).alias("tile")), []
    for zoom in range(first, last + 1):
        shape = spread(level).withColumn("_tile", tile_rectangle(F.col("tx"), F.col("ty"), zoom)).where(G.intersects(F.col("_tile"), F.col("_zone")))
        level = stored(shape.withColumn("whole", G.covered_by(F.col("_tile"), F.col("_zone"))).drop("_tile"), "tiles")
        found.append(level.where("whole" if zoom < last else "true").select(key, "tile", "whole"))
        child = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d")
        level = level.where("NOT whole").select(key, "_zone", "tx", "ty", "tile", child)
        level = level.select(key, "_zone", (F.col("tx") * 2 + F.col("d").bitwiseAND(1)).alias("tx"), (F.col("ty") * 2 + F.shiftright("d", 1)).alias("ty"), F.concat("tile", F.col("d").cast("string")).alias("tile"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def in_tiles(points: DataFrame, zones: DataFrame, cover: DataFrame, point_id: str, lat: str, lng: str, key: str, polygon: str, first: int = 9, last: int = 14) -> DataFrame:
    """(point_id, key): pairs of a point and a zone that holds it, by the cover's tiles.

    A point has a tile of each zoom, a prefix of its last one, so the join is on equal
    keys. Only points in tiles that a zone's boundary passes meet its polygon.
    """
    prefix = F.explode(F.array(*(F.substring("_k", 1, z) for z in range(first, last + 1)))).alias("tile")
    at = points.select(point_id, F.col(lat).alias("_y"), F.col(lng).alias("_x"), tile_key(F.col(lat), F.col(lng), last).alias("_k")).select(point_id, "_x", "_y", prefix)
    met = at.join(cover, "tile")
    edge = met.where("NOT whole").join(zones.select(key, F.col(polygon).alias("_zone")), key).where(G.covers(F.col("_zone"), F.col("_x"), F.col("_y")))
    return met.where("whole").select(point_id, key).unionByName(edge.select(point_id, key))


def feed_tiles(cover: DataFrame, zoom: int = 9) -> DataFrame:
    """The tiles of one zoom that a feed cut by that zoom has to be read for."""
    return cover.select(F.substring("tile", 1, zoom).alias("tile")).distinct()
