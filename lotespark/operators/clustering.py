"""Upsert on a fuzzy centroid key: greedy leaders in feed order.

Rows of a feed come in order; each updates the leader nearest to it within the
band (then least id), or else becomes a leader. So a set of rows are the leaders if and
only if none is within the band of an earlier one, and every other row is.

Few rows are walked: of each small square the first. Tiles of many cells are walked in
feed order, each in one task that holds at most SQUARES ** 2 rows a cell. What leads
beyond a tile's border is taken from the round before, and rounds end when no row near
a border changes, after about as many as a chain of rows has tiles. Then all rows look
for an earlier leader, by a join on cells; the first of each square that finds none
(another row of its square was walked, and didn't lead) are walked too, from the start.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, ready, stored

BAND = 5e-5
#: Cells along a tile's side, and squares along a cell's.
TILE, SQUARES = 2048, 4


def _around(few: DataFrame, keys: list[str]) -> DataFrame:
    """Each row (cx, cy, o, x, y) once for its cell and each of the eight neighbours, as o, x and y with an m before."""
    cells = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i AS cx, cy + j AS cy))))"))
    return few.select(*keys, cells.alias("n"), F.col("o").alias("mo"), F.col("x").alias("mx"), F.col("y").alias("my")).select(*keys, "n.cx", "n.cy", "mo", "mx", "my")


def _close(band: float) -> Column:
    return (F.abs(F.col("x") - F.col("mx")) < band) & (F.abs(F.col("y") - F.col("my")) < band)


def walk(rows: pd.DataFrame, band: float) -> list[bool]:
    """Does each row lead? rows: ord, id, x, y, cx, cy, own, and leads, which holds for rows of other tiles."""
    held, out = defaultdict(list), [False] * len(rows)
    rows = rows.assign(at=range(len(rows))).sort_values(["ord", "id"], kind="stable", na_position="first")
    for r in rows.itertuples(index=False):
        near = ((mx, my) for i in (-1, 0, 1) for j in (-1, 0, 1) for mx, my in held.get((r.cx + i, r.cy + j), ()))
        if r.leads if not r.own else not any(abs(r.x - mx) < band and abs(r.y - my) < band for mx, my in near):
            held[r.cx, r.cy].append((r.x, r.y))
            out[r.at] = True
    return out


def _walked(chosen: DataFrame, keys: list[str], band: float, tile: int) -> DataFrame:
    """chosen (keys, cx, cy, o, x, y) with leads, by rounds of walks over the tiles."""
    home = F.struct(F.floor(F.col("cx") / tile).alias("tx"), F.floor(F.col("cy") / tile).alias("ty"))
    # the tiles that a row's neighbourhood touches
    tiles = F.expr(f"array_distinct(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(floor((cx + i) / {tile}) AS tx, floor((cy + j) / {tile}) AS ty)))))")
    flat = [*keys, "cx", "cy", "ord", "id", "x", "y", "leads", "border", "moved"]
    schema = chosen.select(*keys, "cx", "cy", "o.ord", "o.id", "x", "y").withColumns({c: F.lit(True) for c in flat[-3:]}).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leads = walk(group, band)
        kept = group.assign(now=leads)[group["own"].to_numpy()]
        return kept.assign(moved=kept["now"] != kept["leads"], leads=kept["now"])[flat]

    past = None
    now = chosen.select(*keys, "cx", "cy", "o.ord", "o.id", "x", "y").withColumns({"leads": F.lit(False), "border": F.size(tiles) > 1, "moved": F.lit(True)})
    while True:
        spread = now.withColumn("t", F.explode(tiles)).select(*flat, "t.tx", "t.ty", (F.col("t") == home).alias("own"))
        nxt = stored(spread.transform(ready).groupBy(*keys, "tx", "ty").applyInPandas(run, schema), "walked")
        forget(past)
        now = past = nxt
        if now.where("border AND moved").isEmpty():
            return now.withColumn("o", F.struct("ord", "id"))


def leaders(feed: DataFrame, row_id: str, order: str, keys: list[str], band: float = BAND, lat: str = "lat", lng: str = "lng", tile: int = TILE) -> DataFrame:
    """row_id and leader (the row_id that the row updates; itself if it is new) for every row of the feed. Rows without a place or a key are left out."""
    cell = band * (1 + 1e-6)  # a little wider, so that rounding moves no row within the band past the next cell
    rows = feed.select(*keys, F.struct(F.col(order).alias("ord"), F.col(row_id).alias("id")).alias("o"), F.col(lng).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    rows = rows.dropna(subset=[*keys, "x", "y"]).withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    square = {"sx": F.floor(F.col("x") / cell * SQUARES), "sy": F.floor(F.col("y") / cell * SQUARES)}

    def first(few: DataFrame) -> DataFrame:
        found = few.withColumns(square).groupBy(*keys, "cx", "cy", "sx", "sy").agg(F.min(F.struct("o", "x", "y")).alias("m"))
        return stored(found.select(*keys, "cx", "cy", "m.*"), "squares")

    chosen = first(rows)
    while True:
        found = stored(_walked(chosen, keys, band, tile).where("leads").select(*keys, "cx", "cy", "o", "x", "y"), "leaders")
        met = rows.join(_around(found, keys), [*keys, "cx", "cy"]).where(_close(band) & (F.col("mo") <= F.col("o")))
        far = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
        best = stored(met.groupBy(*keys, "o").agg(F.min(F.struct(far.alias("d"), F.col("mo.id").alias("id"))).alias("m")), "led")
        alone = first(rows.join(best.select(*keys, "o"), [*keys, "o"], "left_anti"))
        if alone.isEmpty():
            return best.select(F.col("o.id").alias(row_id), F.col("m.id").alias("leader"))
        forget(best)
        chosen = stored(chosen.union(alone), "squares")
