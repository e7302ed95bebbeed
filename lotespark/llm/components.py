"""Connected components of a link table, by alternating large-star and small-star steps.

Every round is a grouped minimum and an equi-join, written to the shared folder;
no node's links meet in one task and nothing but two sums goes to the driver.
Kiveris et al., Connected Components in MapReduce and Beyond (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _own_key(df: DataFrame) -> DataFrame:
    """The same rows with `a` as a new column: Spark then shuffles both sides of a join on it, and can split a hub's rows."""
    return df.withColumn("a", F.col("a").bitwiseXOR(F.lit(0)))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _own_key(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(_own_key(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link. links: a, b (long), in any order.

    Loops, repeated links and an empty table are allowed.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        nxt = stored(_small_star(_large_star(now)), "links")
        got = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = nxt
        if got == seen or not got[0]:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(out.select("component", "component").distinct())
