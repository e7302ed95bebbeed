"""Order-dependent operators as windows and ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_repeats_of_last_filled(df: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """Drops a row whose list equals the last list before it that wasn't empty; empty lists stay."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.size(items) > 0, F.col(items))
    last = F.last(filled, ignorenulls=True).over(before)
    return df.withColumn("_last", last).where(~((F.size(items) > 0) & F.coalesce(F.col(items) == F.col("_last"), F.lit(False)))).drop("_last")


def drop_repeats_of_previous(df: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """Drops a row whose list equals that of the row right before it, empty or not; only filled lists are compared."""
    prev = F.lag(items).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_prev", prev).where(~((F.size(items) > 0) & F.coalesce(F.col(items) == F.col("_prev"), F.lit(False)))).drop("_prev")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Running number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row that comes first for each key, by a grouped minimum (no sort of whole groups)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group: what a bounded buffer holds. Spark keeps n rows per group in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def since(df: DataFrame, cursor: int, order: str = "id") -> DataFrame:
    return df.where(F.col(order) > cursor)


def cursor_read(df: DataFrame, cursor: int) -> DataFrame:
    """How many entries lie after the cursor, and the new cursor."""
    return since(df, cursor).agg(F.count("*").alias("entries"), F.coalesce(F.max("id"), F.lit(cursor)).cast("bigint").alias("last_id"))


def remaining(first: int, last: int, done: DataFrame) -> DataFrame:
    """Ids of a range that aren't done; `done` has a column id."""
    return done.sparkSession.range(first, last + 1).join(done.select("id").distinct(), "id", "left_anti")


def processed(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("id")
    for s in sources[1:]:
        out = out.union(s.select("id"))
    return out.distinct()


def progress(log: DataFrame, total: int, ts: str = "ts") -> DataFrame:
    """Done, share, mean seconds per item, and minutes left at that pace."""
    agg = log.agg(F.count("*").alias("done"), (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("span"))
    mean = F.when(F.col("done") > 1, F.col("span") / (F.col("done") - 1))
    return agg.select("done", F.round(F.col("done") / total, 4).alias("share"), F.round(mean, 3).alias("mean_s"), F.round(mean * F.greatest(F.lit(total) - F.col("done"), F.lit(0)) / 60, 1).alias("eta_min"))


def histogram(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def two_histograms(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a and of b from one pass over the rows."""
    n = F.count("*").alias("n")
    which = F.when(F.grouping(a) == 0, a).otherwise(b).alias("campo")
    return df.groupingSets([[a], [b]], a, b).agg(n, which).select("campo", F.coalesce(a, b).alias("valor"), "n")


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of ties the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("pos"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("n"), -F.col("pos"))).alias(value))


def memoised(df: DataFrame, keys: list[str], enrich) -> DataFrame:
    """Enrich each different key once and join the answers back."""
    return df.join(enrich(df.select(*keys).distinct()), keys, "left")


def group_lists(df: DataFrame, keys: list[str], order: str, first: list[str], items: str) -> DataFrame:
    """Per key the first values of some columns and all items, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda s: s[items])
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in first], listed.alias(items))


def correct(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's values where it has some, by key."""
    cols = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns])
