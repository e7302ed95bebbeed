"""Upserts as joins: a table's new state from its old one and a feed, column by column.

Rules say what an update does to a column:

    overwrite     the feed's value, null too
    coalesce      the feed's value unless null
    nullif0       the feed's value unless null or 0
    fill          the old value unless null
    keep          the old value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {
    "overwrite": lambda new, old: new,
    "coalesce": lambda new, old: F.coalesce(new, old),
    "nullif0": lambda new, old: F.coalesce(F.nullif(new, F.lit(0)), old),
    "fill": lambda new, old: F.coalesce(old, new),
    "keep": lambda new, old: old,
}


def fold_feed(feed: DataFrame, keys: list[str], rules: dict[str, str], order: str | None) -> DataFrame:
    """One row per key: what the feed's rows, applied one after the other, leave."""
    if order is None:
        return feed
    out = []
    for c in feed.columns:
        if c in keys or c == order:
            continue
        rule = rules.get(c, "overwrite")
        if rule in ("coalesce", "nullif0"):
            real = F.col(c).isNotNull() if rule == "coalesce" else (F.col(c).isNotNull() & (F.col(c) != 0))
            out.append(F.max_by(c, F.when(real, F.col(order))).alias(c))
        elif rule in ("fill", "keep"):
            out.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)) if rule == "fill" else F.col(order)).alias(c))
        else:
            out.append(F.max_by(c, order).alias(c))
    return feed.groupBy(*keys).agg(*out)


def merge(target: DataFrame, feed: DataFrame, keys: list[str], rules: dict[str, str] | None = None, *, order: str | None = None, insert: dict[str, Column] | None = None, default: str = "coalesce") -> DataFrame:
    """The target after inserting the feed's new keys and updating the known ones.

    `order` names the feed's position where keys may repeat in it: later rows
    update earlier ones. A feed row with a null in its key is always inserted.
    `insert` gives values of columns that only new rows get. Null keys never match.
    """
    rules, insert = rules or {}, insert or {}
    full = {c: rules.get(c, default) for c in target.columns if c not in keys}
    whole_key = F.lit(True)
    for k in keys:
        whole_key = whole_key & F.col(k).isNotNull()
    keyed = fold_feed(feed.where(whole_key), keys, full, order)
    loose = feed.where(~whole_key)
    new = keyed.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in keyed.columns if c not in keys], F.lit(True).alias("_in"))
    old = target.withColumn("_was", F.lit(True))
    both = old.join(new, keys, "full_outer")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
            continue
        given = F.col(f"_new_{c}") if f"_new_{c}" in new.columns else F.lit(None)
        fresh = F.coalesce(given, insert[c]) if c in insert else given
        kept = F.col(c) if c not in keyed.columns else RULES[full[c]](given, F.col(c))
        changed = F.when(F.col("_was").isNull(), fresh).when(F.col("_in").isNull(), F.col(c)).otherwise(kept)
        cols.append(changed.cast(target.schema[c].dataType).alias(c))
    return both.select(*cols).unionByName(_inserts(loose, target, insert))


def _inserts(feed: DataFrame, target: DataFrame, insert: dict[str, Column]) -> DataFrame:
    cols = []
    for field in target.schema:
        given = F.col(field.name) if field.name in feed.columns else F.lit(None)
        cols.append(F.coalesce(given, insert.get(field.name, F.lit(None))).cast(field.dataType).alias(field.name))
    return feed.select(*cols)


def merge_counts(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the feed's keys are inserted and how many updated."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(1))
    found = feed.select(*keys).join(known, keys, "left")
    return found.agg(F.count_if(F.col("_known").isNull()).alias("insertadas"), F.count_if(F.col("_known").isNotNull()).alias("actualizadas"))


def insert_missing(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return target.unionByName(_inserts(feed.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), target, {}))


def replace_by_id(target: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    return target.join(feed.select(key), key, "left_anti").unionByName(feed.select(*target.columns))


def delete_cascade(survey_ids: DataFrame, surveys: DataFrame, edificios: DataFrame, unidades: DataFrame, parcelas: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """What is left after deleting surveys with their buildings' units, buildings, parcels and log."""
    gone = survey_ids.select("survey_id").distinct()
    buildings = edificios.join(gone, "survey_id", "left_semi").select("edificio_id").distinct()
    return {"unidades": unidades.join(buildings, "edificio_id", "left_anti")} | {
        name: df.join(gone, "survey_id", "left_anti") for name, df in (("edificios", edificios), ("parcelas", parcelas), ("log", log), ("surveys", surveys))
    }


def update_address(parcelas: DataFrame, found: DataFrame, preserve_street: bool) -> DataFrame:
    """Address columns of `found` (by parcela_id) over the old ones; with preserve_street only where the old are empty."""
    cols = [c for c in found.columns if c != "parcela_id"]
    new = found.select("parcela_id", *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = parcelas.join(new, "parcela_id", "left")
    for c in cols:
        old = F.nullif(F.col(c), F.lit("")) if dict(parcelas.dtypes)[c] == "string" else F.col(c)
        value = F.coalesce(old, F.col(f"_n_{c}")) if preserve_street and c == "calle" else F.coalesce(F.col(f"_n_{c}"), F.col(c))
        out = out.withColumn(c, F.when(F.col("_hit"), value).otherwise(F.col(c)))
    return out.select(parcelas.columns)


def update_use(parcelas: DataFrame, uses: DataFrame, units: bool = True) -> DataFrame:
    """New land use by parcela_id, with the least units it implies; without a new use nothing changes."""
    from ..functions.rules import least_units

    new = uses.select("parcela_id", F.col("uso_principal").alias("_uso"))
    out = parcelas.join(new, "parcela_id", "left")
    if units:
        out = out.withColumn("uf_vivienda", F.when(F.col("_uso").isNotNull(), least_units(F.col("_uso"), F.col("uf_vivienda"))).otherwise(F.col("uf_vivienda")))
    return out.withColumn("uso_principal", F.coalesce("_uso", "uso_principal")).select(parcelas.columns)
