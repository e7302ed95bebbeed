"""Population by sector, units and checks: the planned layer over joined tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def dasymetric(buildings: DataFrame, sectors: DataFrame, weights: dict[str, Column], sector: str = "setor_id") -> DataFrame:
    """Each building's share of its sector's people under each weighting, and over them estimate, low, high and confidence.

    Sums per sector are a grouped aggregate joined back, so a large sector is
    never one task's window. A sector whose weights are all 0 is shared evenly.
    Confidence is 1 less the spread of the weightings, at least 0.
    """
    w = {k: F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)) for k, v in weights.items()}
    rows = buildings.select("*", *[v.alias(f"_w_{k}") for k, v in w.items()])
    sums = rows.groupBy(sector).agg(F.count("*").alias("_n"), *[F.sum(f"_w_{k}").alias(f"_s_{k}") for k in w])
    out = rows.join(sums.join(sectors.select(sector, "pop_total"), sector), sector)
    for k in w:
        share = F.when(F.col(f"_s_{k}") > 0, F.col(f"_w_{k}") / F.col(f"_s_{k}")).otherwise(1 / F.col("_n"))
        out = out.withColumn(f"hab_{k}", F.col("pop_total") * share)
    all_ = [F.col(f"hab_{k}") for k in w]
    low, high = (F.least(*all_), F.greatest(*all_)) if len(all_) > 1 else (all_[0], all_[0])
    out = out.withColumns({"habitantes_estimados": sum(all_[1:], all_[0]) / len(all_), "habitantes_low": low, "habitantes_high": high})
    spread = F.when(F.col("habitantes_estimados") > 0, (F.col("habitantes_high") - F.col("habitantes_low")) / F.col("habitantes_estimados")).otherwise(0.0)
    out = out.withColumn("habitantes_confidence", F.greatest(F.lit(0.0), 1 - spread))
    return out.drop(*[f"_w_{k}" for k in w], *[f"_s_{k}" for k in w], "_n")


def units_from_area(area: Column, per_unit: float = 80.0) -> Column:
    return F.round(area / per_unit).cast("bigint")


def validate(parcelas: DataFrame, sectors: DataFrame, surveys: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row per check: rows looked at and rows that fail it. Polygons are checked where parcels have them."""
    by_sector = parcelas.groupBy("setor_id").agg(F.sum("habitantes_estimados").alias("hab"))
    off = sectors.join(by_sector, "setor_id", "left").select(F.abs(F.coalesce("hab", F.lit(0.0)) - F.col("pop_total")) > tolerance * F.greatest("pop_total", F.lit(1)))
    row = lambda name, df, bad: df.agg(F.lit(name).alias("control"), F.count("*").alias("filas"), F.count_if(bad).alias("fallas"))
    people = row("habitantes_por_setor", off.toDF("bad"), F.col("bad"))
    twice = row("parcelas_repetidas", parcelas.groupBy("parcela_id").agg(F.count("*").alias("k")), F.col("k") > 1)
    known = surveys.select("survey_id").distinct().withColumn("_ok", F.lit(1))
    fk = row("survey_existe", parcelas.select("survey_id").join(known, "survey_id", "left"), F.col("_ok").isNull())
    place = row("centroide_valido", parcelas, ~(F.col("centroid_lat").between(-90, 90) & F.col("centroid_lng").between(-180, 180)) | F.col("centroid_lat").isNull())
    out = people.unionByName(twice).unionByName(fk).unionByName(place)
    if "polygon" in parcelas.columns:
        out = out.unionByName(row("geometria_valida", parcelas.select(G.repaired(F.col("polygon")).isNull().alias("bad")), F.col("bad")))
    return out
