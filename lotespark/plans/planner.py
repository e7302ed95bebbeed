"""The next step of a survey as a rule table over its coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_step(country: str = "country_code") -> Column:
    """First rule that holds: base data, buildings, sectors, addresses, people, then the report."""
    brazil = F.col(country) == "BRA"
    return (
        F.when(F.col("errores").isNotNull(), "create_survey")
        .when(brazil & (F.col("setores") == 0), "load_census")
        .when(brazil & (F.col("logradouros_count") == 0), "load_streets")
        .when((F.col("footprints") == 0) & (F.col("parcelas") == 0), "load_parcels")
        .when((F.col("footprints") > 0) & (F.col("cobertura_footprints_pct") < 0.9), "join_sectors")
        .when(F.col("cobertura_direccion_pct") < 0.8, "resolve_addresses")
        .when(F.col("cobertura_habitantes_pct") < 0.8, "estimate_people")
        .when(F.col("suma_hab_vs_ibge_delta_pct") > 0.1, "validate_people")
        .otherwise("report")
    )


def suggestions(buildings: Column) -> Column:
    """Steps to offer after a zone is made; addresses only if there are buildings."""
    steps = F.array(F.lit("osm_buildings"), F.lit("census"), F.when(buildings > 0, F.lit("resolve_addresses")), F.lit("coverage"))
    return F.array_compact(steps)


def plan(coverage: DataFrame, regions: DataFrame) -> DataFrame:
    return coverage.join(regions.select("region_id", "country_code"), "region_id").select("region_id", next_step().alias("next_step"))
