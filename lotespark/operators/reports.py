"""Survey reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import display_address, fixed


def parcel_rows(parcelas: DataFrame) -> DataFrame:
    """Parcels of a report in order of street, number (as text) and id; nulls last."""
    uf = F.coalesce("uf_vivienda", F.lit(0)) + F.coalesce("uf_comercio", F.lit(0))
    return parcelas.select(
        "survey_id", "parcela_id", "calle", "numero", display_address(F.col("calle"), F.col("numero")).alias("direccion"), F.coalesce("cca_code", F.lit("")).alias("codigo"), uf.cast("bigint").alias("uf"),
        F.when(F.col("area_m2_terreno") != 0, F.round("area_m2_terreno", 1)).alias("area_m2"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last("calle"), F.asc_nulls_last("numero"), "parcela_id")


def totals(parcelas: DataFrame, by: list[str]) -> DataFrame:
    """Report totals: units, area (null if 0), parcels with address, units and code."""
    units = F.col("uf_vivienda") + F.col("uf_comercio")
    return parcelas.groupBy(*by).agg(
        F.count("*").alias("parcelas"),
        F.sum(F.coalesce(units, F.lit(0))).cast("bigint").alias("uf_total"),
        F.nullif(F.round(F.sum("area_m2_terreno"), 2), F.lit(0.0)).alias("area_total"),
        F.count_if(F.coalesce(F.col("calle") != "", F.lit(False))).alias("con_direccion"),
        F.count_if(units.isNotNull()).alias("con_uf"),
        F.count_if(F.coalesce(F.col("cca_code") != "", F.lit(False))).alias("con_codigo"),
    )


#: The report's title and headings, and what stands for missing values.
TITLE = "REPORTE DE RELEVAMIENTO CATASTRAL"
HEADING = ["N°", "Dirección", "Área m²", "UF", "Nomenclatura Catastral", "Partida Inmobiliaria"]
MISSING = "-"


def report_columns(parcelas: DataFrame) -> DataFrame:
    """A report's columns after the row's number, as text, missing values marked. parcelas: survey_id, calle, numero, area_m2_terreno, uf_vivienda, uf_comercio, nomenclatura_catastral, partida_inmobiliaria."""
    shown = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(MISSING))
    area = F.when(F.col("area_m2_terreno") != 0, fixed(F.col("area_m2_terreno"), 1))
    return parcelas.select(
        "survey_id", "parcela_id", "calle", "numero", shown(display_address(F.col("calle"), F.col("numero"))).alias("direccion"), shown(area).alias("area"),
        shown(F.col("uf_vivienda") + F.col("uf_comercio")).alias("uf"), shown(F.col("nomenclatura_catastral")).alias("nomenclatura"), shown(F.col("partida_inmobiliaria")).alias("partida"),
    )


def preamble(totals_: DataFrame, date: Column) -> DataFrame:
    """(survey_id, lines) of the reports' first lines, from totals with the region's name."""
    line = lambda name, c: F.concat(F.lit(f"{name};"), c.cast("string"))
    area = F.coalesce(thousands(F.col("area_total")), F.lit(MISSING))
    lines = F.array(
        F.lit(TITLE), line("Región", F.coalesce("name", F.lit(""))), line("Survey ID", F.col("survey_id")), line("Fecha", F.date_format(date, "dd/MM/yyyy HH:mm")), line("Total parcelas", F.col("parcelas")),
        line("Con dirección", F.col("con_direccion")), line("Con UF", F.col("con_uf")), line("Con nomenclatura", F.col("con_codigo")), line("Total UF", F.col("uf_total")), line("Área total relevada (m²)", area),
    )
    return totals_.select("survey_id", lines.alias("lines"))


def export_columns(parcelas: DataFrame) -> DataFrame:
    """The export's formats: texts never null, areas with one or two decimals, coordinates with six."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    shown = lambda c, places, n: F.coalesce(fixed(F.col(c), places), F.lit("")).alias(n)
    return parcelas.select("survey_id", "parcela_id", text("calle"), text("numero"), text("cca_code"), text("uso_principal"), F.coalesce("uf_vivienda", F.lit(0)).alias("uf_vivienda"), F.coalesce("uf_comercio", F.lit(0)).alias("uf_comercio"), shown("area_m2_terreno", 1, "area"), shown("centroid_lat", 6, "lat"), shown("centroid_lng", 6, "lng"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 1)


def status_report(stats: DataFrame) -> DataFrame:
    """Progress as text lines."""
    return stats.select(F.format_string("%d listos (%.1f %%), %.1f s por id, faltan %.1f min", F.col("done"), F.col("share") * 100, F.coalesce("mean_s", F.lit(0.0)), F.coalesce("eta_min", F.lit(0.0))).alias("linea"))
