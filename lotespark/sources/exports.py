"""Sinks: Parquet tables, CSV reports with a byte-order mark, GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import paged


def write_table(df: DataFrame, path: str, by: str = "region_id", mode: str = "overwrite") -> None:
    """Parquet, a folder per region, whose rows are clustered before the write so that files stay few."""
    (df.repartition(by) if by in df.columns else df).write.mode(mode).partitionBy(*([by] if by in df.columns else [])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def csv_lines(rows: DataFrame, by: str, columns: list[str], order: list, sep: str = ";") -> DataFrame:
    """Text lines of each survey's report: the key, the row's number in order, and the line, quoted where needed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(text(c).rlike(f'[{sep}"\\n\\r]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.select(by, n.alias("n"), F.concat_ws(sep, n.cast("string"), *[quoted(c) for c in columns]).alias("line"))


def write_csv_reports(rows: DataFrame, path: str, by: str, columns: list[str], order: list, sep: str = ";", heading: list[str] | None = None, preamble: DataFrame | None = None) -> None:
    """Every survey's report as a file of its own: a mark, the preamble (`by`, lines: an array) and an empty line, the heading, and numbered rows in order.

    Each task writes the files of its surveys; they are moved to their place when all have ended (sources.paged).
    """
    paged.register(rows.sparkSession)
    keys = rows.select(by).distinct()
    heads = keys.select(by, F.lit(0).alias("n"), F.lit(sep.join(heading or ["N", *columns])).alias("line"))
    if preamble is not None:
        first = preamble.join(keys, by, "left_semi").select(by, F.posexplode(F.concat("lines", F.array(F.lit("")))).alias("k", "line"))
        heads = heads.union(first.select(by, F.col("k") - 1_000_000, "line"))
    lines = csv_lines(rows, by, columns, order, sep).union(heads)
    lines.repartition(by).sortWithinPartitions(by, "n").select(by, "line").write.format("survey_reports").mode("append").save(path)


def geojson_features(df: DataFrame, polygon: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text lines."""
    geometry = G.geojson(F.col(polygon))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("value"))
