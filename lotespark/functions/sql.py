"""Scalar rules as SQL functions, and the grid as a table function, for use in spark.sql."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .rules import DISTRICT_USE
from .strings import ACCENTED, DEPARTMENTS, PLAIN

_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_CASES = " ".join(f"WHEN d IN ({', '.join(map(_QUOTED, names))}) THEN '{use}'" for use, names in DISTRICT_USE.items())
_NAMES = " ".join(f"WHEN '{code}' THEN {_QUOTED(name)}" for code, name in DEPARTMENTS.items())

FUNCTIONS = {
    "slug": ("s STRING", "STRING", f"btrim(regexp_replace(translate(lower(s), '{ACCENTED}ñ', '{PLAIN}n'), '[^a-z0-9]+', '-'), '-')"),
    "money": ("s STRING", "DOUBLE", "try_cast(replace(trim(s), ',', '') AS DOUBLE)"),
    "dotted_decimal": ("s STRING", "DOUBLE", "try_cast(replace(replace(trim(s), '.', ''), ',', '.') AS DOUBLE)"),
    "zero_filled": ("s STRING, n INT", "STRING", "CASE WHEN length(s) >= n THEN s ELSE lpad(s, n, '0') END"),
    "department": ("c STRING", "STRING", f"CASE WHEN coalesce(trim(c), '') = '' THEN 'Salta' ELSE coalesce(CASE lpad(trim(c), 2, '0') {_NAMES} END, concat('Departamento ', trim(c))) END"),
    "district_use": ("d STRING", "STRING", f"CASE {_CASES} ELSE 'sin_datos' END"),
    "vacancy": ("built DOUBLE, land DOUBLE", "STRING", "CASE WHEN built < 1 THEN 'vacante' WHEN built IS NULL AND land IS NULL THEN 'sin_match' ELSE 'edificado' END"),
    "house_number": ("a DOUBLE, b DOUBLE, f DOUBLE", "INT", "CASE WHEN a > 0 AND b > 0 THEN nullif(CAST(bround(a + f * (b - a)) AS INT), 0) END"),
    "mercator_x": ("lng DOUBLE", "DOUBLE", "radians(lng) * 6378137e0"),
    "mercator_y": ("lat DOUBLE", "DOUBLE", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0"),
    "metres": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2))))"),
}


@udtf(returnType="south double, west double, north double, east double")
class GridCells:
    """Cells of one grid over a box."""

    def eval(self, south: float, west: float, north: float, east: float, step: float) -> Iterator[tuple]:
        i = 0
        while south + i * step < north:
            j = 0
            while west + j * step < east:
                yield south + i * step, west + j * step, min(south + (i + 1) * step, north), min(west + (j + 1) * step, east)
                j += 1
            i += 1


def register(spark: SparkSession, prefix: str = "lote_") -> list[str]:
    """Create the functions in a session; their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register(f"{prefix}grid_cells", GridCells)
    return [f"{prefix}{n}" for n in (*FUNCTIONS, "grid_cells")]
