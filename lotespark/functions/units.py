"""Floors, flats and least numbers of units read from addresses, unit codes and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import let

#: Patterns of hints at several units, with their kinds.
HINTS = (
    (r"\bpiso\s*(\d{1,2})\b", "piso"),
    (r"\b(\d{1,2})[°º]\s*(?:piso|p\.?)\b", "piso"),
    (r"\bdpto\.?\s*([A-Z\d]{1,4})\b", "dpto"),
    (r"\bdepartamento\s*([A-Z\d]{1,4})\b", "dpto"),
    (r"\b(ph\s*[a-z]?)\b", "ph"),
    (r"\b(\d{1,2})\s*[°º]?\s*([A-D])\b", "piso_letra"),
    (r"\boficina\s*(\d{1,3})\b", "oficina"),
    (r"\blocal\s*(\d{1,3})\b", "local"),
    (r"\bunidad\s*(\d{1,3})\b", "unidad"),
    (r"\b(\d)\s*ambientes?\b", "ambientes"),
    (r"\bmonoambiente\b", "ambientes"),
)


def letter_rank(c: Column) -> Column:
    return F.ascii(c) - 64


def floor_and_flat(address: Column) -> Column:
    """(floor, flat) from `... 3 A` or `... A 3` at the end of an address; null for a single unit."""
    a = F.trim(address)
    number_first, letter_first = r"\b(\d{1,2})\s+([A-Z])\s*$", r"\b([A-Z])\s+(\d{1,2})\s*$"
    part = lambda p, k: F.regexp_extract(a, p, k)
    return F.when(a.rlike(number_first), F.struct(part(number_first, 1).try_cast("int").alias("piso"), part(number_first, 2).alias("depto"))).when(
        a.rlike(letter_first), F.struct(part(letter_first, 2).try_cast("int").alias("piso"), part(letter_first, 1).alias("depto"))
    )


def building_from_unit(code: Column) -> Column:
    """Least floors, flats per floor and units of the building that a unit code comes from."""
    d = F.replace(F.upper(F.trim(code)), F.lit(" "), F.lit(""))
    number = F.regexp_extract(d, r"^(\d+)", 1).try_cast("int")
    letter = F.regexp_extract(d, r"([A-Z])$", 1)
    out = lambda floors, flats, units: F.struct(floors.cast("int").alias("pisos_min"), flats.cast("int").alias("dptos_por_piso_min"), units.cast("int").alias("unidades_min"))
    none = F.lit(None)
    return (
        F.when(d.rlike(r"^\d+[A-Z]$"), out(number, letter_rank(letter), number * letter_rank(letter) + letter_rank(letter)))
        .when(d.rlike(r"^[A-Z]$"), out(F.lit(1), letter_rank(d), letter_rank(d)))
        .when(d == "PB", out(F.lit(0), F.lit(1), F.lit(1)))
        .when(d.rlike(r"^PB[A-Z]$"), out(F.lit(0), letter_rank(letter), letter_rank(letter)))
        .when(d.rlike(r"^\d+$"), out(number, F.lit(1), number))
        .otherwise(out(none, none, F.lit(1)))
    )


def building_from_accounts(accounts: DataFrame, by: list[str], address: str = "address") -> DataFrame:
    """Least units of each building from its accounts: highest floor by widest floor, and the ground floor."""
    rows = accounts.withColumn("_u", floor_and_flat(F.col(address)))
    above, ground = F.col("_u.piso") != 0, F.col("_u.piso") == 0
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("cuentas"),
        F.max(F.when(above, F.col("_u.piso"))).alias("piso_max_visto"),
        F.max(F.when(above, letter_rank(F.col("_u.depto")))).alias("dptos_por_piso_min"),
        F.array_sort(F.collect_set(F.when(ground, F.col("_u.depto")))).alias("pb_dptos_vistos"),
    )
    ground_units = F.when(F.size("pb_dptos_vistos") > 0, F.size("pb_dptos_vistos")).otherwise(F.col("dptos_por_piso_min"))
    inferred = F.col("piso_max_visto").isNotNull()
    return agg.withColumn("unidades_min", F.when(inferred, F.col("piso_max_visto") * F.col("dptos_por_piso_min") + ground_units).otherwise(F.col("cuentas")).cast("bigint")).withColumn("fuente", F.when(inferred, "inferencia").otherwise("solo_cuentas"))


#: Letters of context on either side of a hint.
CONTEXT = 30


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _with_context(text: Column, lower: Column, pattern: str, kind: str) -> Column:
    """The hints of one pattern: the text between the matches gives each match's place, and the place its context."""
    found, between = F.regexp_extract_all(lower, F.lit(pattern), F.lit(0)), F.split(lower, pattern, -1)

    def placed(m: Column, gaps: Column) -> Column:
        letters = lambda many, n: F.aggregate(F.slice(many, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

        def one(x: Column, i: Column) -> Column:
            at = letters(gaps, i + 1) + letters(m, i)
            begin = F.greatest(at - CONTEXT, F.lit(0))
            return F.struct(F.lit(kind).alias("tipo"), stripped(x).alias("match"), stripped(F.substr(text, begin + 1, at + F.length(x) + CONTEXT - begin)).alias("raw"))

        return F.transform(m, one)

    return let(found, lambda m: let(between, lambda gaps: placed(m, gaps)))


def hints(text: Column) -> Column:
    """All hints in a text as structs of kind, match and up to 30 letters on either side."""
    return F.flatten(F.array(*(_with_context(text, F.lower(text), "(?iU)" + pattern, kind) for pattern, kind in HINTS)))


def least_units_from_hints(found: Column) -> Column:
    """Floors by flats a floor, as the hints name them; a house on the roof adds a floor's flats. Without floors it makes two, and nothing at all makes none.

    Numbers of flats and units count as floors, zero left out; flat letters count only beside a floor.
    """
    number = lambda h: F.regexp_extract(h["match"], r"(\d+)", 1).try_cast("int")
    floors = F.transform(F.filter(found, lambda h: h["tipo"].isin("piso", "piso_letra") | (h["tipo"].isin("dpto", "unidad") & (number(h) > 0))), number)
    letters = F.transform(F.filter(found, lambda h: h["tipo"] == "piso_letra"), lambda h: letter_rank(F.upper(F.regexp_extract(h["match"], "(?i)([A-D])", 1))))
    top = F.array_max(floors)
    wide = F.coalesce(F.array_max(letters), F.lit(1))
    roof = F.exists(found, lambda h: h["tipo"] == "ph")
    return F.when(top.isNull() & ~roof, 0).when((F.coalesce(top, F.lit(0)) == 0) & roof, 2).otherwise(top * wide + F.when(roof, wide).otherwise(0))
