"""Text clean-up, code and address fields as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

#: Department names by code; two codes share one name.
DEPARTMENTS = {
    "01": "Capital", "02": "Rosario de Lerma", "03": "La Caldera", "04": "Chicoana", "05": "La Viña", "06": "Guachipas",
    "07": "Cerrillos", "08": "Rosario de Cachi", "09": "Molinos", "10": "San Carlos", "11": "Cafayate", "12": "Anta",
    "13": "Orán", "14": "Rivadavia", "15": "San Martín", "16": "Iruya", "17": "Santa Victoria", "18": "Metán",
    "19": "Rosario de la Frontera", "20": "Candelaria", "21": "Güemes", "22": "General Mosconi", "23": "Rivadavia",
}
#: Letters that lose their accents in slugs.
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def first_filled(*cols: Column) -> Column:
    """The first of the candidates that isn't blank."""
    return F.coalesce(*map(blank_to_null, cols))


def first_number(*cols: Column) -> Column:
    """As first_filled, but text of zeros alone counts as blank."""
    return F.coalesce(*[F.when(F.ltrim(blank_to_null(c), F.lit("0")) != "", F.trim(c)) for c in cols])


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that a frame has, whatever its case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def slug(c: Column, fold_enye: bool = True) -> Column:
    a, b = (ACCENTED + "ñ", PLAIN + "n") if fold_enye else (ACCENTED, PLAIN)
    return F.btrim(F.regexp_replace(F.translate(F.lower(c), a, b), "[^a-z0-9]+", "-"), F.lit("-"))


def region_id(c: Column, country: str = "") -> Column:
    return F.concat(F.lit("zona-"), slug(c, fold_enye=country != "br"), F.lit("-br" if country == "br" else ""))


def zero_filled(c: Column, width: int) -> Column:
    """Pads with zeros and, unlike lpad, never cuts."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def parcel_prefix(partido: Column, circ: Column, secc: Column, mza: Column) -> Column:
    return F.concat(zero_filled(partido, 3), zero_filled(circ, 2), F.lit("0"), F.upper(secc), F.lit("0" * 21), zero_filled(mza, 4))


def same_block(cca: Column, circ: Column, secc: Column, mza: Column) -> Column:
    """Is a parcel code of this district part, section and block, whatever its first three figures? By the parts' places."""
    return (F.substring(cca, 4, 2) == circ) & (F.substring(cca, 7, 1) == secc) & (F.substring(cca, 29, 4) == mza)


def parcel_number(cca: Column) -> Column:
    """The number at places 33 to 39 of a parcel code, as text without leading zeros but at least one figure; '' for short codes."""
    number = F.ltrim(F.substring(cca, 33, 7), F.lit("0"))
    return F.when(F.length(cca) >= 39, F.when(number == "", "0").otherwise(number)).otherwise("")


def parcel_suffix(cca: Column, both_ends: bool = False) -> Column:
    part = F.substring(cca, 40, 3)
    return F.btrim(part, F.lit("0")) if both_ends else F.ltrim(part, F.lit("0"))


def safe_text(c: Column, width: int) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none"), F.substring(t, 1, width))


def safe_count(c: Column) -> Column:
    """A positive whole number, cut towards zero, or null."""
    v = F.replace(c, F.lit(","), F.lit("")).try_cast("double").try_cast("bigint")
    return F.when(v > 0, v)


def fixed(c: Column, places: int) -> Column:
    """A double with so many decimals (up to seven), rounded by its exact value (halves to even), not by the figures that it is shown with.

    The fraction is a double of its own. Where its product with the scale looks like a
    half, what that product was rounded by tells on which side of the half it is.
    """
    scale = 10**places

    def rounded(v: Column) -> Column:
        f = v["f"]
        top = f * 134217729.0 - (f * 134217729.0 - f)  # the first 26 bits: times the scale they are exact, as is the rest
        low, product = f - top, f * scale
        error = (top * scale - product) + low * scale
        down = F.floor(product)
        rest = product - down
        below = v["whole"] * scale + down
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (below % 2 == 1))))
        n = below + F.when(up, 1).otherwise(0)
        figures = F.lpad((n % scale).cast("string"), places, "0") if places else F.lit("")
        return F.concat(F.when(c < 0, "-").otherwise(""), ((n - n % scale) / scale).cast("bigint").cast("string"), F.lit("." if places else ""), figures)

    whole = F.floor(F.abs(c))
    return let(F.struct(whole.alias("whole"), (F.abs(c) - whole).alias("f")), rounded)


def dotted_decimal(c: Column) -> Column:
    """`1.234,5` as 1234.5."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def money(c: Column) -> Column:
    """`15,673.60` as 15673.6."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def census_count(c: Column) -> Column:
    return F.coalesce(F.translate(F.trim(c), ".,", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def sector_code(c: Column) -> Column:
    return F.regexp_replace(c, "[A-Z]+$", "")


def face_id(code: Column, sector: Column, index: Column) -> Column:
    return F.coalesce(blank_to_null(code), F.concat(F.coalesce(sector, F.lit("X")), F.lit("_"), index.cast("string")))


def joined(*parts: Column) -> Column:
    """Filled parts with one space between them; null if none is."""
    return F.nullif(F.trim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])), F.lit(""))


def display_address(street: Column, number: Column) -> Column:
    return F.when(street != "", F.trim(F.concat_ws(" ", street, F.nullif(number, F.lit(""))))).otherwise("(sin dirección)")


def postal_code(c: Column) -> Column:
    return F.nullif(F.trim(F.translate(c, ".-", "")), F.lit(""))


def inscription(c: Column) -> Column:
    """`SECTOR-BLOCK-LOT#CODE` as a struct of block, lot and code."""
    halves = F.split(c, "#")
    places = F.split(F.try_element_at(halves, F.lit(1)), "-")
    part = lambda k: F.try_element_at(places, F.lit(k)).try_cast("bigint")
    return F.struct(part(2).alias("block"), part(3).alias("lot"), F.try_element_at(halves, F.lit(2)).try_cast("bigint").alias("code"))


def language(region: Column) -> Column:
    return F.when(region.endswith("-br") | region.contains("-br-"), "pt").otherwise("es")


def two_tokens(c: Column) -> Column:
    """Street and number as the first two words of a registered address; longer street names are cut to one word."""
    words = F.split(F.trim(c), r"\s+")
    return F.struct(F.nullif(F.try_element_at(words, F.lit(1)), F.lit("")).alias("calle"), F.try_element_at(words, F.lit(2)).alias("numero"))


def tag_address(tags: Column) -> Column:
    street, number = tags["addr:street"], tags["addr:housenumber"]
    return F.coalesce(F.when((street != "") & (number != ""), F.concat_ws(" ", street, number)), F.nullif(street, F.lit("")), F.nullif(tags["name"], F.lit("")), F.lit(""))


def department(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DEPARTMENTS.items() for x in pair])
    key = F.lpad(F.trim(code), 2, "0")
    return F.when(F.coalesce(F.trim(code), F.lit("")) == "", "Salta").otherwise(F.coalesce(F.try_element_at(names, key), F.concat(F.lit("Departamento "), F.trim(code))))


def wkt_bbox(c: Column) -> Column:
    """south, west, north, east of a bbox polygon written as WKT."""
    n = F.regexp_extract_all(c, F.lit(r"[-\d.]+"), F.lit(0))
    at = lambda k: F.try_element_at(n, F.lit(k)).try_cast("double")
    return F.struct(at(2).alias("south"), at(1).alias("west"), at(6).alias("north"), at(3).alias("east"))


def whole_code(c: Column) -> Column:
    """A code that reads as a whole number, or null."""
    return F.trim(c).try_cast("bigint")


def file_slug(region: Column, day: Column) -> Column:
    return F.concat(F.translate(region, "- ", "__"), F.lit("_"), F.date_format(day, "yyyyMMdd"))


def ellipsis(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)
