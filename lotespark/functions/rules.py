"""Classification, confidence and arithmetic rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import parcel_number

#: Place types that count as commerce, and those that never do.
COMMERCIAL_TYPES = (
    "store", "restaurant", "bar", "cafe", "food", "bakery", "pharmacy", "supermarket", "shopping_mall", "clothing_store",
    "electronics_store", "furniture_store", "hardware_store", "jewelry_store", "shoe_store", "beauty_salon", "hair_care", "spa",
    "gym", "laundry", "bank", "atm", "insurance_agency", "real_estate_agency", "lawyer", "accounting", "doctor", "dentist",
    "hospital", "veterinary_care", "travel_agency", "car_dealer", "car_repair", "gas_station", "lodging", "night_club", "establishment",
)
EXCLUDED_TYPES = ("point_of_interest", "premise", "street_address", "route")
#: Place types that the older rule doesn't count as commerce.
IGNORED_TYPES = (
    "locality", "political", "route", "administrative_area_level_1", "administrative_area_level_2", "country", "sublocality", "sublocality_level_1", "neighborhood", "postal_code", "street_address", "premise",
)
#: Land use of each zoning district; others have no data.
DISTRICT_USE = {
    "residencial": ("R1", "R2", "R3", "R4", "R5", "R6", "Apto R6", "AR4_Zona Residencial Dominante_Tipología 2"),
    "comercial": ("NC1", "NC2", "NC3", "NC4", "AR4_Zona Comercial Exclusiva_Tipología 1"),
    "mixto": ("R3_Corredor Comercial", "R5_Corredor Comercial", "M1_Este", "M1_Oeste", "M2", "M3", "M4", "M5", "M6", "MA", "ACc", "ACe", "ACn", "ACs", "Corredor Avda. Belgrano", "AR4_Zona Mixto_Tipología 1 y 2"),
    "industrial": ("PI",),
    "vacante": ("AGR", "Area Rural"),
    "equipamiento": ("AE-EP", "AE-ES", "AE-NA", "AE-NG", "AE-PN", "AE-RE", "AE-RN", "EP", "PSM", "Espacios Verdes", "Red Vial"),
}
#: Confidence of an address by where it came from.
CONFIDENCE = {"logradouros": 0.80, "geocode": 0.85, "smartgis": 0.85, "bci": 0.95}
EARTH_RADIUS = 6378137.0
CALL_COST_USD = 0.005


def district_use(c: Column) -> Column:
    out = None
    for use, names in DISTRICT_USE.items():
        out = F.when(c.isin(*names), use) if out is None else out.when(c.isin(*names), use)
    return out.otherwise("sin_datos")


def is_commercial(types: Column) -> Column:
    arr = lambda names: F.array(*map(F.lit, names))
    return F.arrays_overlap(types, arr(COMMERCIAL_TYPES)) & (F.size(F.array_except(types, arr(EXCLUDED_TYPES))) > 0)


def any_other_type(types: Column, ignored: tuple[str, ...] = IGNORED_TYPES) -> Column:
    """The older rule: any type that isn't ignored is commerce; no types are none."""
    return F.coalesce(F.exists(types, lambda t: ~t.isin(*ignored)), F.lit(False))


def final_use(homes: Column, shops: Column, places: Column) -> Column:
    """Places fill in only where the cadastre has no shops; a failed lookup (-1) counts as none."""
    shop = F.when(shops > 0, shops).otherwise(F.greatest(places, F.lit(0)))
    return F.when(homes + shop <= 0, "sin_datos").when((homes > 0) & (shop > 0), "mixto").when(shop > 0, "comercial").otherwise("residencial")


def least_units(use: Column, units: Column) -> Column:
    return F.when(use == "residencial", F.greatest(F.coalesce(units, F.lit(0)), F.lit(1))).when(use == "vacante", F.lit(0)).otherwise(units)


def vacancy(built: Column, land: Column) -> Column:
    return F.when(built < 1, "vacante").when(built.isNull() & land.isNull(), "sin_match").otherwise("edificado")


def confidence(source: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), source)


def carto_units(total: Column, rows: Column) -> Column:
    return F.when(total == -1, F.lit(None)).when((total == 0) & (rows > 0), 1).otherwise(F.greatest(total, F.lit(1)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def interpolated(a: Column, b: Column, f: Column) -> Column:
    """House number at fraction f of a side, halves to even; null unless both ends are positive."""
    v = F.when((a > 0) & (b > 0), F.bround(a + f * (b - a)).cast("int"))
    return F.when(v != 0, v)


def house_number(left: tuple[Column, Column], right: tuple[Column, Column], f: Column) -> Column:
    has_left = F.coalesce((left[0] > 0) & (left[1] > 0), F.lit(False))
    return F.when(has_left, interpolated(*left, f)).otherwise(interpolated(*right, f))


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_RADIUS


def delta_share(total: Column, known: Column) -> Column:
    return F.when(known > 0, F.round(F.abs(total - known) / F.greatest(known, F.lit(1)), 4)).otherwise(F.lit(0.0))


def call_cost(calls: Column) -> Column:
    return calls * F.lit(CALL_COST_USD)


def frontage(feo: Column) -> Column:
    """Whole part of a frontage number without its sign; text that is no number is null."""
    return F.abs(feo.try_cast("double").try_cast("int"))


def minutes_between(start: Column, end: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(F.coalesce(end, now)) - F.unix_timestamp(start)) / 60).cast("bigint")


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (RFC 4122, version 5); the default namespace is that of DNS names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def address_key(*parts: Column) -> Column:
    """Deterministic id of an address from its normalised parts."""
    return uuid5(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]))


def parcel_of_code(code: Column) -> Column:
    """Number and suffix of a parcel from its code, without leading zeros; empty for codes of under 39 letters."""
    return F.concat(parcel_number(code), F.ltrim(F.substr(code, F.lit(40)), F.lit("0")))


def same_parcel(text: Column, code: Column) -> Column:
    """Does `Parcela: X` in a text, whatever its case, name the parcel of the code? Its leading zeros count. Missing data agree."""
    said = F.nullif(F.regexp_extract(text, r"(?iU)Parcela:\s*(\w+)", 1), F.lit(""))
    return F.coalesce(F.upper(said) == F.nullif(F.upper(parcel_of_code(code)), F.lit("")), F.lit(True))


def next_extent(*extents: Column) -> Column:
    """The first extent that is known: asked for, of the zone, stored."""
    return F.coalesce(*extents)


def days_hours_minutes(minutes: Column) -> Column:
    return F.struct((minutes / 1440).cast("bigint").alias("d"), ((minutes % 1440) / 60).cast("bigint").alias("h"), (minutes % 60).cast("bigint").alias("m"))


def fresh(saved: Column, now: Column, hours: int = 7) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(saved) < hours * 3600


def bbox_mercator(south: Column, west: Column, north: Column, east: Column) -> Column:
    return F.struct(mercator_x(west).alias("x0"), mercator_y(south).alias("y0"), mercator_x(east).alias("x1"), mercator_y(north).alias("y1"))


def times(ts: Column) -> Column:
    """A time in the forms that answers and reports use."""
    return F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'").alias("utc"), F.date_format(ts, "dd/MM/yyyy HH:mm").alias("report"))


def zone_outcome(ok: Column) -> Column:
    return F.when(ok, "partial").otherwise("failed")


def one_unit(use: Column) -> Column:
    """The single unit that a parcel counts as where nothing more is known."""
    return F.array(F.struct(F.lit(0).alias("piso"), F.lit("").alias("depto"), F.coalesce(use, F.lit("casa")).alias("tipo")))
