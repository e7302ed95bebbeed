"""Address resolution and land-use classification over landed feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import strings as S
from .quadtree import nearest_line
from .spatial import first_polygon

MOST_METRES = 100.0
#: Degrees that 100 m span at most, up to 80 degrees of latitude.
MOST_DEGREES = 0.0052


def incomplete(parcelas: DataFrame, fill_partial: bool = False) -> DataFrame:
    """Parcels without a street, or, with fill_partial, without a number either."""
    no_street = F.col("calle").isNull() | (F.col("calle") == "")
    no_number = F.col("numero").isNull() | (F.col("numero") == "")
    return parcelas.where(no_street | no_number if fill_partial else no_street)


def street_candidates(parcelas: DataFrame, streets: DataFrame, on: list[str]) -> DataFrame:
    """The nearest street of each parcel by planar degrees, dropped beyond 100 m, with the interpolated number.

    A street nearer in metres but farther in degrees isn't looked at.
    """
    take = ["nome", "tipo", "ini_esq", "fin_esq", "ini_dir", "fin_dir"]
    near = nearest_line(parcelas, streets.where("nome IS NOT NULL"), "centroid_lng", "centroid_lat", "line", "logradouro_id", take, on=on, within=MOST_DEGREES)
    dist = G.metres(F.col("centroid_lng"), F.col("centroid_lat"), F.col("px"), F.col("py"))
    number = R.house_number((F.col("ini_esq"), F.col("fin_esq")), (F.col("ini_dir"), F.col("fin_dir")), F.col("frac"))
    return near.withColumn("dist_m", dist).where(F.col("dist_m") <= MOST_METRES).select("parcela_id", S.joined(F.col("tipo"), F.col("nome")).alias("calle"), number.cast("string").alias("numero"), "dist_m")


def resolve_addresses(parcelas: DataFrame, from_streets: DataFrame, from_geocode: DataFrame) -> DataFrame:
    """Street interpolation where there is no street, then the geocoder: its number alone helps a parcel with a street, its street any other."""
    a = from_streets.select("parcela_id", F.col("calle").alias("s_calle"), F.col("numero").alias("s_numero"))
    b = from_geocode.select("parcela_id", F.col("calle").alias("g_calle"), F.col("numero").alias("g_numero"))
    out = parcelas.join(a, "parcela_id", "left").join(b, "parcela_id", "left")
    street = F.nullif(F.col("calle"), F.lit(""))
    by_street = street.isNull() & F.col("s_calle").isNotNull()
    by_geocode = ~by_street & F.when(street.isNull(), F.col("g_calle").isNotNull()).otherwise(F.col("g_numero").isNotNull())
    source = F.when(by_street, "logradouros").when(by_geocode, "geocode")
    return out.select(
        "parcela_id",
        F.when(by_street, F.col("s_calle")).when(by_geocode, F.coalesce(street, "g_calle")).otherwise(street).alias("calle"),
        F.when(by_street, F.col("s_numero")).when(by_geocode, F.col("g_numero")).otherwise(F.col("numero")).alias("numero"),
        source.alias("direccion_source"),
        R.confidence(source).alias("direccion_confidence"),
    )


def geocode_fields(components: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """Fields from a geocoder's components (key, pos, long_name, types): for each, the first component of its type."""
    rows = components.select(key, "pos", "long_name", F.posexplode("types").alias("tpos", "type"))
    order = F.struct("pos", "tpos")
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col("type") == t, F.col("long_name")), F.when(F.col("type") == t, order)).alias(f) for f, t in wanted.items()])


def place_counts(places: DataFrame) -> DataFrame:
    """Commercial places near each parcel: places(parcela_id, types)."""
    return places.groupBy("parcela_id").agg(F.count_if(R.is_commercial(F.col("types"))).alias("comercios"))


def classify_use(parcelas: DataFrame, places: DataFrame) -> DataFrame:
    counts = place_counts(places)
    out = parcelas.select("parcela_id", "uf_vivienda", "uf_comercio").join(counts, "parcela_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("parcela_id", R.final_use(zero("uf_vivienda"), zero("uf_comercio"), zero("comercios")).alias("uso_principal"))


def unclassified(parcelas: DataFrame, overwrite: bool = False) -> DataFrame:
    return parcelas if overwrite else parcelas.where("uso_principal IS NULL OR uso_principal = 'sin_datos'")


def classify_zones(parcelas: DataFrame, zones: DataFrame, size: float = 0.02) -> DataFrame:
    """Land use of the first district (least zone_id) that holds a parcel's centroid; sin_datos outside all or for unknown districts."""
    hit = first_polygon(parcelas, zones, "parcela_id", "zone_id", ["distrito"], x="centroid_lng", y="centroid_lat", polygon="polygon", size=size)
    return hit.select("parcela_id", "distrito", F.when(F.col("distrito").isNull(), "sin_datos").otherwise(R.district_use(F.col("distrito"))).alias("uso_principal"))


def classify_registry(parcelas: DataFrame, registry: DataFrame) -> DataFrame:
    """Type and use from the registry by nomenclature; of repeated codes the last listed. Unmatched parcels have nulls."""
    last = registry.groupBy("vinculacion").agg(F.max_by("tipo", "pos").alias("tipo"))
    use = F.when(F.col("tipo") == "RURAL", "vacante").when(F.col("tipo").isin("URBANO", "CLUB DE CAMPO"), "residencial")
    return parcelas.join(last, parcelas["nomenclatura"] == last["vinculacion"], "left").select("parcela_id", "tipo", use.alias("uso_principal"))


def classify_valuation(parcelas: DataFrame, valuations: DataFrame) -> DataFrame:
    """Vacant, built or no match from assessed values, of parcels not known to be vacant."""
    v = valuations.select("cca_code", S.money(F.col("valor_edificado")).alias("ve"), S.money(F.col("valor_terreno")).alias("vt"))
    todo = parcelas.where(~F.col("uso_principal").eqNullSafe("vacante") & F.col("cca_code").isNotNull())
    return todo.join(v, "cca_code", "left").select("parcela_id", R.vacancy(F.col("ve"), F.col("vt")).alias("resultado"))


def split_units(units: DataFrame, by: str = "parent", area: str = "s_m2", least: float = 25.0) -> DataFrame:
    """Parking places (under 25 m²) and units (from 25 m²) of each parcel; areas of 0 count as neither."""
    return units.groupBy(by).agg(F.count_if((F.col(area) > 0) & (F.col(area) < least)).alias("cocheras"), F.count_if(F.col(area) >= least).alias("uf"))


def frontage_join(parcels: DataFrame, sides: DataFrame, subs: DataFrame) -> DataFrame:
    """Parcels with their first positive frontage number (else S/N) and count of sub-parcels (else 1), by 42-character code."""
    front = sides.where((F.col("tdl") == "FRENTE") & F.col("feo").isNotNull() & (R.frontage(F.col("feo")) > 0))
    front = front.groupBy("cca").agg(F.min_by(R.frontage(F.col("feo")), "pos").alias("altura"))
    count = subs.groupBy(F.substring("cca", 1, 42).alias("cca")).agg(F.count("*").alias("uf"))
    out = parcels.join(front, "cca", "left").join(count, "cca", "left")
    return out.select("cca", F.coalesce(F.col("altura").cast("string"), F.lit("S/N")).alias("altura"), F.coalesce("uf", F.lit(1)).alias("uf"))


def guard_foreign_key(rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """The key where the valid table has it, else null."""
    known = valid.select(F.col(key).alias("_k")).distinct()
    return rows.join(known, rows[key] == known["_k"], "left").withColumn(key, F.col("_k")).drop("_k")


def alert(parcelas: DataFrame, kind: str, units: str) -> DataFrame:
    return parcelas.where((F.col(kind) == "UNIFAMILIAR") & (F.col(units) > 1))


def batch(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; 0 means all."""
    return df.orderBy(*order).limit(n) if n > 0 else df.orderBy(*order)


def source_label(registered: Column, geocoded: Column) -> tuple[Column, Column]:
    """A registered address beats a geocoded one, and names its source."""
    return F.coalesce(registered, geocoded), F.when(registered.isNotNull(), "registro").when(geocoded.isNotNull(), "geocode")


def dwelling_rows(parcelas: DataFrame, units: str = "units") -> DataFrame:
    """A row for each unit of each parcel; a parcel without units has one."""
    listed = F.when(F.size(units) > 0, F.col(units)).otherwise(R.one_unit(F.lit(None).cast("string")))
    return parcelas.select(*[c for c in parcelas.columns if c != units], F.explode(listed).alias("u")).select("*", "u.*").drop("u")


def identify(points: DataFrame, records: DataFrame, point_id: str, degrees: float = 0.0045) -> DataFrame:
    """The first record (least pos) within about 500 m of each point; both have lat and lng."""
    from .spatial import band_join

    hits = band_join(points.select(point_id, "lat", "lng"), records, degrees)
    rest = [c for c in hits.columns if c.endswith("_r") and c not in ("lat_r", "lng_r")]
    best = hits.groupBy(point_id).agg(*[F.min_by(c, "pos_r").alias(c.removesuffix("_r")) for c in rest])
    return points.join(best, point_id, "left")
