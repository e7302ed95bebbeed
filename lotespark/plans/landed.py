"""Queries over codes, landed payloads, zones, sinks and streams, with their SQL twins.

They register in the catalog's tables. Payload text is made from the driver's
tables and read back by the readers; sinks are written to the shared folder and
read again; streams run over everything that is there (`availableNow`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import strings as S
from ..operators import classify, merge, reports, sequences, spatial, surveys
from ..runtime import shared_dir, spread
from ..sources import exports, feeds, paged
from ..streaming import activity
from .catalog import query
from .fixtures import SIDE, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Parcel codes and text rules

CODE = """concat(lpad(CAST(o_orderkey % 200 AS {s}), 3, '0'), lpad(CAST(o_orderkey % 90 AS {s}), 2, '0'), '0', chr(CAST(65 + o_orderkey % 26 AS INT)), repeat('0', 21), lpad(CAST(o_orderkey % 9000 AS {s}), 4, '0'),
    CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat(lpad(CAST(o_orderkey % 700 AS {s}), 7, '0'), CASE WHEN o_orderkey % 3 = 0 THEN '0A0' ELSE '000' END) END)"""
CODE_SQL = CODE.format(s="VARCHAR")


@query(
    """SELECT o_orderkey, concat(lpad(CAST(o_orderkey % 200 AS VARCHAR), 3, '0'), lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0'), '0', chr(CAST(65 + o_orderkey % 26 AS INT)), repeat('0', 21),
    CASE WHEN o_orderkey % 12000 >= 10000 THEN CAST(o_orderkey % 12000 AS VARCHAR) ELSE lpad(CAST(o_orderkey % 12000 AS VARCHAR), 4, '0') END) AS prefijo FROM orders"""
)
def parcel_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The code's prefix from its four parts; numbers wider than their place stay whole."""
    k = F.col("o_orderkey")
    return _orders(spark, d).select("o_orderkey", S.parcel_prefix(k % 200, k % 90, F.expr("lower(chr(65 + o_orderkey % 26))"), k % 12000).alias("prefijo"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_orderkey % 700 AS VARCHAR) END AS numero,
    CASE WHEN o_orderkey % 8 > 0 AND o_orderkey % 3 = 0 THEN 'A0' ELSE '' END AS sufijo, CASE WHEN o_orderkey % 8 > 0 AND o_orderkey % 3 = 0 THEN 'A' ELSE '' END AS sufijo_corto,
    CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey % 700 END AS entero FROM (SELECT *, {CODE_SQL} AS cca FROM orders)"""
)
def parcel_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Number and suffix read from their places in the code; short codes have none."""
    c = F.col("cca")
    rows = _orders(spark, d).withColumn("cca", F.expr(CODE.format(s="STRING")))
    return rows.select("o_orderkey", S.parcel_number(c).alias("numero"), S.parcel_suffix(c).alias("sufijo"), S.parcel_suffix(c, both_ends=True).alias("sufijo_corto"), F.coalesce(S.whole_code(S.parcel_number(c)), F.lit(0)).alias("entero"))


@query(f"SELECT o_orderkey, cca LIKE '012%' AS provincia, cca LIKE '___07_C_____________________0187%' AS manzana FROM (SELECT o_orderkey, {CODE_SQL} AS cca FROM orders)")
def code_filters(spark: SparkSession, d: str) -> DataFrame:
    """Codes with a prefix, and codes of one block by the places of its parts."""
    c = F.expr(CODE.format(s="STRING"))
    return _orders(spark, d).select("o_orderkey", c.startswith("012").alias("provincia"), S.same_block(c, F.lit("07"), F.lit("C"), F.lit("0187")).alias("manzana"))


@query(
    """SELECT concat('012', lpad(CAST(setor_id AS VARCHAR), 29, '0'), lpad(CAST(setor_id AS VARCHAR), 7, '0'), '00B') AS cca, CAST(setor_id AS VARCHAR) AS pda, round(x0 + 2 * 2e-2 / 5, 7) AS lng, round(y0 + 2 * 2e-2 / 5, 7) AS lat, CAST(setor_id AS VARCHAR) AS numero, 'B' AS sufijo
    FROM setores WHERE setor_id % 2 = 1""",
    "setores",
)
def provincial_feed(spark: SparkSession, d: str) -> DataFrame:
    """Parcels of a provincial feed with the asked prefix, at the mean of their vertices."""
    ring = ", ',', ".join(f"'[', CAST({x} AS STRING), ',', CAST({y} AS STRING), ']'" for x, y in [("x0", "y0"), ("(x0 + 2e-2)", "y0"), ("(x0 + 2e-2)", "(y0 + 2e-2)"), ("x0", "(y0 + 2e-2)"), ("x0", "y0")])
    code = "concat(CASE WHEN setor_id % 2 = 1 THEN '012' ELSE '013' END, lpad(CAST(setor_id AS STRING), 29, '0'), lpad(CAST(setor_id AS STRING), 7, '0'), '00B')"
    text = F.expr(f"""concat('{{"type":"FeatureCollection","features":[{{"properties":{{"cca":"', {code}, '","pda":"', setor_id, '"}},"geometry":{{"type":"Polygon","coordinates":[[', {ring}, ']]}}}}]}}')""")
    got = feeds.parcels_by_code(table(spark, d, "setores").select(text.alias("text")), "012")
    return got.select("cca", "pda", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), "numero", "sufijo")


@query("SELECT concat('5108402', s_suppkey) AS setor_id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 * 10 END AS pop_total FROM supplier WHERE s_suppkey % 3 = 0")
def municipal_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Sectors of one municipality by whichever code column the frame has; letters at the code's end go."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat(CASE WHEN s_suppkey % 3 = 0 THEN '5108402' ELSE '5103403' END, s_suppkey, 'P') AS cd_geocodi", "CAST(s_suppkey % 4 * 10 AS STRING) AS V0001")
    return feeds.census_sectors(rows, "5108402")


@query(
    """SELECT CASE WHEN p_partkey % 4 = 0 THEN concat(CASE WHEN p_partkey % 8 = 0 THEN 'X' ELSE concat('51', p_partkey) END, '_', p_partkey) ELSE concat('F', p_partkey) END AS logradouro_id, CASE WHEN p_partkey % 8 > 0 THEN concat('51', p_partkey) END AS setor_id,
    CASE WHEN p_partkey % 5 > 1 THEN 'RUA' END AS tipo_logradouro, CAST(NULL AS VARCHAR) AS titulo_logradouro, left(p_name, 200) AS nome_logradouro, CASE WHEN p_size > 1 THEN 1000 + p_size END AS nro_inicial_esq, CAST(NULL AS BIGINT) AS nro_final_esq, CASE WHEN p_size % 2 = 1 THEN p_size END AS nro_inicial_dir, CAST(NULL AS BIGINT) AS nro_final_dir FROM part"""
)
def face_feed(spark: SparkSession, d: str) -> DataFrame:
    """Street faces from a frame with other column names: texts cleaned, counts read, blank ids made."""
    rows = _parts(spark, d).selectExpr(
        "p_partkey AS fila", "CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE concat(' F', p_partkey) END AS id_face", "CASE WHEN p_partkey % 8 > 0 THEN concat('51', p_partkey, 'A') END AS CD_GEO", "CASE p_partkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN ' None ' ELSE ' RUA ' END AS NM_TIP_LOG", "p_name AS NOME_LOG",
        "CASE WHEN p_size > 1 THEN concat('1,0', lpad(p_size, 2, '0'), '.7') ELSE '-3' END AS NUM_INI_E", "CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS STRING) ELSE 'x' END AS num_ini_d",
    )
    return feeds.street_faces(rows, "fila")


@query(
    r"""SELECT r.r_regionkey AS k, p.p_partkey AS p, concat('zona-', lower(replace(r_name, ' ', '-'))) AS region, concat('zona-', lower(replace(r_name, ' ', '-')), '-br') AS region_br, concat('zona_', replace(lower(r_name), ' ', '_'), '_20240305') AS archivo,
    CASE WHEN len(p_name) > 12 THEN concat(left(p_name, 11), '…') ELSE p_name END AS corto, round(p_size * 1e-2 - 16, 2) AS south, round(p_size * 1e-2 - 56, 2) AS west, round(p_size * 1e-2 - 15, 2) AS north, round(p_size * 1e-2 - 55, 2) AS east, format('{:,.1f}', p_size * 1000 + 5e-1) AS miles
    FROM region r JOIN part p ON p.p_partkey % 5 = r.r_regionkey"""
)
def names_and_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Region ids, file names, cut texts, number formats, and boxes written as WKT and read again."""
    rows = _parts(spark, d).join(spark.read.parquet(f"{d}/region.parquet"), F.col("p_partkey") % 5 == F.col("r_regionkey"))
    box = lambda a, b: F.round(F.col("p_size") * 0.01 - a + b, 2)
    b = S.wkt_bbox(G.bbox_wkt(box(16, 0), box(56, 0), box(15, 0), box(55, 0)))
    region = S.region_id(F.col("r_name"))
    return rows.select(
        F.col("r_regionkey").alias("k"), F.col("p_partkey").alias("p"), region.alias("region"), S.region_id(F.col("r_name"), "br").alias("region_br"), S.file_slug(region, F.lit("2024-03-05").cast("date")).alias("archivo"),
        S.ellipsis(F.col("p_name"), 12).alias("corto"), *[b[c].alias(c) for c in ("south", "west", "north", "east")], reports.thousands(F.col("p_size") * 1000 + 0.5).alias("miles"),
    )


@query("SELECT parcela_id, round(centroid_lat - 500 / 111000e0, 7) AS south, round(centroid_lng - 500 / (111000e0 * cos(radians(centroid_lat))), 7) AS west, round(centroid_lat + 500 / 111000e0, 7) AS north, round(centroid_lng + 500 / (111000e0 * cos(radians(centroid_lat))), 7) AS east FROM parcelas", "parcelas")
def boxes_around(spark: SparkSession, d: str) -> DataFrame:
    b = G.bbox_around(F.col("centroid_lat"), F.col("centroid_lng"), F.lit(500))
    return table(spark, d, "parcelas").select("parcela_id", *[b[c].alias(c) for c in ("south", "west", "north", "east")])


@query(
    r"""SELECT parcela_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS id
    FROM (SELECT parcela_id, sha1('\x6B\xA7\xB8\x10\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB || encode(concat(lower(trim(coalesce(calle, ''))), '|', coalesce(numero, ''), '|', survey_id))) AS h FROM parcelas)""",
    "parcelas",
)
def address_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of normalised addresses."""
    return table(spark, d, "parcelas").select("parcela_id", R.address_key(F.col("calle"), F.col("numero"), F.col("survey_id").cast("string")).alias("id"))


@query(
    """SELECT o_orderkey, CASE k WHEN 3 THEN FALSE WHEN 5 THEN FALSE WHEN 6 THEN FALSE ELSE TRUE END AS coincide, o_orderkey % 7 IN (1, 5, 6) AS otro_tipo FROM (SELECT *, o_orderkey % 9 AS k FROM orders)"""
)
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Does a text name the code's parcel, in any case, with its suffix and leading zeros (missing data agree)? Has a place a type that isn't administrative?"""
    n = "CAST(1 + o_orderkey % 700 AS STRING)"
    code = F.expr(f"CASE o_orderkey % 9 WHEN 2 THEN '0123' ELSE concat(repeat('0', 32), lpad({n}, 7, '0'), CASE o_orderkey % 9 WHEN 4 THEN '00A' WHEN 6 THEN '00C' WHEN 7 THEN '00Z' ELSE '000' END) END")
    text = F.expr(
        f"""CASE o_orderkey % 9 WHEN 0 THEN 'Circ: 1' WHEN 2 THEN 'Parcela: 9' WHEN 3 THEN concat('PARCELA: ', 2 + o_orderkey % 700) WHEN 4 THEN concat('Parcela: ', {n}, 'a') WHEN 5 THEN concat('Parcela: 00', {n})
        WHEN 6 THEN concat('x parcela:  ', {n}, 'B y') WHEN 7 THEN concat('Circ: 1\n parcela:\t', {n}, 'Z') WHEN 8 THEN concat('Parcela: ', {n}, ' Parcela: 1') END"""
    )
    kinds = F.expr("CASE o_orderkey % 7 WHEN 0 THEN array('premise', 'route') WHEN 1 THEN array('point_of_interest') WHEN 2 THEN array('locality', 'political', 'country') WHEN 3 THEN CAST(array() AS ARRAY<STRING>) WHEN 5 THEN array('neighborhood', 'store') WHEN 6 THEN array('establishment') END")
    return _orders(spark, d).select("o_orderkey", R.same_parcel(text, code).alias("coincide"), R.any_other_type(kinds).alias("otro_tipo"))


# Lists, components and dwellings


@query(
    """SELECT parent, count(*) AS n, count_if(s_m2 > 25) AS grandes, list(n ORDER BY n) = range(1, count(*) + 1) AS seguidos, max(n) AS ultimo, max(chr(CAST(64 + n AS INT))) AS letra FROM unit_counts GROUP BY parent""",
    "unit_counts",
)
def unit_lists(spark: SparkSession, d: str) -> DataFrame:
    """Over each parcel's listed units: counts by a condition, equality of lists, greatest floor and letter."""
    g = sequences.group_lists(table(spark, d, "unit_counts").withColumn("u", F.struct("n", "s_m2")), ["parent"], "n", [], "u")
    u, floors = F.col("u"), F.transform("u", lambda x: x["n"].cast("bigint"))
    return g.select(
        "parent", F.size(u).cast("bigint").alias("n"), F.size(F.filter(u, lambda x: x["s_m2"] > 25)).cast("bigint").alias("grandes"), (floors == F.sequence(F.lit(1).cast("bigint"), F.size(u).cast("bigint"))).alias("seguidos"),
        F.array_max(floors).alias("ultimo"), F.array_max(F.transform(floors, lambda n: F.chr(n + 64))).alias("letra"),
    )


@query(
    """SELECT parcela_id, CASE WHEN parcela_id % 3 > 0 THEN concat('Rua ', parcela_id) END AS calle, CASE WHEN parcela_id % 2 = 0 THEN '10' WHEN parcela_id % 3 = 0 THEN '20' END AS numero FROM parcelas WHERE parcela_id % 2 = 0 OR parcela_id % 3 > 0 OR parcela_id % 3 = 0""",
    "parcelas",
)
def geocoded_fields(spark: SparkSession, d: str) -> DataFrame:
    """Street and number from a geocoder's components: of each type the first component counts."""
    p = table(spark, d, "parcelas").select("parcela_id")
    part = lambda cond, pos, name, *types: p.where(cond).select("parcela_id", F.lit(pos).alias("pos"), name.alias("long_name"), F.array(*map(F.lit, types)).alias("types"))
    rows = part("parcela_id % 2 = 0", 0, F.lit("10"), "street_number", "premise").union(part("parcela_id % 3 = 0", 1, F.lit("20"), "street_number")).union(part("parcela_id % 3 > 0", 2, F.concat(F.lit("Rua "), F.col("parcela_id")), "political", "route")).union(part("true", 3, F.lit("AR"), "country"))
    return classify.geocode_fields(rows, "parcela_id", {"calle": "route", "numero": "street_number"})


@query(
    """SELECT p.parcela_id, CASE WHEN u.n IS NULL THEN 0 ELSE u.n END AS piso, CASE WHEN u.n IS NULL THEN '' ELSE chr(CAST(64 + u.n AS INT)) END AS depto, CASE WHEN u.n IS NULL THEN 'casa' ELSE 'dpto' END AS tipo FROM parcelas p LEFT JOIN unit_counts u ON u.parent = p.parcela_id""",
    "parcelas", "unit_counts",
)
def dwellings(spark: SparkSession, d: str) -> DataFrame:
    """A row for each unit of each parcel; a parcel without units has one."""
    u = table(spark, d, "unit_counts").select("parent", F.col("n").cast("int").alias("piso"), F.chr(F.col("n") + 64).alias("depto"), F.lit("dpto").alias("tipo"))
    units = u.groupBy(F.col("parent").alias("parcela_id")).agg(F.collect_list(F.struct("piso", "depto", "tipo")).alias("units"))
    return classify.dwelling_rows(table(spark, d, "parcelas").select("parcela_id").join(units, "parcela_id", "left"))


@query("SELECT parcela_id FROM parcelas WHERE parcela_id % 3 = 1 AND uf_vivienda > 1", "parcelas")
def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("parcela_id") % 3 == 1, "UNIFAMILIAR").otherwise("MULTIFAMILIAR")
    return classify.alert(table(spark, d, "parcelas").withColumn("kind", kind), "kind", "uf_vivienda").select("parcela_id")


@query("SELECT parcela_id, calle || '/' || numero || '/' || (parcela_id % 2) AS lugar FROM parcelas", "parcelas")
def memoised_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each different address is looked up once and joined back; rows with nulls in it find nothing."""
    p = table(spark, d, "parcelas").select("parcela_id", "calle", "numero", (F.col("parcela_id") % 2).alias("lado"))
    out = sequences.memoised(p, ["calle", "numero", "lado"], lambda k: k.withColumn("lugar", F.concat_ws("/", "calle", "numero", "lado")).where("calle IS NOT NULL AND numero IS NOT NULL"))
    return out.select("parcela_id", "lugar")


# Zones and places


def _boxes(spark: SparkSession, d: str, shift: float, side: float, name: str, where: str = "true") -> DataFrame:
    x, y = F.col("x0") + shift, F.col("y0") + shift
    return table(spark, d, "setores").where(where).select(F.col("setor_id").alias(name), G.rectangle(x, y, x + side, y + side).alias(f"p_{name}"))


MEET = "a.x0 + {s} <= b.x0 + {t} + {w} AND b.x0 + {t} <= a.x0 + {s} + {v} AND a.y0 + {s} <= b.y0 + {t} + {w} AND b.y0 + {t} <= a.y0 + {s} + {v}"


@query(
    f"""SELECT 'intersects' AS op, a.setor_id AS a, b.setor_id AS b FROM setores a JOIN setores b ON {MEET.format(s="3e-3", t="7e-3", v="2e-2", w="9e-3")}
    UNION ALL SELECT 'within', a.setor_id, b.setor_id FROM setores a JOIN setores b ON a.x0 + 5e-3 BETWEEN b.x0 AND b.x0 + 15e-3 AND a.y0 + 5e-3 BETWEEN b.y0 AND b.y0 + 15e-3
    UNION ALL SELECT 'contains', b.setor_id, a.setor_id FROM setores a JOIN setores b ON a.x0 + 5e-3 BETWEEN b.x0 AND b.x0 + 15e-3 AND a.y0 + 5e-3 BETWEEN b.y0 AND b.y0 + 15e-3""",
    "setores",
)
def zone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of polygons that meet, lie within, or contain one another."""
    join = lambda op, a, b: spatial.spatial_join(a, b, op, "p_a", "p_b", SIDE, "a", "b").select(F.lit(op).alias("op"), "a", "b")
    small_a, big_b, small_b, big_a = _boxes(spark, d, 5e-3, 5e-3, "a"), _boxes(spark, d, 0.0, SIDE, "b"), _boxes(spark, d, 5e-3, 5e-3, "b"), _boxes(spark, d, 0.0, SIDE, "a")
    meet = join("intersects", _boxes(spark, d, 3e-3, SIDE, "a"), _boxes(spark, d, 7e-3, 9e-3, "b"))
    return meet.union(join("within", small_a, big_b)).union(join("contains", big_a, small_b))


@query(
    f"""SELECT DISTINCT a.setor_id FROM setores a JOIN setores b ON b.setor_id % 7 = 0 AND {MEET.format(s="0e0", t="5e-3", v="2e-2", w="2e-2")}""",
    "setores",
)
def zone_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sectors whose polygon meets any part of the zone."""
    rows = _boxes(spark, d, 0.0, SIDE, "setor_id").withColumnRenamed("p_setor_id", "polygon")
    zone = _boxes(spark, d, 5e-3, SIDE, "part", "setor_id % 7 = 0").select(F.col("p_part").alias("zone"))
    return spatial.in_zone(rows, zone, "setor_id", "polygon", size=SIDE).select("setor_id")


#: Side of the shapes made at parcels, and the corners of broken and sound ones in sides; places that results are compared at.
W = 2e-4
SHAPES = {
    0: ("Polygon", [[(0, 0), (1, 1), (1, 0), (0, 3), (0, 0)]]),  # a bow tie with lobes of 9/8 and 1/8
    1: ("Polygon", [[(0, 0), (1, 0), (1, 1), (2, 2), (1, 1), (0, 1), (0, 0)]]),  # a spike
    2: ("MultiPolygon", [[[(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)]], [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]]),
    3: ("Polygon", [[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]]),
    4: ("Polygon", [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1), (0, 0)]]),  # goes round twice: what it goes round twice is out
    5: ("Polygon", [[(0, 0), (2, 0), (1, 0), (0, 0)]]),  # no area
}


def _marks(tree) -> tuple[list, list]:
    """Different x and different y of nested corners."""
    if isinstance(tree, tuple):
        return [tree[0]], [tree[1]]
    return tuple(sorted({c for t in tree for c in _marks(t)[k]}) for k in (0, 1))


def _nested(tree, marks: tuple[list, list]) -> str:
    """SQL of the JSON text of nested corners, of the texts c.x and c.y of marks."""
    if isinstance(tree, tuple):
        return f"'[', c.x[{marks[0].index(tree[0])}], ',', c.y[{marks[1].index(tree[1])}], ']'"
    return "'[', " + ", ',', ".join(_nested(t, marks) for t in tree) + ", ']'"


def _geometry(kind: str, tree, x: str, y: str) -> str:
    """SQL of a geometry's JSON text at x and y. Writing a number costs most, so each is written once."""
    marks = _marks(tree)
    texts = lambda v, ms: "array(" + ", ".join(f"CAST({v} + {m * W} AS STRING)" for m in ms) + ")"
    return f"""transform(array(struct({texts(x, marks[0])} AS x, {texts(y, marks[1])} AS y)), c -> concat('{{"type":"{kind}","coordinates":', {_nested(tree, marks)}, '}}'))[0]"""


@query(
    """SELECT parcela_id, CASE WHEN k < 5 THEN round(centroid_lng + 2e-4 * [25e-2, 5e-1, 1, 25e-1 / 3, 2][k + 1], 7) END AS lng, CASE WHEN k < 5 THEN round(centroid_lat + 2e-4 * [125e-2, 5e-1, 1, 25e-1 / 3, 2][k + 1], 7) END AS lat,
    CASE WHEN k < 5 THEN [1125e-3, 1, 4, 3, 12][k + 1] END AS lados2, CASE WHEN k = 4 THEN 1 WHEN k < 4 THEN 0 END AS huecos, CASE k WHEN 5 THEN 'invalid_geometry' WHEN 6 THEN 'no_geometry' END AS problem FROM (SELECT *, CAST(parcela_id % 7 AS INTEGER) AS k FROM parcelas WHERE parcela_id % 97 > 0)""",
    "parcelas",
)
def repaired_parcels(spark: SparkSession, d: str) -> DataFrame:
    """A feed of crossing, spiked, doubled and sound rings: centroid and area (in squares of the shapes' side) of what repair leaves, of several parts the largest. Malformed documents give no rows."""
    shape = "CASE parcela_id % 7 " + " ".join(f"WHEN {k} THEN {_geometry(kind, c, 'centroid_lng', 'centroid_lat')}" for k, (kind, c) in SHAPES.items()) + " ELSE 'null' END"
    docs = spread(table(spark, d, "parcelas").select("parcela_id", "centroid_lng", "centroid_lat")).select("parcela_id", F.expr(f"""CASE WHEN parcela_id % 97 > 0 THEN concat('{{"type":"Feature","properties":{{}},"geometry":', {shape}, '}}') ELSE '{{"type":"Feature","geometry":{{' END""").alias("text"))
    p = F.col("polygon")
    return feeds.parcel_features(docs).select("parcela_id", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), F.round(G.area(p) / (W * W), 3).alias("lados2"), (F.size(p) - 1).alias("huecos"), "problem")


BIG = {0: [[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]], 1: [[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]], 2: [[(0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6), (0, 0)]]}


@query(
    """, c AS (SELECT setor_id, a, b, w, h, setor_id * 1000 + a * 100 + b * 10 + w + h - 2 AS id FROM setores, unnest(range(0, 6)) x(a), unnest(range(0, 6)) y(b), unnest([1, 2, 5]) z(w), unnest([1, 3]) v(h)),
    hit AS (SELECT id, setor_id FROM c WHERE a + w <= 6 AND b + h <= 6 AND CASE setor_id % 3 WHEN 0 THEN NOT (a < 4 AND a + w > 2 AND b + h > 2) WHEN 1 THEN NOT (a < 4 AND a + w > 2 AND b < 4 AND b + h > 2) ELSE NOT (a + w > 3 AND b + h > 3) END)
    SELECT 'within' AS op, id, setor_id FROM hit UNION ALL SELECT 'contains', id, setor_id FROM hit""",
    "setores",
)
def concave_relations(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles within sectors that are U-shaped, have a hole, or are L-shaped: bars across a gap and frames around a hole are not within."""
    s = spread(table(spark, d, "setores")).select("setor_id", ((F.col("setor_id") % 10) * 6.0).alias("x"), (F.floor(F.col("setor_id") / 10) * 6.0).alias("y"))
    at = lambda c: G.point(F.col("x") + float(c[0]), F.col("y") + float(c[1]))
    shape = lambda k: F.array(*(F.array(*map(at, ring)) for ring in BIG[k]))
    kind = F.col("setor_id") % 3
    big = s.select("setor_id", F.when(kind == 0, shape(0)).when(kind == 1, shape(1)).otherwise(shape(2)).alias("big"))
    each = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    small = s.select("*", each("a", range(6))).select("*", each("b", range(6))).select("*", each("w", (1, 2, 5))).select("*", each("h", (1, 3)))
    x, y = F.col("x") + F.col("a"), F.col("y") + F.col("b")
    small = small.select((F.col("setor_id") * 1000 + F.col("a") * 100 + F.col("b") * 10 + F.col("w") + F.col("h") - 2).alias("id"), G.rectangle(x, y, x + F.col("w"), y + F.col("h")).alias("small"))
    within = spatial.spatial_join(small, big, "within", "small", "big", 6.0, "id", "setor_id").select(F.lit("within").alias("op"), "id", "setor_id")
    return within.unionByName(spatial.spatial_join(big, small, "contains", "big", "small", 6.0, "setor_id", "id").select(F.lit("contains").alias("op"), "id", "setor_id"))


@query(
    """, u AS (SELECT DISTINCT region_key, 2 * (setor_id % 10) + i AS x, 2 * CAST(floor(setor_id / 10) AS BIGINT) + j AS y FROM setores, unnest(range(0, 3)) a(i), unnest(range(0, 3)) b(j))
    SELECT region_key, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY region_key""",
    "setores",
)
def zone_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of each region's zone: overlapping sectors as polygons and as lines that join at their ends (with a dangling one), inner borders dissolved."""
    x, y = "2 * (setor_id % 10)", "2 * CAST(floor(setor_id / 10) AS BIGINT)"
    at = lambda i, j: f"'[', {x} + {i}, ',', {y} + {j}, ']'"
    line = lambda *c: "'[', " + ", ',', ".join(at(*p) for p in c) + ", ']'"
    area = f"""concat('{{"type":"Polygon","coordinates":[', {line((0, 0), (3, 0), (3, 3), (0, 3), (0, 0))}, ']}}')"""
    lines = f"""concat('{{"type":"MultiLineString","coordinates":[', {line((0, 0), (3, 0), (3, 3))}, ',', {line((3, 3), (0, 3), (0, 0))}, ',', {line((0, 0), (-1, -1))}, ']}}')"""
    rows = table(spark, d, "setores").select("region_key", F.expr(f"CASE WHEN setor_id % 3 = 0 THEN {lines} ELSE {area} END").alias("geometry"))
    whole = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + G.area(p))
    return feeds.zones(rows, "region_key", "geometry").select("region_key", F.round(whole, 6).alias("area"))


@query(
    """SELECT parcela_id, CASE WHEN parcela_id % 4 = 0 THEN 'rural' WHEN centroid_lat BETWEEN -156e-1 AND -155e-1 AND centroid_lng BETWEEN -562e-1 AND -561e-1 THEN 'capital' ELSE 'provincia' END AS fuente FROM parcelas""",
    "parcelas",
)
def feed_sources(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("parcela_id") % 4 == 0, "rural")
    return table(spark, d, "parcelas").select("parcela_id", feeds.source_of(F.col("centroid_lat"), F.col("centroid_lng"), asked, -15.6, -56.2, -15.5, -56.1).alias("fuente"))


@query(
    """, r AS (SELECT setor_id AS pos, x0 + 1e-2 AS lng, y0 + 1e-2 AS lat FROM setores), h AS (SELECT p.parcela_id, min(r.pos) AS pos FROM parcelas p JOIN r ON abs(p.centroid_lat - r.lat) < 45e-4 AND abs(p.centroid_lng - r.lng) < 45e-4 GROUP BY p.parcela_id)
    SELECT p.parcela_id, h.pos AS pos FROM parcelas p LEFT JOIN h ON h.parcela_id = p.parcela_id""",
    "parcelas", "setores",
)
def identified(spark: SparkSession, d: str) -> DataFrame:
    """The first landed record within about 500 m of each parcel."""
    p = table(spark, d, "parcelas").select("parcela_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    r = table(spark, d, "setores").select(F.col("setor_id").alias("pos"), (F.col("x0") + 1e-2).alias("lng"), (F.col("y0") + 1e-2).alias("lat"))
    return classify.identify(p, r, "parcela_id").select("parcela_id", "pos")


@query(
    """SELECT p_partkey, concat('Calle ', p_size) AS direccion, CASE WHEN p_partkey % 3 > 0 THEN concat('N', p_partkey) END AS nomenclatura, CASE WHEN p_partkey % 2 = 0 THEN '10,9,2' ELSE '' END AS partidas, CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_size + 75e-1 END AS s_m2 FROM part"""
)
def identify_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Address, nomenclature and sub-parcels (by their numeric keys) from an answer's titled blocks."""
    text = """concat('{"data":[{"title":"Domicilio","data":{"table":{"1":{"clave":"Calle","valor":"Calle ', p_size, '"}}}},', CASE WHEN p_partkey % 3 > 0 THEN concat('{"title":"Nomenclatura","data":{"table":{"0":{"clave":"Nomenclatura","valor":"N', p_partkey, '"}}}},') ELSE '' END,
        CASE WHEN p_partkey % 2 = 0 THEN concat('{"title":"Subparcelas","data":{"table":{"12":{"partida":"2","s_terreno":"2.50"},"2":{"partida":"10","s_terreno":"1,0', lpad(p_size, 2, '0'), '.00"},"9":{"partida":"9","s_terreno":"5.00"}}}}') ELSE '{"title":"Otro"}' END, ']}')"""
    got = feeds.getinfo(_parts(spark, d).select("p_partkey", F.expr(text).alias("text")), "p_partkey")
    total = F.when(F.size("subparcelas") > 0, F.aggregate("subparcelas", F.lit(0.0), lambda s, x: s + x["s_m2"]))
    return got.select("p_partkey", "direccion", "nomenclatura", F.array_join(F.transform("subparcelas", lambda x: x["partida"]), ",").alias("partidas"), total.alias("s_m2"))


@query(
    """SELECT setor_id, CASE setor_id % 6 WHEN 0 THEN 'Ciudad' WHEN 1 THEN 'Pueblo' WHEN 2 THEN 'Aldea' WHEN 3 THEN 'Barrio' WHEN 4 THEN 'Desconocida' ELSE 'Desconocida' END AS lugar,
    CASE setor_id % 6 WHEN 0 THEN 'Ciudad' WHEN 1 THEN 'Pueblo' WHEN 5 THEN printf('zona %.4f %.4f', y0, x0) ELSE 'zona' END AS zona FROM setores""",
    "setores",
)
def place_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of places and zones from a geocoder's address, by the chain of its parts; without an answer by coordinates."""
    part = lambda k, v: F.when(F.col("setor_id") % 6 == k, v).alias
    address = F.struct(part(0, "Ciudad")("city"), part(1, "Pueblo")("town"), part(2, "Aldea")("village"), part(3, "Barrio")("suburb"), F.lit(" ").alias("neighbourhood"), F.lit("").alias("municipality"), F.lit(None).cast("string").alias("county"))
    s = table(spark, d, "setores").withColumn("address", F.when(F.col("setor_id") % 6 != 5, address))
    return s.select("setor_id", feeds.place_name("address").alias("lugar"), feeds.zone_name("address", "y0", "x0").alias("zona"))


# Landed files and sinks


@query("SELECT n_nationkey AS clave, n_name AS nombre, n_nationkey % 2 AS pasos FROM nation")
def landed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole JSON files, one a folder, read as documents with defaults for what they leave out."""
    path = _scratch(spark, "documents")
    text = F.expr("""concat('{"clave":', n_nationkey, ',"nombre":"', n_name, '"', CASE WHEN n_nationkey % 2 = 1 THEN ',"pasos":1' ELSE '' END, '}')""")
    spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), text.alias("value")).coalesce(1).write.partitionBy("k").text(path)
    docs = feeds.documents(spark, path, "*.txt")
    defaults = feeds.with_defaults({"pasos": None}, {"pasos": 0})
    got = docs.select(F.from_json("text", "clave bigint, nombre string, pasos bigint").alias("d")).select("d.*")
    return got.select("clave", "nombre", F.coalesce("pasos", F.lit(defaults["pasos"] or 0)).cast("bigint").alias("pasos"))


@query("SELECT parcela_id, CASE WHEN parcela_id % 3 = 0 THEN 'nuevo' ELSE uso_principal END AS uso FROM parcelas UNION ALL SELECT -parcela_id, 'otro' FROM parcelas WHERE parcela_id % 5 = 0", "parcelas")
def document_store(spark: SparkSession, d: str) -> DataFrame:
    """A store in which new documents replace those of their id, written by region and read again."""
    p = table(spark, d, "parcelas").select("parcela_id", F.col("uso_principal").alias("uso"), (F.col("survey_id") % 5).alias("region_id"))
    new = p.where("parcela_id % 3 = 0").withColumn("uso", F.lit("nuevo")).union(p.where("parcela_id % 5 = 0").select(-F.col("parcela_id"), F.lit("otro"), "region_id"))
    path = _scratch(spark, "store")
    exports.write_table(merge.replace_by_id(p, new, "parcela_id"), path)
    return spark.read.parquet(path).select("parcela_id", "uso")


@query("SELECT setor_id, pos, round(x0 + 1e-2, 7) AS lng, round(y0 + 1e-2, 7) AS lat FROM (SELECT *, row_number() OVER (ORDER BY setor_id) - 1 AS pos FROM setores)", "setores")
def paged_feed(spark: SparkSession, d: str) -> DataFrame:
    """Sectors landed as pages of a service with their manifest, read to the short page that ends the feed."""
    path, batch = _scratch(spark, "pages"), 30
    s = table(spark, d, "setores").withColumn("pos", F.row_number().over(Window.orderBy("setor_id")) - 1)
    page = (F.col("pos") / batch).cast("int")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"k":'), F.col("setor_id").cast("string"), F.lit('},"geometry":'), G.geojson(G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + SIDE, F.col("y0") + SIDE)), F.lit("}"))
    pages = s.groupBy(page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", feature.alias("f")))), lambda x: x["f"]), ",").alias("f"))
    last = s.count() // batch  # a full last page is followed by an empty one
    pages = pages.unionByName(spark.range(last, last + 1).select(F.col("id").cast("int").alias("page"), F.lit("").alias("f"))).groupBy("page").agg(F.max("f").alias("f"))
    feeds.land_pages(pages.select((F.col("page") * batch).alias("start"), F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("text")), path)
    got = feeds.features(feeds.pages(spark, path, batch).withColumnRenamed("pos", "place"))
    c = G.centroid(G.from_geojson(F.col("geometry"))[0])
    return got.select(F.col("properties")["k"].cast("bigint").alias("setor_id"), F.col("place").alias("pos"), F.round(c["x"], 7).alias("lng"), F.round(c["y"], 7).alias("lat"))


@query("SELECT setor_id, round(x0 + 1e-2, 7) AS lng, round(y0 + 1e-2, 7) AS lat, distrito FROM setores", "setores")
def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    """Sectors written as GeoJSON lines and read back by the feed reader."""
    rows = _boxes(spark, d, 0.0, SIDE, "setor_id").join(table(spark, d, "setores").select("setor_id", "distrito"), "setor_id")
    path = _scratch(spark, "geojson")
    exports.geojson_features(rows, "p_setor_id", ["setor_id", "distrito"]).write.text(path)
    got = feeds.features(spark.read.text(path).withColumnRenamed("value", "text"))
    c = G.centroid(G.from_geojson(F.col("geometry"))[0])
    return got.select(F.col("properties")["setor_id"].cast("bigint").alias("setor_id"), F.round(c["x"], 7).alias("lng"), F.round(c["y"], 7).alias("lat"), F.col("properties")["distrito"].alias("distrito"))


@query(
    """, p AS (SELECT p.*, r.name, CASE WHEN coalesce(calle, '') <> '' THEN trim(concat_ws(' ', calle, nullif(numero, ''))) ELSE '(sin dirección)' END AS direccion FROM parcelas p JOIN surveys s ON s.survey_id = p.survey_id JOIN regions r ON r.region_key = s.region_key),
    t AS (SELECT survey_id, any_value(name) AS name, count(*) AS n, count_if(coalesce(calle, '') <> '') AS d, count_if(coalesce(cca_code, '') <> '') AS c, CAST(sum(uf_vivienda + uf_comercio) AS BIGINT) AS uf, round(sum(area_m2_terreno), 2) AS area FROM p GROUP BY survey_id),
    h AS (SELECT survey_id, unnest(['REPORTE DE RELEVAMIENTO CATASTRAL', concat('Región;', name), concat('Survey ID;', survey_id), 'Fecha;05/03/2024 14:07', concat('Total parcelas;', n), concat('Con dirección;', d), concat('Con UF;', n), concat('Con nomenclatura;', c), concat('Total UF;', uf),
      concat('Área total relevada (m²);', CASE WHEN area <> 0 THEN format('{:,.1f}', area) ELSE '-' END), '', 'N°;Dirección;Área m²;UF;Nomenclatura Catastral;Partida Inmobiliaria']) AS line FROM t)
    SELECT survey_id, line FROM h UNION ALL
    SELECT survey_id, concat(row_number() OVER w, ';', direccion, ';', CASE WHEN area_m2_terreno <> 0 THEN printf('%.1f', area_m2_terreno) ELSE '-' END, ';', uf_vivienda + uf_comercio, ';', coalesce(cca_code, '-'), ';', parcela_id) FROM p WINDOW w AS (PARTITION BY survey_id ORDER BY calle NULLS LAST, numero NULLS LAST, parcela_id)""",
    "parcelas", "surveys", "regions",
)
def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """Every survey's whole report as a file, read back as lines; the reader takes the mark off."""
    path = _scratch(spark, "reports")
    p = table(spark, d, "parcelas")
    named = table(spark, d, "surveys").join(table(spark, d, "regions"), "region_key").select("survey_id", "name")
    totals = reports.totals(p, ["survey_id"]).join(named, "survey_id")
    rows = reports.report_columns(p.withColumns({"nomenclatura_catastral": F.col("cca_code"), "partida_inmobiliaria": F.col("parcela_id").cast("string")}))
    order = [F.asc_nulls_last("calle"), F.asc_nulls_last("numero"), F.asc("parcela_id")]
    exports.write_csv_reports(rows, path, "survey_id", ["direccion", "area", "uf", "nomenclatura", "partida"], order, heading=reports.HEADING, preamble=reports.preamble(totals, F.lit("2024-03-05 14:07:00").cast("timestamp")))
    return paged.report_lines(p.select("survey_id").where("survey_id IS NOT NULL"), path, "survey_id")


@query(
    """, a AS (SELECT count(*) AS n, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / (count(*) - 1) AS paso, (SELECT count(*) FROM orders) AS total FROM activity_log)
    SELECT printf('%d listos (%.1f %%), %.1f s por id, faltan %.1f min', n, round(n / total, 4) * 100, paso, paso * greatest(total - n, 0) / 60) AS linea FROM a""",
    "activity_log",
)
def status_line(spark: SparkSession, d: str) -> DataFrame:
    """How many of the orders the log has entries for, the share, and the time left at its pace."""
    return reports.status_report(sequences.progress(table(spark, d, "activity_log"), _orders(spark, d).count()))


@query("SELECT parcela_id, survey_id, calle, numero, cca_code FROM parcelas", "parcelas")
def migrated_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows written under an old schema and read under the present one: new columns are null, known ones kept."""
    path = _scratch(spark, "migrated")
    old = table(spark, d, "parcelas").select(F.col("parcela_id").cast("string"), F.col("survey_id").cast("string"), "calle", "numero")
    exports.append(old.where("pmod(hash(parcela_id), 2) = 0"), path)
    exports.append(table(spark, d, "parcelas").select(F.col("parcela_id").cast("string"), F.col("survey_id").cast("string"), "calle", "numero", "cca_code").where("pmod(hash(parcela_id), 2) = 1"), path)
    codes = table(spark, d, "parcelas").select(F.col("parcela_id").cast("string"), F.col("cca_code").alias("code"))
    from ..schemas import TABLES

    now = spark.read.schema(TABLES["parcelas"]).parquet(path).select("parcela_id", "survey_id", "calle", "numero", "cca_code", "validado_manual")
    filled = now.join(codes, "parcela_id").where("validado_manual IS NULL")
    return filled.select(F.col("parcela_id").cast("bigint").alias("parcela_id"), F.col("survey_id").cast("bigint").alias("survey_id"), "calle", "numero", F.coalesce("cca_code", "code").alias("cca_code"))


# Streams, over all that has landed


def _log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The activity log, landed in files of the shared folder, as a stream."""
    path = _scratch(spark, "log")
    table(spark, d, "activity_log").select("id", "ts", "lvl", "survey_id").repartition(4, "id").write.parquet(path)
    return activity.read_log(spark, path, "id bigint, ts timestamp, lvl string, survey_id bigint", files_per_trigger=2)


def _batches(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to the end of what is there; all batches' rows with their number, from the shared folder."""
    spark = stream.sparkSession
    return activity.by_batch(stream, _scratch(spark, "stream"), _scratch(spark, "stream-state"), mode)


@query("SELECT survey_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT survey_id, id, row_number() OVER (PARTITION BY survey_id ORDER BY id DESC) AS k FROM activity_log) WHERE k <= 20 GROUP BY survey_id", "activity_log")
def stream_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 entries of each survey, as the stream's state holds them after its last batch."""
    rows = _batches(activity.ring_buffer(_log_stream(spark, d), 20), "update")
    return rows.groupBy("survey_id").agg(F.max_by("ids", "batch").alias("ids")).select("survey_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT date_trunc('hour', ts) AS start, lvl, count(*) AS n FROM activity_log GROUP BY 1, 2", "activity_log")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Entries by hour and level from the stream; no entry is late here."""
    rows = _batches(activity.activity_windows(_log_stream(spark, d), late="3650 days"), "update")
    return rows.groupBy("start", "lvl").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT id, survey_id FROM activity_log WHERE lvl LIKE 'c%' AND id > 500", "activity_log")
def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one kind after a client's cursor, each once, though the log repeats some."""
    log = _log_stream(spark, d)
    twice = log.withColumn("copy", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    once = activity.without_repeats(twice, late="3650 days")
    return _batches(sequences.since(activity.only(once, "c", "lvl"), 500), "append").select("id", "survey_id")


@query(
    """, u AS (SELECT survey_id, id AS seq, CASE WHEN value > 99 THEN 'stopped' WHEN lvl = 'click' THEN NULL ELSE lvl END AS status FROM activity_log), k AS (SELECT survey_id FROM activity_log WHERE id % 997 = 0),
    l AS (SELECT survey_id, max(CASE WHEN status = 'stopped' THEN 1 ELSE 0 END) AS s, arg_max(status, CASE WHEN status IS NOT NULL THEN seq END) AS last FROM u GROUP BY survey_id)
    SELECT l.survey_id, CASE WHEN s = 1 OR b.status = 'stopped' OR l.survey_id IN (FROM k) THEN 'stopped' ELSE coalesce(last, b.status) END AS status, CASE WHEN s = 1 OR b.status = 'stopped' OR l.survey_id IN (FROM k) THEN TRUE ELSE coalesce(last, b.status) = 'failed' END AS should_stop
    FROM l LEFT JOIN surveys b ON b.survey_id = l.survey_id""",
    "activity_log", "surveys",
)
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over a stream of updates that starts from the surveys' table, with stops from a control stream: stopped is final, and older updates that come later change nothing."""
    path, control = _scratch(spark, "updates"), _scratch(spark, "control")
    status = F.when(F.col("value") > 99, "stopped").when(F.col("lvl") != "click", F.col("lvl"))
    log = table(spark, d, "activity_log")
    log.select("survey_id", F.col("id").alias("seq"), status.alias("status")).repartition(3, F.hash("id") % 3).write.parquet(path)  # batches hold early and late updates alike
    log.where("id % 997 = 0").select("survey_id").repartition(3).write.parquet(control)  # a batch per file: their number must not grow with the table's
    updates = spark.readStream.schema("survey_id bigint, seq bigint, status string").option("maxFilesPerTrigger", 1).parquet(path)
    stops = spark.readStream.schema("survey_id bigint").option("maxFilesPerTrigger", 1).parquet(control)
    rows = _batches(activity.survey_states(updates, table(spark, d, "surveys"), stops), "update")
    return rows.groupBy("survey_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("should_stop", "batch").alias("should_stop"))


@query("SELECT id FROM activity_log WHERE id % 3 > 0", "activity_log")
def resumed_work(spark: SparkSession, d: str) -> DataFrame:
    """Ids still to do: those without a report file over 1000 bytes and not among the results."""
    ids = table(spark, d, "activity_log").select("id")
    files = ids.where("id % 3 = 0").select(F.concat(F.lit("/out/reporte_"), F.col("id"), F.lit(".pdf")).alias("path"), F.when(F.col("id") % 6 == 0, 5000).otherwise(10).alias("length"))
    done = feeds.processed_ids(ids.where("id % 6 = 3"), files)
    return ids.join(done, "id", "left_anti")


@query("SELECT survey_id, CASE WHEN status = 'running' THEN 'partial' ELSE status END AS status FROM surveys", "surveys")
def step_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Running surveys end as partial when their zone is done."""
    s = table(spark, d, "surveys")
    done = s.where("status = 'running'").select("survey_id", R.zone_outcome(F.lit(True)).alias("status"))
    return surveys.set_status(s, done, F.lit("2024-01-01").cast("timestamp")).select("survey_id", "status")
