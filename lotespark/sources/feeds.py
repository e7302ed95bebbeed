"""Readers of landed payloads: raw files or text columns to typed rows.

Each reader takes files that an acquisition job has landed (GeoJSON, ArcGIS and
Overpass JSON, census tables, extracted report text) and gives DataFrames.
Malformed documents give no rows instead of an error.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import strings as S
from ..operators import planar
from ..runtime import forget, stored
from . import paged

FEATURE = "properties map<string,string>, attributes map<string,string>, geometry string"

#: Names under which feeds carry a field, in order of preference.
ALIASES = {
    "nomenclatura": ("VINCULACIO", "VINCULACION", "NOMENCLATURA"),
    "catastro": ("CATASTRO", "MATRICULA"),
    "localidad": ("LOCALID", "LOCALIDAD"),
    "departamento": ("DEPARTA", "DEPARTAMENTO"),
    "numero": ("NROPUERTA", "NUMERO"),
}
FACE_ALIASES = {
    "logradouro_id": ("CD_FACE", "ID_FACE"),
    "tipo_logradouro": ("NM_TIP_LOG",),
    "titulo_logradouro": ("NM_TIT_LOG",),
    "nome_logradouro": ("NM_LOG", "NOME_LOG"),
    "setor_id": ("CD_SETOR", "CD_GEO"),
}


def documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as rows of path and text; a page per file is one row each."""
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pages(spark: SparkSession, path: str, batch: int = paged.BATCH, member: str = "features") -> DataFrame:
    """pos and text of every feature of a landed paged feed; missing pages are an error (sources.paged)."""
    paged.register(spark)
    return spark.read.format("pages").options(path=path, batch=batch, features=member).load()


def land_pages(docs: DataFrame, path: str) -> None:
    """Pages (start, text) as a landed feed: a folder per page, and the manifest."""
    docs.select("start", F.col("text").alias("value")).repartition("start").write.partitionBy("start").text(path)
    store, at = paged.store_of(path)
    landed = docs.sparkSession.read.text(path).select("start", "_metadata.file_path").distinct().orderBy("start").toLocalIterator()
    with store.open_output_stream(f"{at}/manifest.jsonl") as f:
        for r in landed:
            f.write((json.dumps({"start": r.start, "file": "/".join(unquote(r.file_path).rsplit("/", 2)[1:])}) + "\n").encode())


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Features of GeoJSON collections, single features, bare geometries and ArcGIS pages: position, properties, geometry text. A document is parsed once."""
    body = F.col(text)
    docs_ = F.col("_docs")
    first = F.get(docs_, F.lit(0))
    kind = F.coalesce(first["type"], F.get_json_object(body, "$.type"))
    whole = F.coalesce(first["features"], F.from_json(F.when(docs_.isNull(), body), f"features array<struct<{FEATURE}>>")["features"])
    single = F.transform(docs_, lambda d: F.struct(d["properties"].alias("properties"), d["attributes"].alias("attributes"), d["geometry"].alias("geometry")))
    bare = F.array(F.struct(F.create_map().cast("map<string,string>").alias("properties"), F.create_map().cast("map<string,string>").alias("attributes"), body.alias("geometry")))
    found = F.when(whole.isNotNull(), whole).when(kind == "Feature", single).when(kind.isin("Polygon", "MultiPolygon", "LineString", "Point"), bare)
    rest = [c for c in docs.columns if c != text]
    # within an array a text with anything after its end is malformed
    parsed = F.from_json(F.concat(F.lit('{"docs":['), body, F.lit("]}")), f"docs array<struct<type string, {FEATURE}, features array<struct<{FEATURE}>>>>", {"allowNonNumericNumbers": "false"})
    rows = docs.withColumn("_docs", parsed["docs"]).select(*rest, F.posexplode(found).alias("pos", "f"))
    return rows.select(*rest, "pos", F.coalesce("f.properties", "f.attributes").alias("properties"), F.col("f.geometry").alias("geometry"))


def field(properties: str, name: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    return S.first_filled(*[F.col(properties)[a] for a in aliases[name]])


def parcel_features(docs: DataFrame, utm_zone: int = 20) -> DataFrame:
    """Parcels of a cadastral feed: typed fields, polygon, centroid and area; `problem` names what kept a geometry out.

    Geometries whose rings cross, overlap or run back are repaired; of several polygons the
    largest stays. Only what has no area at all is an invalid geometry.
    """
    # each corner has a bracket in the text, but for a point's disc: few other documents are parsed again in search of large shapes
    text = F.col("text")
    wide = F.coalesce((F.size(F.split(text, r"\[")) > SMALL_CORNERS) | F.contains(text, F.lit("Point")) | F.contains(text, F.lit(r"\u")), F.lit(False))
    rows = features(docs.withColumn("_wide", wide)).withColumn("polygons", G.from_geojson(F.col("geometry")))
    rows = largest_valid(rows, "polygons", "polygon", "centroid", F.col("_wide"))
    problem = F.when(F.col("geometry").isNull(), "no_geometry").when(F.col("polygon").isNull(), "invalid_geometry")
    return rows.select(
        *[x for x in docs.columns if x != "text"], "pos", field("properties", "nomenclatura").alias("nomenclatura"), field("properties", "catastro").alias("catastro"),
        S.department(field("properties", "departamento")).alias("departamento"), S.first_number(*[F.col("properties")[a] for a in ALIASES["numero"]]).alias("numero"),
        "polygon", F.col("centroid.x").alias("lng"), F.col("centroid.y").alias("lat"), G.area_utm_m2(F.col("polygon"), utm_zone).alias("area_m2"), problem.alias("problem"),
    )


#: Corners up to which a shape is judged and repaired within its row, and up to which it is judged there; the work of both grows with the square of the corners, that of the graph with the corners.
SMALL_CORNERS, FEW_CORNERS = 24, 1000


def largest_valid(rows: DataFrame, polygons: str, name: str, place: str, wide: Column | None = None) -> DataFrame:
    """rows with the largest polygon of each row's array and its centroid; rows with a broken one are repaired as a whole first, small ones in place and others apart, as a graph. Only rows that are `wide` are looked through for large ones (all if not given)."""
    p = F.col(polygons)
    corners = F.coalesce(F.aggregate(p, F.lit(0), lambda n, q: n + F.coalesce(F.size(F.flatten(q)), F.lit(0))), F.lit(0))
    big = (F.lit(True) if wide is None else wide) & (corners > SMALL_CORNERS)
    small = lambda df: planar.largest_valid(df, polygons, "_best").withColumns({name: F.col("_best.polygon"), place: F.struct("_best.x", "_best.y")}).drop("_best")
    sound = F.coalesce(F.forall("_clean", lambda q: q.isNotNull()), F.lit(False))
    large = stored(rows.where(big).withColumns({"_row": F.monotonically_increasing_id(), "_clean": F.when((F.size(p) > 0) & (corners <= FEW_CORNERS), F.transform(p, G.repaired))}), "shapes")
    if large.isEmpty():
        forget(large)
        return small(rows)
    bad = large.where(~sound).select("_row", polygons)
    whole = F.when(sound, F.col("_clean"))
    if not bad.isEmpty():
        large = large.join(planar.repair(bad, "_row", polygons).withColumnRenamed("polygons", "_repaired"), "_row", "left")
        whole = F.coalesce(whole, F.col("_repaired"))
    large = large.withColumn(name, F.when(F.size(whole) > 0, G.largest(whole))).drop("_row", "_clean", "_repaired")
    return small(rows.where(~big)).unionByName(large.withColumn(place, G.centroid(F.col(name))))


def zones(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, polygons): the area of all geometries (JSON texts) of a key, inner borders dissolved.

    Polygons are repaired, a line is closed, several lines give the areas that they
    enclose, a point is a disc. What has no area adds nothing.
    """
    shape = stored(rows.select(key, F.monotonically_increasing_id().alias("_row"), G.from_geojson(F.col(geometry)).alias("_multi"), G.lines_from_geojson(F.col(geometry)).alias("_lines")), "zone-shapes")
    areas = shape.where("_multi IS NOT NULL").select(key, "_row", "_multi")
    lines = shape.where("_lines IS NOT NULL")
    if not lines.isEmpty():
        enclosed = planar.polygonize(lines, "_row", "_lines").withColumnRenamed("polygons", "_multi")
        areas = areas.unionByName(lines.select(key, "_row").join(enclosed.hint("merge"), "_row"))
    return planar.union(areas, key, "_row", "_multi")


def parcels_by_code(docs: DataFrame, prefix: str) -> DataFrame:
    """Parcels of a provincial feed whose 42-character code has the prefix, at their vertex mean."""
    rows = features(docs).select("pos", F.col("properties")["cca"].alias("cca"), F.col("properties")["pda"].alias("pda"), G.from_geojson(F.col("geometry"))[0].alias("polygon"))
    mean = G.vertex_mean(F.col("polygon")[0])
    return rows.where(F.col("cca").startswith(prefix)).select("*", mean["x"].alias("lng"), mean["y"].alias("lat"), S.parcel_number(F.col("cca")).alias("numero"), S.parcel_suffix(F.col("cca")).alias("sufijo"))


def lots(docs: DataFrame) -> DataFrame:
    """Lots with key-value field groups and GeoJSON in a string; bad geometry gives place (0, 0)."""
    kind = "id int, inscricao string, geoJson string, unidadesCount int, fieldItemGroups array<struct<fieldItems: array<struct<name:string,label:string,value:string>>>>"
    rows = docs.select(F.from_json("text", kind).alias("d")).select("d.*")
    items = F.flatten(F.transform("fieldItemGroups", lambda g: g["fieldItems"]))
    value = lambda name: F.get(F.filter(items, lambda f: (f["name"] == name) | (f["label"] == name)), 0)["value"]
    polygon = F.get(G.from_geojson(F.col("geoJson")), 0)
    mean = G.vertex_mean(F.get(polygon, 0))
    code = S.inscription(F.col("inscricao"))
    return rows.select(
        "id", "inscricao", code["block"].alias("quadra"), code["lot"].alias("lote"), F.coalesce(value("Código").try_cast("bigint"), code["code"]).alias("codigo"), S.dotted_decimal(value("Área")).alias("area"),
        S.postal_code(value("CEP")).alias("cep"), F.col("unidadesCount").alias("unidades"), F.coalesce(mean["y"], F.lit(0.0)).alias("lat"), F.coalesce(mean["x"], F.lit(0.0)).alias("lng"), polygon.alias("polygon"),
    )


OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def osm_elements(docs: DataFrame) -> DataFrame:
    """Elements of Overpass documents, of repeated type and id the first."""
    rows = docs.select(F.posexplode(F.from_json("text", OSM)["elements"]).alias("pos", "e")).select("pos", "e.*")
    rest = [c for c in rows.columns if c not in ("type", "id")]
    return rows.groupBy("type", "id").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("type", "id", "r.*")


def osm_buildings(elements: DataFrame, utm_zone: int = 21) -> DataFrame:
    """Ways with at least four known nodes as polygons, nodes in the way's order, unknown ones left out."""
    ways = elements.where("type = 'way'").select(F.col("id").alias("way"), "tags", F.posexplode("nodes").alias("npos", "node"))
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = F.array_sort(F.collect_list(F.struct("npos", "x", "y")))
    rings = ways.join(nodes, "node").groupBy("way").agg(at.alias("at"), F.first("tags").alias("tags")).where(F.size("at") >= 4)
    ring = rings.withColumn("ring", F.transform("at", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    c = G.centroid(F.array(F.col("ring")))
    return ring.select(F.col("way").cast("string").alias("external_id"), F.array("ring").alias("footprint"), c["x"].alias("lng"), c["y"].alias("lat"), G.area_utm_m2(F.array(F.col("ring")), utm_zone).alias("area_m2"), S.tag_address(F.col("tags")).alias("direccion"), F.try_element_at("tags", F.lit("building:levels")).try_cast("int").alias("pisos"))


def sidra(docs: DataFrame) -> DataFrame:
    """Census table rows: the first record holds the headings; columns are found by words in them."""
    rows = docs.select(F.posexplode(F.from_json("text", "array<map<string,string>>")).alias("pos", "r"))
    head = rows.where("pos = 0").select(F.col("r").alias("h"))
    named = lambda *words: F.get(F.filter(F.map_entries("h"), lambda e: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(e["value"]), w))), 0)["key"]
    body = rows.where("pos > 0").join(F.broadcast(head.limit(1)))
    return body.select(F.col("r")[named("setor")].alias("setor"), S.census_count(F.col("r")[F.lit("V")]).alias("valor"), F.col("r")[named("tipo")].alias("tipo"))


def dwellings(rows: DataFrame) -> DataFrame:
    """Dwellings by sector: all rows, houses (not in closed streets) and flats."""
    kind = F.lower("tipo")
    return rows.groupBy("setor").agg(
        F.sum("valor").alias("domicilios_total"), F.sum(F.when(kind.contains("casa") & ~kind.contains("vila"), F.col("valor")).otherwise(0)).alias("domicilios_casas"), F.sum(F.when(kind.contains("apart") | kind.contains("apto"), F.col("valor")).otherwise(0)).alias("domicilios_aptos")
    )


def census_sectors(frame: DataFrame, municipality: str) -> DataFrame:
    """Sectors of one municipality; without any column to tell, all sectors."""
    code, pop, town = S.pick_column(frame.columns, ("CD_SETOR", "CD_GEOCODI")), S.pick_column(frame.columns, ("POP", "POP_2022", "V0001")), S.pick_column(frame.columns, ("CD_MUN", "CD_GEOCODM"))
    out = frame
    if town:
        out = out.where(F.col(town).cast("string").startswith(municipality))
    elif code:
        out = out.where(F.col(code).cast("string").startswith(municipality))
    return out.select(S.sector_code(F.col(code).cast("string")).alias("setor_id"), (S.safe_count(F.col(pop).cast("string")) if pop else F.lit(None).cast("bigint")).alias("pop_total"), *[c for c in frame.columns if c == "geometry"])


def street_faces(frame: DataFrame, index: str) -> DataFrame:
    """Typed street faces; a blank code is made from sector and row index; rows without geometry go."""
    col = lambda name: F.col(c) if (c := S.pick_column(frame.columns, FACE_ALIASES[name])) else F.lit(None).cast("string")
    number = lambda c: S.safe_count(F.col(x)) if (x := S.pick_column(frame.columns, (c,))) else F.lit(None).cast("bigint")
    sector = S.sector_code(col("setor_id"))
    out = frame.where(F.col("geometry").isNotNull() & (F.size("geometry") > 0)) if "geometry" in frame.columns else frame
    return out.select(
        S.face_id(col("logradouro_id"), sector, F.col(index)).alias("logradouro_id"), sector.alias("setor_id"), S.safe_text(col("tipo_logradouro"), 50).alias("tipo_logradouro"), S.safe_text(col("titulo_logradouro"), 50).alias("titulo_logradouro"),
        S.safe_text(col("nome_logradouro"), 200).alias("nome_logradouro"), number("NUM_INI_E").alias("nro_inicial_esq"), number("NUM_FIM_E").alias("nro_final_esq"), number("NUM_INI_D").alias("nro_inicial_dir"), number("NUM_FIM_D").alias("nro_final_dir"),
        *[c for c in out.columns if c == "geometry"],
    )


def getinfo(docs: DataFrame, key: str) -> DataFrame:
    """Address, nomenclature and sub-parcels (in order of their numeric key) from blocks told apart by words in their titles."""
    row = "struct<clave:string,valor:string,partida:string,s_terreno:string,sp:string>"
    blocks = F.from_json("text", f"data array<struct<title:string,data:struct<table:map<string,{row}>>>>")["data"]
    table = lambda *words: F.get(F.filter(blocks, lambda b: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(b["title"]), w))), 0)["data"]["table"]
    by_number = lambda t: F.transform(F.array_sort(F.transform(F.map_entries(t), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    first = lambda t, word: F.get(F.filter(by_number(t), lambda r: F.contains(F.lower(r["clave"]), F.lit(word))), 0)["valor"]
    subs = F.transform(F.coalesce(by_number(table("subparcela", "sub parcela")), F.array().cast(f"array<{row}>")), lambda r: F.struct(r["partida"].alias("partida"), S.money(r["s_terreno"]).alias("s_m2"), r["sp"].alias("sp")))
    return docs.select(key, first(table("domicilio", "direcc"), "calle").alias("direccion"), first(table("nomenclatura"), "nomenclatura").alias("nomenclatura"), subs.alias("subparcelas"))


def place_name(address: str) -> Column:
    """A place's name from a geocoder's address struct: city, town, village, suburb, neighbourhood."""
    a = F.col(address)
    return F.coalesce(*[S.blank_to_null(a[k]) for k in ("city", "town", "village", "suburb", "neighbourhood")], F.lit("Desconocida"))


def zone_name(address: str, lat: str, lng: str) -> Column:
    a = F.col(address)
    return F.coalesce(*[S.blank_to_null(a[k]) for k in ("city", "town", "municipality", "county")], F.when(a.isNotNull(), "zona").otherwise(F.format_string("zona %.4f %.4f", F.col(lat), F.col(lng))))


def coordinate_bounds(text: Column) -> Column:
    """Least and greatest coordinates anywhere in a GeoJSON text, whatever its depth."""
    pairs = F.regexp_extract_all(text, F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*-?[\d.eE+-]+"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(r"\[\s*-?[\d.eE+-]+\s*,\s*(-?[\d.eE+-]+)"), F.lit(1))
    xs, ys = F.transform(pairs, lambda s: s.try_cast("double")), F.transform(second, lambda s: s.try_cast("double"))
    return F.struct(F.array_min(ys).alias("south"), F.array_min(xs).alias("west"), F.array_max(ys).alias("north"), F.array_max(xs).alias("east"))


def scalars(df: DataFrame, json: str, levels: int = 5) -> DataFrame:
    """All scalar leaves of JSON documents to a depth, with their paths."""
    ids = [c for c in df.columns if c != json]
    level = df.select(*ids, F.lit("$").alias("path"), F.try_parse_json(json).alias("v"))
    out = None
    for _ in range(levels):
        kids = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*ids, F.concat_ws(".", "path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v"))
        leaf = ~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        done = kids.where(leaf).select(*ids, "path", F.try_variant_get("v", "$", "string").alias("value"))
        out = done if out is None else out.union(done)
        level = kids.where(~leaf)
    return out


def source_of(lat: Column, lng: Column, asked: Column, south: float, west: float, north: float, east: float) -> Column:
    """Which cadastral source serves a place: as asked, or the capital's inside its box."""
    return F.coalesce(asked, F.when(G.in_bbox(lat, lng, F.lit(south), F.lit(west), F.lit(north), F.lit(east)), "capital").otherwise("provincia"))


def with_defaults(config: dict, defaults: dict) -> dict:
    return {k: with_defaults(config.get(k) or {}, v) if isinstance(v, dict) else config.get(k, v) for k, v in defaults.items()} | {k: v for k, v in config.items() if k not in defaults}


def processed_ids(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Ids done: those in a table of results and those with a report file of more than 1000 bytes (path, length)."""
    named = files.where("length > 1000").select(F.regexp_extract("path", r"reporte_(\d+)\.pdf$", 1).try_cast("bigint").alias("id")).where("id IS NOT NULL")
    return rows.select(F.col("id").cast("bigint")).union(named).distinct()


def first_list(text: Column, keys: tuple[str, ...] = ("data", "items", "accounts", "results")) -> Column:
    """The first of the named members that holds a list, as an array of JSON texts; a bare list counts too."""
    lists = [F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>") for k in keys]
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>"), *lists)
