import json

from pyspark.sql import functions as F

from lotespark.functions import geometry as G
from lotespark.operators import classify, estimate, merge, sequences, spatial, surveys
from lotespark.sources import exports, feeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_rules_and_idempotence(spark):
    t = spark.createDataFrame([(1, "a", 5, "x"), (2, None, 7, "y")], "k int, s string, n int, keep string")
    f = spark.createDataFrame([(0, 1, None, 0, "new"), (1, 1, "b", 9, "new"), (2, 1, None, 0, "new"), (3, 3, "c", 0, "z"), (4, None, "d", 1, "w")], "pos int, k int, s string, n int, keep string")
    rules = {"n": "nullif0", "keep": "keep"}
    once = merge.merge(t, f, ["k"], rules, order="pos")
    assert rows(once) == sorted([(1, "b", 9, "x"), (2, None, 7, "y"), (3, "c", None, "z"), (None, "d", 1, "w")], key=str)
    keyed = f.where("k IS NOT NULL")
    a = merge.merge(t, keyed, ["k"], rules, order="pos")
    assert rows(merge.merge(a, keyed, ["k"], rules, order="pos")) == rows(a)
    assert tuple(merge.merge_counts(t, keyed.dropDuplicates(["k"]), ["k"]).first()) == (1, 1)
    assert rows(merge.replace_by_id(t, t.where("k = 1").withColumn("s", F.lit("q")), "k"))[0][1] == "q"


def test_address_updates(spark):
    p = spark.createDataFrame([(1, "A", None), (2, "", "3"), (3, "C", "4")], "parcela_id int, calle string, numero string")
    new = spark.createDataFrame([(1, "X", "9"), (2, "Y", None)], "parcela_id int, calle string, numero string")
    assert rows(merge.update_address(p, new, True)) == [(1, "A", "9"), (2, "Y", "3"), (3, "C", "4")]
    assert rows(merge.update_address(p, new, False)) == [(1, "X", "9"), (2, "Y", "3"), (3, "C", "4")]
    geo = spark.createDataFrame([(1, "G", "7"), (2, "G", "8")], "parcela_id int, calle string, numero string")
    street = spark.createDataFrame([(2, "S", "5")], "parcela_id int, calle string, numero string")
    got = {r.parcela_id: (r.calle, r.numero, r.direccion_source) for r in classify.resolve_addresses(p, street, geo).collect()}
    assert got == {1: ("A", "7", "geocode"), 2: ("S", "5", "logradouros"), 3: ("C", "4", None)}


def test_repeat_rules_differ(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([["a"], [], ["a"], ["b"]])], "g int, i int, v array<string>")
    assert [r.i for r in sequences.drop_repeats_of_last_filled(df, ["g"], "i", "v").orderBy("i").collect()] == [0, 1, 3]
    assert [r.i for r in sequences.drop_repeats_of_previous(df, ["g"], "i", "v").orderBy("i").collect()] == [0, 1, 2, 3]


def test_notes_and_states(spark):
    notes = spark.createDataFrame([('{"paso_actual":"a","pasos":{"a":"1"}}',), ("broken",), (None,)], "n string")
    got = [json.loads(r[0]) for r in notes.select(surveys.merge_notes(F.col("n"), F.lit("b"), F.lit("2"))).collect()]
    assert got == [{"paso_actual": "b", "pasos": {"a": "1", "b": "2"}}, *[{"paso_actual": "b", "pasos": {"b": "2"}}] * 2]
    s = spark.createDataFrame([(1, "running"), (2, "stopped")], "survey_id int, status string")
    u = spark.createDataFrame([(1, 1, "completed"), (1, 2, None), (2, 1, "completed"), (3, 1, "failed")], "survey_id int, seq int, status string")
    assert rows(surveys.fold_states(s, u).select("survey_id", "status", "should_stop")) == [(1, "completed", False), (2, "stopped", True), (3, "not_found", True)]


def test_states_fold_without_lists(spark):
    s = spark.createDataFrame([(1, "running"), (2, "running"), (3, "stopped"), (4, "running")], "survey_id int, status string")
    many = [(1, k, "failed" if k % 3 else None) for k in range(3000)] + [(1, 3000, "completed"), (1, 3001, None)]
    u = spark.createDataFrame([*many, (2, 1, "stopped"), (2, 2, "completed"), (3, 1, None), (4, 5, None), (9, 1, "stopped")], "survey_id int, seq int, status string")
    df = surveys.fold_states(s, u)
    assert rows(df.select("survey_id", "updates", "status")) == [(1, 3002, "completed"), (2, 2, "stopped"), (3, 1, "stopped"), (4, 1, "running"), (9, 1, "not_found")]
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_population_shares_add_up(spark):
    b = spark.createDataFrame([(1, "s", 10.0, 1), (2, "s", 30.0, 3), (3, "t", 0.0, 0), (4, "t", None, None)], "id int, setor_id string, a double, u int")
    z = spark.createDataFrame([("s", 100), ("t", 10)], "setor_id string, pop_total int")
    got = estimate.dasymetric(b, z, {"a": F.col("a"), "u": F.col("u")}).collect()
    assert {r.id: r.habitantes_estimados for r in got} == {1: 25.0, 2: 75.0, 3: 5.0, 4: 5.0}
    assert all(abs(r.habitantes_confidence - 1) < 1e-9 for r in got)


def test_geojson_feed(spark):
    ring = [[-65.4, -24.8], [-65.399, -24.8], [-65.399, -24.799], [-65.4, -24.799], [-65.4, -24.8]]
    feature = lambda props, geometry: {"type": "Feature", "properties": props, "geometry": geometry}
    poly = {"type": "Polygon", "coordinates": [ring]}
    page = {"type": "FeatureCollection", "features": [feature({"VINCULACIO": "K1", "DEPARTA": "1", "NROPUERTA": "00"}, poly), feature({"CATASTRO": "7"}, None), feature({}, {"type": "MultiPolygon", "coordinates": [[ring]]})]}
    docs = spark.createDataFrame([("p", json.dumps(page)), ("q", json.dumps(poly)), ("r", json.dumps(feature({"CATASTRO": "9"}, poly))), ("bad", "{")], "path string, text string")
    got = {(r.path, r.pos): r for r in feeds.parcel_features(docs).collect()}
    assert set(got) == {("p", 0), ("p", 1), ("p", 2), ("q", 0), ("r", 0)}
    a = got["p", 0]
    assert (a.nomenclatura, a.departamento, a.numero, a.problem) == ("K1", "Capital", None, None) and abs(a.lng + 65.3995) < 1e-9 and 11000 < a.area_m2 < 11500
    assert (got["p", 1].problem, got["p", 2].problem, got["r", 0].catastro) == ("no_geometry", None, "9")
    b = docs.where("path = 'p'").select(feeds.coordinate_bounds(F.col("text")).alias("b")).first().b
    assert (b.south, b.west, b.north, b.east) == (-24.8, -65.4, -24.799, -65.399)


def test_osm_and_census_feeds(spark):
    nodes = [{"type": "node", "id": i, "lat": y, "lon": x} for i, (x, y) in enumerate([(-56.0, -15.0), (-55.999, -15.0), (-55.999, -14.999), (-56.0, -14.999)])]
    ways = [{"type": "way", "id": 10, "nodes": [0, 1, 2, 3, 0], "tags": {"addr:street": "Rua A", "addr:housenumber": "5", "building:levels": "3"}}, {"type": "way", "id": 11, "nodes": [0, 1, 99], "tags": {}}]
    docs = spark.createDataFrame([(json.dumps({"elements": [*nodes, *ways, ways[0]]}),)], "text string")
    (b,) = feeds.osm_buildings(feeds.osm_elements(docs)).collect()
    assert (b.external_id, b.direccion, b.pisos) == ("10", "Rua A 5", 3) and abs(b.lng + 55.9995) < 1e-9
    table = [{"D1C": "Setor (Código)", "V": "Valor", "D2N": "Tipo de domicílio"}, {"D1C": "1", "V": "1.200", "D2N": "Casa"}, {"D1C": "1", "V": "30", "D2N": "Casa de vila"}, {"D1C": "1", "V": "...", "D2N": "Apartamento"}, {"D1C": "2", "V": "8", "D2N": "Apartamento"}]
    got = feeds.dwellings(feeds.sidra(spark.createDataFrame([(json.dumps(table),)], "text string")))
    assert rows(got) == [("1", 1230, 1200, 0), ("2", 8, 0, 8)]
    sectors = spark.createDataFrame([("5108402P", "10", "51084"), ("33", "x", "33")], "CD_SETOR string, POP string, CD_MUN string")
    assert rows(feeds.census_sectors(sectors, "510")) == [("5108402", 10)]
    faces = spark.createDataFrame([("F1", "RUA", "nan", "A", "1", "1,099"), (" ", "AV", None, "B", "0", None)], "CD_FACE string, NM_TIP_LOG string, NM_TIT_LOG string, NM_LOG string, NUM_INI_E string, NUM_FIM_E string").withColumn("i", F.lit(4))
    assert [(r.logradouro_id, r.titulo_logradouro, r.nro_inicial_esq, r.nro_final_esq) for r in feeds.street_faces(faces, "i").orderBy("logradouro_id").collect()] == [("F1", None, 1, 1099), ("X_4", None, None, None)]


def test_lot_and_block_feeds(spark):
    lot = {"id": 5, "inscricao": "401-13-1#100994", "geoJson": json.dumps({"type": "Point", "coordinates": [1.0, 2.0]}), "unidadesCount": 2, "fieldItemGroups": [{"fieldItems": [{"name": "Área", "label": "", "value": "1.234,5"}, {"name": "CEP", "label": "", "value": "78.110-000"}]}]}
    (r,) = feeds.lots(spark.createDataFrame([(json.dumps(lot),)], "text string")).collect()
    assert (r.quadra, r.lote, r.codigo, r.area, r.cep, r.unidades) == (13, 1, 100994, 1234.5, "78110000", 2)
    info = {"data": [{"title": "Nomenclatura", "data": {"table": {"0": {"clave": "Nomenclatura", "valor": "Parcela: 12"}}}}, {"title": "Subparcelas", "data": {"table": {"10": {"partida": "b", "s_terreno": "30.5"}, "2": {"partida": "a", "s_terreno": "10"}}}}]}
    (g,) = feeds.getinfo(spark.createDataFrame([(1, json.dumps(info))], "id int, text string"), "id").collect()
    assert g.nomenclatura == "Parcela: 12" and [(s.partida, s.s_m2) for s in g.subparcelas] == [("a", 10.0), ("b", 30.5)]
    leaves = feeds.scalars(spark.createDataFrame([(1, '{"a":{"b":[1,"x"]},"c":true}')], "id int, j string"), "j")
    assert rows(leaves.select("path", "value")) == [("$.a.b.0", "1"), ("$.a.b.1", "x"), ("$.c", "true")]


def test_csv_report_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "B", "2"), (1, "A;x", '3"'), (1, None, "1")], "survey_id int, calle string, numero string")
    exports.write_csv_reports(df, str(tmp_path), "survey_id", ["calle", "numero"], [F.asc_nulls_last("calle")], preamble=spark.createDataFrame([(1, ["Informe"]), (2, ["no rows"])], "survey_id int, lines array<string>"))
    assert [p.name for p in tmp_path.iterdir()] == ["relevamiento_1.csv"]
    assert (tmp_path / "relevamiento_1.csv").read_bytes() == '﻿Informe\r\n\r\nN;calle;numero\r\n1;"A;x";"3"""\r\n2;B;2\r\n3;;1\r\n'.encode()
    square = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])], "id int, p array<array<struct<x:double,y:double>>>")
    feature = json.loads(exports.geojson_features(square, "p", ["id"]).first().value)
    assert feature["properties"] == {"id": 1} and feature["geometry"]["coordinates"][0][1] == [1.0, 0.0]


def test_lookup_classifiers(spark):
    p = spark.createDataFrame([(1, "a", None, "C1"), (2, "b", "vacante", "C2"), (3, "z", None, "C3")], "parcela_id int, nomenclatura string, uso_principal string, cca_code string")
    reg = spark.createDataFrame([(0, "a", "URBANO"), (1, "a", "RURAL"), (2, "b", "URBANO")], "pos int, vinculacion string, tipo string")
    assert rows(classify.classify_registry(p, reg)) == sorted([(1, "RURAL", "vacante"), (2, "URBANO", "residencial"), (3, None, None)], key=str)
    val = spark.createDataFrame([("C1", "0.00", "15,673.60"), ("C2", "9.00", "1")], "cca_code string, valor_edificado string, valor_terreno string")
    assert rows(classify.classify_valuation(p, val)) == [(1, "vacante"), (3, "sin_match")]
    comp = spark.createDataFrame([(1, 0, "5", ["street_number"]), (1, 1, "Rua A", ["route"]), (1, 2, "Rua B", ["route", "x"])], "id int, pos int, long_name string, types array<string>")
    assert rows(classify.geocode_fields(comp, "id", {"calle": "route", "numero": "street_number"})) == [(1, "Rua A", "5")]


def test_small_rules(spark):
    import datetime

    from lotespark.functions import rules

    s = spark.createDataFrame([(1, "running", None), (2, "failed", None)], "survey_id int, status string, finished_at timestamp")
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert rows(surveys.set_status(s, spark.createDataFrame([(1, "running")], "survey_id int, status string"), now)) == [(1, "running", datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, "failed", None)]
    assert spark.range(1).select(rules.times(now).alias("t")).first().t.report == "02/01/2024 03:04"
    t = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "k int, o int, f string, i string")
    assert rows(sequences.group_lists(t, ["k"], "o", ["f"], "i")) == [(1, "a", ["x", "y"])]
    assert rows(sequences.correct(t.select("o", "f"), spark.createDataFrame([(1, "z")], "o int, f string"), "o")) == [(0, "a"), (1, "z")]
    p = spark.createDataFrame([(1, [(3, "A", "depto")]), (2, None)], "parcela_id int, units array<struct<piso:int,depto:string,tipo:string>>")
    assert rows(classify.dwelling_rows(p)) == [(1, 3, "A", "depto"), (2, 0, "", "casa")]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id int, lat double, lng double")
    recs = spark.createDataFrame([(1, 0.001, 0.001, "b"), (0, 0.002, 0.0, "a")], "pos int, lat double, lng double, name string")
    assert {r.id: r.name for r in classify.identify(pts, recs, "id").collect()} == {1: "a", 2: None}
    j = spark.createDataFrame([('{"items":[{"a":1}]}',), ("[1,2]",), ("{}",)], "t string")
    assert [r[0] for r in j.select(feeds.first_list(F.col("t"))).collect()] == [['{"a":1}'], ["1", "2"], None]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_polygon_joins_are_shuffled(spark):
    """Both sides of a join by cells are dealt over the tasks: Spark takes exploded rows for as few as those they are made from."""
    s = spark.range(50).select("id", (F.col("id") * 3.0).alias("x"))
    left = s.select("id", G.rectangle(F.col("x"), F.lit(0.0), F.col("x") + 2, F.lit(2.0)).alias("p"))
    right = s.select(F.col("id").alias("k"), G.rectangle(F.col("x") - 1, F.lit(-1.0), F.col("x") + 2, F.lit(2.0)).alias("q"))
    got = spatial.spatial_join(left, right, "within", "p", "q", 2.0, "id", "k")
    assert rows(got) == sorted([(i, i) for i in range(50)], key=str)
    assert "SortMergeJoin" in _plan(got) and "Broadcast" not in _plan(got)


def test_band_join_is_shuffled(spark):
    """All pairs within the band, at cells' borders too, and no side of exploded rows goes through the driver."""
    band = 5e-5
    p = spark.range(400).select((F.col("id") % 3).alias("g"), "id", (F.lit(-15.7) + (F.col("id") % 20) * 2.4e-5).alias("lat"), (F.lit(-56.2) + F.floor(F.col("id") / 20) * 2.5e-5).alias("lng"))
    got = spatial.band_join(p, p, band, ["g"])
    all_ = p.collect()
    assert rows(got.select("id", "id_r")) == sorted([(a.id, b.id) for a in all_ for b in all_ if a.g == b.g and abs(a.lat - b.lat) < band and abs(a.lng - b.lng) < band], key=str)
    assert "SortMergeJoin" in _plan(got) and "Broadcast" not in _plan(got)
