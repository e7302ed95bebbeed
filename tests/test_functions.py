import uuid

from pyspark.sql import functions as F

from lotespark.functions import bci, rules, strings, units


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


def test_numbers_in_text(spark):
    assert one(spark, strings.money(lit("15,673.60")), strings.money(lit("0.00")), strings.money(lit(None)), strings.dotted_decimal(lit("1.234,5"))) == (15673.6, 0.0, None, 1234.5)
    assert one(spark, *[strings.safe_count(lit(v)) for v in ("1,200", "3.9", "0", "-2", "x", None)]) == (1200, 3, None, None, None, None)
    assert one(spark, *[strings.census_count(lit(v)) for v in ("1.234", "", "x", None)]) == (1234, 0, 0, 0)
    assert one(spark, *[strings.whole_code(lit(v)) for v in (" 30011 ", "3a", None)]) == (30011, None, None)


def test_codes(spark):
    code = "136020C" + "0" * 21 + "0159"
    assert one(spark, strings.parcel_prefix(lit("136"), lit("2"), lit("c"), lit("159")), strings.zero_filled(lit(30011), 15), strings.zero_filled(lit("1" * 16), 15)) == (code, "000000000030011", "1" * 16)
    full = code + "0000012" + "00A"
    assert one(spark, strings.parcel_number(lit(full)), strings.parcel_number(lit("12")), strings.parcel_suffix(lit(full)), strings.parcel_suffix(lit(code + "0000012" + "0A0"), both_ends=True)) == ("12", "", "A", "A")
    got = one(spark, strings.inscription(lit("401-13-1#100994")))[0]
    assert (got.block, got.lot, got.code) == (13, 1, 100994)
    assert one(spark, strings.sector_code(lit("5108402P")), strings.face_id(lit(" "), lit(None), lit(7)), strings.face_id(lit("F1"), lit("S"), lit(7))) == ("5108402", "X_7", "F1")


def test_names(spark):
    assert one(spark, strings.slug(lit("Ñandú Várzea")), strings.slug(lit("ñandú várzea"), fold_enye=False), strings.region_id(lit("Água Boa"), "br")) == ("nandu-varzea", "andu-varzea", "zona-agua-boa-br")
    assert one(spark, *[strings.department(lit(v)) for v in ("1", "23", None, "99")]) == ("Capital", "Rivadavia", "Salta", "Departamento 99")
    assert one(spark, strings.first_filled(lit(" "), lit(None), lit("a ")), strings.first_number(lit("00"), lit(None)), strings.first_number(lit("00"), lit("012"))) == ("a", None, "012")
    assert one(spark, strings.joined(lit("Rua"), lit(""), lit("A")), strings.joined(lit(""), lit(None)), strings.display_address(lit("Rua"), lit("")), strings.display_address(lit(""), lit("3"))) == ("Rua A", None, "Rua", "(sin dirección)")
    assert one(spark, *[strings.safe_text(lit(v), 3) for v in (" abcd ", "NaN", "none", "", None)]) == ("abc", None, None, None, None)
    assert strings.pick_column(["a", "CD_mun"], ["CD_GEOCODM", "CD_MUN"]) == "CD_mun" and strings.pick_column(["a"], ["b"]) is None
    b = one(spark, strings.wkt_bbox(lit("POLYGON((-65.5 -24.9, -65.3 -24.9, -65.3 -24.7, -65.5 -24.7, -65.5 -24.9))")))[0]
    assert (b.south, b.west, b.north, b.east) == (-24.9, -65.5, -24.7, -65.3)


def test_rules(spark):
    use = lambda v, c, p: rules.final_use(lit(v), lit(c), lit(p))
    assert one(spark, use(1, 0, 2), use(0, 0, 0), use(2, 1, 0), use(0, 3, -1), use(2, 0, -1)) == ("mixto", "sin_datos", "mixto", "comercial", "residencial")
    d = lambda v: lit(v).cast("double")
    assert one(spark, rules.vacancy(d(0.5), d(None)), rules.vacancy(d(None), d(None)), rules.vacancy(d(None), d(3.0)), rules.vacancy(d(9.0), d(1.0))) == ("vacante", "sin_match", "edificado", "edificado")
    assert one(spark, rules.interpolated(lit(1), lit(101), lit(0.235)), rules.interpolated(lit(0), lit(9), lit(0.5)), rules.house_number((d(None), lit(9)), (lit(2), lit(4)), lit(0.5))) == (24, None, 3)
    assert one(spark, rules.least_units(lit("residencial"), lit(None).cast("int")), rules.least_units(lit("vacante"), lit(4)), rules.least_units(lit("mixto"), lit(4))) == (1, 0, 4)
    assert one(spark, rules.carto_units(lit(-1), lit(0)), rules.carto_units(lit(0), lit(2)), rules.carto_units(lit(5), lit(2))) == (None, 1, 5)
    types = lambda *t: F.array(*map(F.lit, t))
    assert one(spark, rules.is_commercial(types("bar", "premise")), rules.is_commercial(types("premise")), rules.is_commercial(types("park"))) == (True, False, False)
    assert one(spark, rules.district_use(lit("M1_Este")), rules.district_use(lit("?"))) == ("mixto", "sin_datos")
    code = lambda number, suffix: "0" * 32 + f"{number:07d}" + suffix
    said = [("PARCELA: 5", code(6, "000")), ("Parcela: 7a", code(7, "00A")), ("Parcela: 0012", code(12, "000")), ("x\nparcela:\t12 y", code(12, "000")), ("Parcela: 0", code(0, "000")), (None, code(1, "")), ("Parcela: 9", "short"), ("Lote: 9", code(1, "")), ("Parcela: 12", code(12, "00B")), ("Parcela: 9", None)]
    assert [one(spark, rules.same_parcel(lit(t), lit(c)))[0] for t, c in said] == [False, True, False, True, True, True, True, True, False, True]
    assert one(spark, *[rules.any_other_type(t) for t in (types("premise", "route"), types("point_of_interest"), types("route", "park"), F.array().cast("array<string>"), F.expr("CAST(NULL AS ARRAY<STRING>)"))]) == (False, True, True, False, False)
    assert one(spark, *[rules.frontage(lit(x)) for x in ("12.7", "-3", "x", None)]) == (12, 3, None, None)
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, rules.minutes_between(ts("2024-01-01 00:00:00"), ts(None), ts("2024-01-01 07:21:59")))[0] == 441
    assert one(spark, rules.uuid5(lit("belgrano|2343")))[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "belgrano|2343"))
    assert one(spark, rules.fresh(ts("2024-01-01 00:00:00"), ts("2024-01-01 06:59:59")), rules.fresh(ts("2024-01-01 00:00:00"), ts("2024-01-01 07:00:00"))) == (True, False)


REPORT = """TIPO IMÓVEL CATEGORIA TIPO PROPRIEDADE
PREDIAL PARTICULAR X
CÓDIGO LOGRADOURO NÚMERO CEP
123 RUA DAS FLORES 45 78.110-001
  7 - BAIRRO CENTRO NORTE
QUADRA 3
N° MATRÍCULA FRENTE (M)
0,00 1,00 119.441 0,00
UNIDADE CÓDIGO DA UNIDADE AREA TOTAL
1 55 10,5 80,25
USO RESIDENCIAL TIPOLOGIA CASA
UNIDADE CÓDIGO DA UNIDADE AREA TOTAL
2 56 9,5 70,25
USO COMERCIAL TIPOLOGIA SALA TIPOLOGIA sala TIPOLOGIA CASA
"""


def test_fixed_decimals_are_those_of_the_exact_value(spark):
    import random

    rng = random.Random(6)
    xs = [113834.95, 0.25, 0.75, 0.05, 0.15, -0.25, -12579.25, 0.0, 1e12 + 0.05, 2.5, 0.96, 0.999, 9.95] + [round(rng.uniform(-1e5, 1e5), 2) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", *[strings.fixed(F.col("x"), p).alias(f"p{p}") for p in (0, 1, 6)]).collect()
    assert all((r.p0, r.p1, r.p6) == (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.6f}") for r in got)


def test_property_report(spark):
    got = bci.fields(F.lit(REPORT))
    row = spark.range(1).select(*[v.alias(k) for k, v in got.items()]).first().asDict()
    assert row == {"tipo_imovel": "predial", "uso_principal": "mixto", "uf_vivienda": 1, "uf_comercio": 1, "uf_total": 2, "area_m2_construida": 80.25, "tipologia": "CASA", "codigo_postal": "78110001", "numero": "45", "calle": "RUA DAS FLORES", "barrio": "CENTRO NORTE", "partida_inmobiliaria": "119.441"}
    empty = spark.range(1).select(*[v.alias(k) for k, v in bci.fields(F.lit("nothing")).items()]).first()
    assert (empty.tipo_imovel, empty.uso_principal, empty.uf_total, empty.calle) == (None, "residencial", 0, None)
    rows = lambda t: one(spark, bci.unit_rows(F.lit(t)))[0]
    head = "UNIDADE CODIGO DA UNIDADE"
    assert rows(f"{head} X TOTAL \n\n 1\n22 3,5\n4,25abc") == [["1", "22", "3,5", "4,25"]]
    assert rows(f"{head} A TOTAL\nx\nSUBTOTAL\n1 2 3 4\nTOTAL\n5 6 7 8 {head} a\ntotal\n9 10 11,0 12,0") == [["1", "2", "3", "4"], ["9", "10", "11,0", "12,0"]]
    assert rows(f"TOTAL\n1 2 3 4\n{head}\n{head} TOTAL\n5 6 7 8 {head} TOTAL 1 2 3 4") == [["5", "6", "7", "8"]]
    land = spark.range(1).select(*[v.alias(k) for k, v in bci.fields(F.lit(REPORT.replace("PREDIAL", "TERRITORIAL"))).items()]).first()
    assert (land.uso_principal, land.uf_total, land.area_m2_construida) == ("vacante", 0, None)
    assert one(spark, bci.labelled(F.lit("<td>Bairro:</td><td> Centro </td>"), "Quarteirão", "Bairro"))[0] == "Centro"


def test_units(spark):
    got = [one(spark, units.building_from_unit(lit(c)))[0].unidades_min for c in ("6B", "A", "PBB", "PB", "12", "?")]
    assert got == [14, 1, 2, 1, 12, 1]
    a = [one(spark, units.floor_and_flat(lit(c)))[0] for c in ("BELGRANO GRAL 2343 3 A", "BELGRANO GRAL 2343 B 3", "MITRE 12")]
    assert [(x.piso, x.depto) if x else None for x in a] == [(3, "A"), (3, "B"), None]
    found = one(spark, units.hints(lit("Vendo piso 3 dpto B, luminoso; otro 2A")))[0]
    assert {(h.tipo, h.match) for h in found} >= {("piso", "piso 3"), ("dpto", "dpto b"), ("piso_letra", "2a")}
    close = one(spark, units.hints(lit("piso 1 y piso 2")))[0]
    assert [(h.match, h.raw) for h in close] == [("piso 1", "piso 1 y piso 2"), ("piso 2", "piso 1 y piso 2")]
    far = one(spark, units.hints(lit("a" * 40 + " 4º B con ph fondo")))[0]
    assert [(h.tipo, h.match, h.raw) for h in far] == [("ph", "ph", "a" * 20 + " 4º B con ph fondo"), ("piso_letra", "4º b", "a" * 29 + " 4º B con ph fondo")]
    least = {"": 0, "luminoso": 0, "PH": 2, "dpto 7": 7, "dpto 0": 0, "piso 3 dpto B": 3, "3B": 6, "piso 3, 2 C, ph": 12, "oficina 4": 0, "unidad 5 y monoambiente": 5, "piso 0": 0, "piso 0 ph": 2}
    assert {t: one(spark, units.least_units_from_hints(units.hints(lit(t))))[0] for t in least} == least
    accounts = spark.createDataFrame([("x", "X 1 3 C"), ("x", "X 1 1 A"), ("y", "MITRE 2343"), ("y", "MITRE 2343")], "b string, address string")
    rows = {r.b: (r.unidades_min, r.fuente) for r in units.building_from_accounts(accounts, ["b"]).collect()}
    assert rows == {"x": (12, "inferencia"), "y": (2, "solo_cuentas")}


def test_report_makes_its_text_once(spark):
    from lotespark.functions import bci

    df = spark.createDataFrame([("TERRITORIAL",)], "k string").select(bci.report(F.concat(F.lit("TIPO IMÓVEL CATEGORIA TIPO PROPRIEDADE\n"), "k", F.lit(" made-once"))).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("made-once") == 1
    assert df.select("r.*").first().uso_principal == "vacante"
