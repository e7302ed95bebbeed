"""Every registered query of the survey domain and its SQL twin.

A query is registered with its SQL, both over the projections in fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bci
from ..functions import geometry as G
from ..functions import rules as R
from ..functions import strings as S
from ..functions import units as U
from ..operators import classify, clustering, estimate, grids, merge, quadtree, reports, sequences, spatial, surveys
from ..sources import exports, feeds
from ..runtime import spread
from . import planner
from .fixtures import SIDE, cte, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "", *needs: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query by its function's name; `needs` are the domain tables that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            full = (cte(*needs) if needs else "") + sql
            ORACLE_SQL[f.__name__] = full.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else full
        return f

    return add


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Surveys

LATEST = """last AS (SELECT region_key, survey_id FROM (SELECT region_key, survey_id, row_number() OVER (PARTITION BY region_key ORDER BY started_at DESC NULLS FIRST, survey_id) AS k FROM surveys) WHERE k = 1)"""
COVERAGE = f""", {LATEST},
b AS (SELECT survey_id, count(*) AS footprints, count(setor_id) AS con_setor FROM edificios GROUP BY survey_id),
p AS (SELECT survey_id, count(*) AS parcelas, count(calle) AS con_dir, count(habitantes_estimados) AS con_hab, sum(habitantes_estimados) AS hab FROM parcelas GROUP BY survey_id),
s AS (SELECT region_key, count(*) AS setores, sum(pop_total) AS pop FROM setores GROUP BY region_key),
g AS (SELECT region_key, count(*) AS n FROM logradouros GROUP BY region_key),
e AS (SELECT survey_id, count(*) AS n FROM activity_log GROUP BY survey_id),
j AS (SELECT r.region_id, r.country_code, l.survey_id, l.survey_id IS NOT NULL AS known, coalesce(e.n, 0) AS step, coalesce(s.setores, 0) AS setores, coalesce(s.pop, 0) AS pop, coalesce(g.n, 0) AS streets,
    coalesce(b.footprints, 0) AS footprints, coalesce(b.con_setor, 0) AS con_setor, coalesce(p.parcelas, 0) AS parcelas, coalesce(p.con_dir, 0) AS con_dir, coalesce(p.con_hab, 0) AS con_hab, coalesce(p.hab, 0) AS hab
    FROM regions r LEFT JOIN last l ON l.region_key = r.region_key LEFT JOIN b ON b.survey_id = l.survey_id LEFT JOIN p ON p.survey_id = l.survey_id
    LEFT JOIN s ON s.region_key = r.region_key LEFT JOIN g ON g.region_key = r.region_key LEFT JOIN e ON e.survey_id = l.survey_id),
cov AS (SELECT region_id, country_code, survey_id, CAST(CASE WHEN known THEN step ELSE 0 END AS BIGINT) AS step, CAST(CASE WHEN known THEN setores ELSE 0 END AS BIGINT) AS setores,
    CAST(CASE WHEN known THEN pop ELSE 0 END AS BIGINT) AS pop_total_ibge, CAST(CASE WHEN known THEN streets ELSE 0 END AS BIGINT) AS logradouros_count, CAST(footprints AS BIGINT) AS footprints,
    CAST(con_setor AS BIGINT) AS footprints_con_setor, CAST(parcelas AS BIGINT) AS parcelas, CAST(con_dir AS BIGINT) AS parcelas_con_direccion, CAST(con_hab AS BIGINT) AS parcelas_con_habitantes,
    CAST(0 AS BIGINT) AS edificios_con_direccion,
    CASE WHEN footprints > 0 THEN round(con_setor / footprints, 4) ELSE 0e0 END AS cobertura_footprints_pct,
    CASE WHEN parcelas > 0 THEN round(con_dir / parcelas, 4) ELSE 0e0 END AS cobertura_direccion_pct,
    CASE WHEN parcelas > 0 THEN round(con_hab / parcelas, 4) ELSE 0e0 END AS cobertura_habitantes_pct,
    CASE WHEN known AND pop > 0 THEN round(abs(hab - pop) / greatest(pop, 1), 4) ELSE 0e0 END AS suma_hab_vs_ibge_delta_pct,
    CASE WHEN known THEN NULL ELSE 'no_survey_found' END AS errores FROM j)
"""
COVERAGE_TABLES = ("regions", "surveys", "setores", "logradouros", "edificios", "parcelas", "activity_log")


@query(COVERAGE + "SELECT * EXCLUDE (country_code) FROM cov", *COVERAGE_TABLES)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return surveys.coverage(*(table(spark, d, t) for t in COVERAGE_TABLES))


@query(
    COVERAGE
    + """SELECT region_id, CASE WHEN errores IS NOT NULL THEN 'create_survey' WHEN country_code = 'BRA' AND setores = 0 THEN 'load_census' WHEN country_code = 'BRA' AND logradouros_count = 0 THEN 'load_streets'
    WHEN footprints = 0 AND parcelas = 0 THEN 'load_parcels' WHEN footprints > 0 AND cobertura_footprints_pct < 0.9 THEN 'join_sectors' WHEN cobertura_direccion_pct < 0.8 THEN 'resolve_addresses'
    WHEN cobertura_habitantes_pct < 0.8 THEN 'estimate_people' WHEN suma_hab_vs_ibge_delta_pct > 0.1 THEN 'validate_people' ELSE 'report' END AS next_step FROM cov""",
    *COVERAGE_TABLES,
)
def next_step(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(coverage_report(spark, d), table(spark, d, "regions"))


@query(f", {LATEST} SELECT s.* FROM surveys s JOIN last USING (region_key, survey_id)", "surveys")
def latest_survey(spark: SparkSession, d: str) -> DataFrame:
    return surveys.latest(table(spark, d, "surveys")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})


LIST = """SELECT s.survey_id, r.region_id, r.name, s.status, s.started_at, CAST(count(DISTINCT e.edificio_id) AS BIGINT) AS edificios, CAST(count(DISTINCT p.parcela_id) AS BIGINT) AS parcelas,
    CAST(count(DISTINCT CASE WHEN p.calle IS NOT NULL THEN p.parcela_id END) AS BIGINT) AS con_direccion, CAST(count(DISTINCT CASE WHEN p.cca_code IS NOT NULL THEN p.parcela_id END) AS BIGINT) AS con_codigo,
    CAST(coalesce(sum(p.uf_vivienda), 0) AS BIGINT) AS uf_vivienda, CAST(coalesce(sum(p.uf_comercio), 0) AS BIGINT) AS uf_comercio
    FROM surveys s JOIN regions r ON r.region_key = s.region_key LEFT JOIN edificios e ON e.survey_id = s.survey_id LEFT JOIN parcelas p ON p.survey_id = s.survey_id GROUP BY ALL"""


@query(LIST, "surveys", "regions", "edificios", "parcelas")
def survey_list(spark: SparkSession, d: str) -> DataFrame:
    return surveys.survey_list(*(table(spark, d, t) for t in ("surveys", "regions", "edificios", "parcelas")))


@query(
    """, e AS (SELECT survey_id, count(DISTINCT edificio_id) AS n FROM edificios GROUP BY survey_id),
    p AS (SELECT survey_id, count(*) AS n, count(calle) AS a, count(cca_code) AS c, sum(uf_vivienda) AS v, sum(uf_comercio) AS w FROM parcelas GROUP BY survey_id)
    SELECT s.survey_id, r.region_id, r.name, s.status, s.started_at, CAST(coalesce(e.n, 0) AS BIGINT) AS edificios, CAST(coalesce(p.n, 0) AS BIGINT) AS parcelas, CAST(coalesce(a, 0) AS BIGINT) AS con_direccion,
    CAST(coalesce(c, 0) AS BIGINT) AS con_codigo, CAST(coalesce(v, 0) AS BIGINT) AS uf_vivienda, CAST(coalesce(w, 0) AS BIGINT) AS uf_comercio
    FROM surveys s JOIN regions r ON r.region_key = s.region_key LEFT JOIN e ON e.survey_id = s.survey_id LEFT JOIN p ON p.survey_id = s.survey_id""",
    "surveys", "regions", "edificios", "parcelas",
)
def survey_list_exact(spark: SparkSession, d: str) -> DataFrame:
    return surveys.survey_list_exact(*(table(spark, d, t) for t in ("surveys", "regions", "edificios", "parcelas")))


@query(
    """, s AS (SELECT * FROM surveys ORDER BY started_at DESC NULLS FIRST, survey_id LIMIT 20)
    SELECT s.survey_id, r.region_id, s.status, CAST(floor(epoch(coalesce(s.finished_at, TIMESTAMP '2002-01-01 00:00:00') - s.started_at) / 60) AS BIGINT) AS minutos,
    CAST((SELECT count(*) FROM parcelas p WHERE p.survey_id = s.survey_id) AS BIGINT) AS parcelas, CAST((SELECT count(*) FROM edificios e WHERE e.survey_id = s.survey_id) AS BIGINT) AS edificios
    FROM s JOIN regions r ON r.region_key = s.region_key""",
    "surveys", "regions", "parcelas", "edificios",
)
def surveys_status(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 surveys: the limit is the report's own."""
    s = table(spark, d, "surveys")
    s = s.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    return surveys.status(s, table(spark, d, "regions"), table(spark, d, "parcelas"), table(spark, d, "edificios"), F.lit("2002-01-01 00:00:00").cast("timestamp"))


STATE = "CASE value_kind WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'stopped' WHEN 'click' THEN 'running' END"


@query(
    """, u AS (SELECT survey_id, id, CASE lvl WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'stopped' WHEN 'click' THEN 'running' END AS status FROM activity_log),
    t AS (SELECT u.survey_id, count(*) AS updates, min(CASE WHEN u.status = 'stopped' THEN u.id END) AS stop_at, arg_max(u.status, u.id) FILTER (WHERE u.status IS NOT NULL) AS last_status FROM u GROUP BY u.survey_id),
    f AS (SELECT t.survey_id, t.updates, CASE WHEN s.survey_id IS NULL THEN 'not_found' WHEN s.status = 'stopped' OR t.stop_at IS NOT NULL THEN 'stopped' ELSE coalesce(t.last_status, s.status) END AS status FROM t LEFT JOIN surveys s ON s.survey_id = t.survey_id)
    SELECT survey_id, CAST(updates AS BIGINT) AS updates, status, status IN ('completed', 'failed', 'stopped') AS finished, status IN ('stopped', 'failed', 'not_found') AS should_stop FROM f""",
    "activity_log", "surveys",
)
def survey_states(spark: SparkSession, d: str) -> DataFrame:
    lvl = F.col("lvl")
    state = F.when(lvl == "error", "failed").when(lvl == "purchase", "completed").when(lvl == "signup", "stopped").when(lvl == "click", "running")
    updates = table(spark, d, "activity_log").select("survey_id", F.col("id").alias("seq"), state.alias("status"))
    return surveys.fold_states(table(spark, d, "surveys"), updates)


@query("SELECT survey_id, 'stopped' AS status FROM surveys WHERE status IN ('running', 'stopping')", "surveys")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    return surveys.orphans(table(spark, d, "surveys")).select("survey_id", "status")


@query("""SELECT survey_id, CASE WHEN status IN ('running', 'stopping') THEN concat('409 cannot start: ', status) END AS start, CASE WHEN status <> 'running' THEN concat('409 cannot stop: ', status) END AS stop,
    CASE WHEN status IN ('running', 'stopping') THEN concat('409 cannot delete: ', status) END AS del FROM surveys""", "surveys")  # fmt: skip
def survey_guards(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return table(spark, d, "surveys").select("survey_id", surveys.guard(s, "start").alias("start"), surveys.guard(s, "stop").alias("stop"), surveys.guard(s, "delete").alias("del"))


@query("SELECT id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM activity_log", "activity_log")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activity_log").select("id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


# Reports


@query(
    """SELECT survey_id, count(*) AS parcelas, CAST(sum(uf_vivienda + uf_comercio) AS BIGINT) AS uf_total, nullif(round(sum(area_m2_terreno), 2), 0) AS area_total, count_if(coalesce(calle, '') <> '') AS con_direccion,
    count_if(uf_vivienda + uf_comercio IS NOT NULL) AS con_uf, count_if(coalesce(cca_code, '') <> '') AS con_codigo FROM parcelas GROUP BY survey_id""",
    "parcelas",
)
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals(table(spark, d, "parcelas"), ["survey_id"])


@query(
    """SELECT survey_id, parcela_id, calle, numero, CASE WHEN coalesce(calle, '') <> '' THEN trim(concat_ws(' ', calle, nullif(numero, ''))) ELSE '(sin dirección)' END AS direccion, coalesce(cca_code, '') AS codigo,
    CAST(coalesce(uf_vivienda, 0) + coalesce(uf_comercio, 0) AS BIGINT) AS uf, CASE WHEN area_m2_terreno <> 0 THEN round(area_m2_terreno, 1) END AS area_m2,
    CAST(row_number() OVER (PARTITION BY survey_id ORDER BY calle NULLS LAST, numero NULLS LAST, parcela_id) AS INTEGER) AS n FROM parcelas""",
    "parcelas",
)
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.parcel_rows(table(spark, d, "parcelas"))
    return sequences.numbered(rows, ["survey_id"], [F.asc_nulls_last("calle"), F.asc_nulls_last("numero"), F.asc("parcela_id")])


@query(
    """SELECT survey_id, parcela_id, coalesce(calle, '') AS calle, coalesce(numero, '') AS numero, coalesce(cca_code, '') AS cca_code, coalesce(uso_principal, '') AS uso_principal, coalesce(uf_vivienda, 0) AS uf_vivienda,
    coalesce(uf_comercio, 0) AS uf_comercio, printf('%.6f', centroid_lat) AS lat, printf('%.6f', centroid_lng) AS lng FROM parcelas""",
    "parcelas",
)
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.export_columns(table(spark, d, "parcelas")).drop("area")


# Joins and sets


@query("""SELECT p.parcela_id, s.setor_id FROM parcelas p LEFT JOIN (SELECT DISTINCT setor_id FROM setores) s ON s.setor_id = p.parcela_id % 200""", "parcelas", "setores")
def foreign_key_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parcelas").select("parcela_id", (F.col("parcela_id") % 200).alias("setor_id"))
    return classify.guard_foreign_key(rows, table(spark, d, "setores"), "setor_id")


@query("SELECT parent, count_if(s_m2 > 0 AND s_m2 < 25) AS cocheras, count_if(s_m2 >= 25) AS uf FROM unit_counts GROUP BY parent", "unit_counts")
def unit_split(spark: SparkSession, d: str) -> DataFrame:
    return classify.split_units(table(spark, d, "unit_counts"))


@query("SELECT p.parcela_id, coalesce(u.n, 1) AS uf, coalesce(p.numero, 'S/N') AS altura FROM parcelas p LEFT JOIN (SELECT parent, count(*) AS n FROM unit_counts GROUP BY parent) u ON u.parent = p.parcela_id", "parcelas", "unit_counts")
def frontage_units(spark: SparkSession, d: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 42, "0")
    p, u = table(spark, d, "parcelas"), table(spark, d, "unit_counts")
    sides = p.where("numero IS NOT NULL").select(code("parcela_id").alias("cca"), F.lit("FRENTE").alias("tdl"), (F.col("numero").cast("double") + 1).alias("feo"), F.lit(0).alias("pos"))
    got = classify.frontage_join(p.select(code("parcela_id").alias("cca")), sides, u.select(F.concat(code("parent"), F.lit("000001")).alias("cca")))
    number = F.when(F.col("altura") == "S/N", F.col("altura")).otherwise((F.col("altura").try_cast("int") - 1).cast("string"))
    return got.select(F.col("cca").cast("bigint").alias("parcela_id"), "uf", number.alias("altura"))


@query("SELECT coalesce(uso_principal, '?') AS uso_principal, count(*) AS n FROM parcelas GROUP BY 1", "parcelas")
def use_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sequences.histogram(table(spark, d, "parcelas").withColumn("uso_principal", F.coalesce("uso_principal", F.lit("?"))), "uso_principal")


@query("""SELECT 'lvl' AS campo, lvl AS valor, count(*) AS n FROM activity_log GROUP BY 2 UNION ALL SELECT 'dia', strftime(ts, '%w'), count(*) FROM activity_log GROUP BY 2""", "activity_log")
def two_histograms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activity_log").select("lvl", (F.dayofweek("ts") - 1).cast("string").alias("dia"))
    return sequences.two_histograms(rows, "lvl", "dia")


@query("SELECT survey_id, id, ts, lvl FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY id DESC) AS k FROM activity_log) WHERE k <= 100", "activity_log")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 entries of each survey: the limit is the buffer's size."""
    return sequences.last_n(table(spark, d, "activity_log").select("survey_id", "id", "ts", "lvl"), ["survey_id"], "id", 100)


@query("SELECT count(*) AS entries, coalesce(max(id), 5000) AS last_id FROM activity_log WHERE id > 5000", "activity_log")
def cursor_read(spark: SparkSession, d: str) -> DataFrame:
    return sequences.cursor_read(table(spark, d, "activity_log"), 5000)


@query("SELECT r.id FROM range(0, 70001) r(id) WHERE NOT EXISTS (SELECT 1 FROM parcelas p WHERE p.parcela_id * 2 = r.id)", "parcelas")
def ids_to_do(spark: SparkSession, d: str) -> DataFrame:
    return sequences.remaining(0, 70000, table(spark, d, "parcelas").select((F.col("parcela_id") * 2).alias("id")))


@query("SELECT parcela_id AS id FROM parcelas UNION SELECT CAST(parent AS BIGINT) + 10 FROM unit_counts", "parcelas", "unit_counts")
def ids_processed(spark: SparkSession, d: str) -> DataFrame:
    return sequences.processed(table(spark, d, "parcelas").select(F.col("parcela_id").alias("id")), table(spark, d, "unit_counts").select((F.col("parent") + 10).alias("id")))


@query("""SELECT survey_id, lvl FROM (SELECT survey_id, lvl, row_number() OVER (PARTITION BY survey_id ORDER BY n DESC, pos) AS k FROM (SELECT survey_id, lvl, count(*) AS n, min(id) AS pos FROM activity_log GROUP BY survey_id, lvl)) WHERE k = 1""", "activity_log")
def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return sequences.mode_first(table(spark, d, "activity_log"), ["survey_id"], "lvl", "id")


REPEATS = """, x AS (SELECT survey_id, id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN '' ELSE lvl END AS item FROM activity_log),
    y AS (SELECT *, {} AS prev FROM x) SELECT survey_id, id, item FROM y WHERE NOT (item <> '' AND coalesce(item = prev, false))"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    item = F.when(F.get_json_object("props", "$.k").cast("int") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lvl"))
    return table(spark, d, "activity_log").select("survey_id", "id", item.alias("items"))


@query(REPEATS.format("last_value(nullif(item, '') IGNORE NULLS) OVER (PARTITION BY survey_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), "activity_log")
def repeats_of_last_filled(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.drop_repeats_of_last_filled(_items(spark, d), ["survey_id"], "id", "items")
    return out.select("survey_id", "id", F.coalesce(F.get("items", F.lit(0)), F.lit("")).alias("item"))


@query(REPEATS.format("lag(item) OVER (PARTITION BY survey_id ORDER BY id)"), "activity_log")
def repeats_of_previous(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.drop_repeats_of_previous(_items(spark, d), ["survey_id"], "id", "items")
    return out.select("survey_id", "id", F.coalesce(F.get("items", F.lit(0)), F.lit("")).alias("item"))


@query("""SELECT parcela_id, survey_id, calle FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY parcela_id) AS k FROM parcelas WHERE calle IS NOT NULL) WHERE k = 1""", "parcelas")
def first_parcel(spark: SparkSession, d: str) -> DataFrame:
    return sequences.first_per_key(table(spark, d, "parcelas").where("calle IS NOT NULL").select("survey_id", "parcela_id", "calle"), ["survey_id"], "parcela_id")


@query("""SELECT parcela_id, cca_code FROM parcelas WHERE calle IS NULL OR calle = '' ORDER BY cca_code NULLS FIRST, parcela_id LIMIT 100""", "parcelas")
def address_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next 100 parcels to resolve: the limit is the batch size."""
    todo = classify.incomplete(table(spark, d, "parcelas")).select("parcela_id", "cca_code")
    return classify.batch(todo, ["cca_code", "parcela_id"], 100)


# Merges

MERGE_FEED = """f AS (SELECT o_orderkey AS parcela_id, o_custkey AS survey_id, concat('Nova ', o_orderstatus) AS calle, o_orderkey % 2 AS uf_vivienda, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS area_m2_terreno FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, NULL, 1, o_totalprice FROM orders WHERE o_orderkey % 50 = 0)"""


def _merge_feed(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    a = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS parcela_id", "o_custkey AS survey_id", "concat('Nova ', o_orderstatus) AS calle", "o_orderkey % 2 AS uf_vivienda", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS area_m2_terreno")
    return a.union(o.where("o_orderkey % 50 = 0").selectExpr("o_orderkey + 1000000000", "o_custkey", "NULL", "1L", "o_totalprice"))


@query(
    f""", {MERGE_FEED}
    SELECT coalesce(p.parcela_id, f.parcela_id) AS parcela_id, CASE WHEN p.parcela_id IS NULL THEN f.survey_id ELSE p.survey_id END AS survey_id, coalesce(f.calle, p.calle) AS calle,
    CASE WHEN p.parcela_id IS NULL THEN f.uf_vivienda ELSE coalesce(nullif(f.uf_vivienda, 0), p.uf_vivienda) END AS uf_vivienda, CASE WHEN f.parcela_id IS NULL THEN p.area_m2_terreno ELSE f.area_m2_terreno END AS area_m2_terreno,
    CASE WHEN p.parcela_id IS NULL THEN 'feed' ELSE p.uso_principal END AS uso_principal FROM parcelas p FULL JOIN f ON f.parcela_id = p.parcela_id""",
    "parcelas",
)
def merge_parcels(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "parcelas").select("parcela_id", "survey_id", "calle", "uf_vivienda", "area_m2_terreno", "uso_principal")
    return merge.merge(target, _merge_feed(spark, d), ["parcela_id"], {"survey_id": "keep", "uf_vivienda": "nullif0", "area_m2_terreno": "overwrite"}, insert={"uso_principal": F.lit("feed")})


@query(f", {MERGE_FEED} SELECT count_if(p.parcela_id IS NULL) AS insertadas, count_if(p.parcela_id IS NOT NULL) AS actualizadas FROM f LEFT JOIN parcelas p ON p.parcela_id = f.parcela_id", "parcelas")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_counts(table(spark, d, "parcelas"), _merge_feed(spark, d), ["parcela_id"])


@query("""SELECT region_id, name FROM regions UNION ALL SELECT concat('zona-', r_regionkey), r_name FROM region""", "regions")
def insert_missing_regions(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "regions").select("region_id", "name")
    feed = spark.read.parquet(f"{d}/region.parquet").selectExpr("concat('zona-', r_regionkey) AS region_id", "r_name AS name")
    return merge.insert_missing(regions, feed.union(regions), ["region_id"])


@query("""SELECT p.parcela_id, CASE WHEN p.uso_principal = 'vacante' THEN p.uso_principal ELSE CASE p.parcela_id % 3 WHEN 0 THEN 'residencial' WHEN 1 THEN 'vacante' ELSE p.uso_principal END END AS uso_principal,
    CASE WHEN coalesce(p.uso_principal, '') = 'vacante' OR p.parcela_id % 3 = 2 THEN p.uf_vivienda WHEN p.parcela_id % 3 = 0 THEN greatest(p.uf_vivienda, 1) ELSE 0 END AS uf_vivienda FROM parcelas p""", "parcelas")  # fmt: skip
def update_use(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas")
    third = F.col("parcela_id") % 3
    uses = p.where(~F.col("uso_principal").eqNullSafe("vacante") & (third < 2)).select("parcela_id", F.when(third == 0, "residencial").otherwise("vacante").alias("uso_principal"))
    return merge.update_use(p.select("parcela_id", "uso_principal", "uf_vivienda"), uses)


@query("""SELECT 'surveys' AS tabla, count(*) AS n FROM surveys WHERE survey_id % 10 <> 3 UNION ALL SELECT 'edificios', count(*) FROM edificios WHERE survey_id % 10 <> 3 UNION ALL SELECT 'parcelas', count(*) FROM parcelas WHERE survey_id % 10 <> 3
    UNION ALL SELECT 'log', count(*) FROM activity_log WHERE survey_id NOT IN (SELECT survey_id FROM surveys WHERE survey_id % 10 = 3) UNION ALL SELECT 'unidades', count(*) FROM edificios WHERE edificio_id NOT IN (SELECT edificio_id FROM edificios WHERE survey_id % 10 = 3)""", "surveys", "edificios", "parcelas", "activity_log")  # fmt: skip
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    s, e, p, log = (table(spark, d, t) for t in ("surveys", "edificios", "parcelas", "activity_log"))
    left = merge.delete_cascade(s.where("survey_id % 10 = 3"), s, e, e.select("edificio_id"), p, log)
    out = None
    for name in ("surveys", "edificios", "parcelas", "log", "unidades"):
        n = left[name].agg(F.lit(name).alias("tabla"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


# Scalars


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(concat(p_name, ' ', p_brand, '#')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 15 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 15, '0') END AS code,
    TRY_CAST(replace(replace(printf('%.2f', p_retailprice), ',', ''), ' ', '') AS DOUBLE) AS money, CASE WHEN p_size > 20 THEN concat(p_type, ' ', p_name) ELSE p_name END AS joined, CASE CAST(p_size % 27 AS INTEGER) WHEN 0 THEN 'Departamento 0' WHEN 1 THEN 'Capital' WHEN 23 THEN 'Rivadavia' WHEN 14 THEN 'Rivadavia' END AS dep
    FROM part""",
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("p_size") % 27).cast("string")
    dep = S.department(size)
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", S.slug(F.concat_ws(" ", "p_name", F.concat("p_brand", F.lit("#")))).alias("slug"), S.zero_filled(F.col("p_partkey"), 15).alias("code"), S.money(F.format_string("%.2f", F.col("p_retailprice"))).alias("money"),
        S.joined(F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(""), F.col("p_name")).alias("joined"), F.when(size.isin("0", "1", "14", "23"), dep).alias("dep"),
    )


@query(
    """SELECT parcela_id, CASE WHEN uf_vivienda + uf_comercio = 0 THEN 'sin_datos' WHEN uf_vivienda > 0 AND uf_comercio > 0 THEN 'mixto' WHEN uf_comercio > 0 THEN 'comercial' ELSE 'residencial' END AS uso,
    CASE WHEN area_m2_terreno < 1 THEN 'vacante' WHEN area_m2_terreno IS NULL AND numero IS NULL THEN 'sin_match' ELSE 'edificado' END AS vacancia, round(centroid_lng * pi() / 180 * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + centroid_lat * pi() / 180 / 2)) * 6378137, 3) AS my,
    CAST(round_even(1 + (parcela_id % 7) / 7e0 * 49, 0) AS INTEGER) AS puerta, uf_vivienda * 0.005e0 AS costo FROM parcelas""",
    "parcelas",
)
def rule_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "parcelas").select(
        "parcela_id", R.final_use(c("uf_vivienda"), c("uf_comercio"), F.lit(-1)).alias("uso"), R.vacancy(c("area_m2_terreno"), c("numero").cast("double")).alias("vacancia"), F.round(R.mercator_x(c("centroid_lng")), 3).alias("mx"),
        F.round(R.mercator_y(c("centroid_lat")), 3).alias("my"), R.interpolated(F.lit(1), F.lit(50), (c("parcela_id") % 7) / F.lit(7.0)).alias("puerta"), R.call_cost(c("uf_vivienda")).alias("costo"),
    )


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS titulo, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS idioma, len(regexp_extract_all(html, '<p>')) AS parrafos FROM pages""")
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    found = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", found("<title>([^<]*)</title>").alias("titulo"), found('lang="([a-z]+)"').alias("idioma"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("bigint").alias("parrafos"))


@query(
    r"""SELECT l_orderkey, min(CAST(l_linenumber AS INTEGER)) AS piso_min, max(l_linenumber) AS piso_max, max(1 + l_linenumber % 4) AS ancho, CAST(max(l_linenumber) * max(1 + l_linenumber % 4) + max(1 + l_linenumber % 4) AS BIGINT) AS unidades_min
    FROM lineitem WHERE l_linenumber > 0 GROUP BY l_orderkey""",
)
def building_inference(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber > 0")
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    accounts = line.select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("BELGRANO GRAL 2343"), F.col("l_linenumber").cast("string"), letter).alias("address"))
    least = accounts.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("piso_min"))
    got = U.building_from_accounts(accounts, ["l_orderkey"])
    return got.join(least, "l_orderkey").select("l_orderkey", "piso_min", F.col("piso_max_visto").alias("piso_max"), F.col("dptos_por_piso_min").alias("ancho"), "unidades_min")


BCI_TEXT = """concat_ws(chr(10), 'TIPO IMÓVEL CATEGORIA TIPO PROPRIEDADE', CASE WHEN o_orderkey % 9 = 0 THEN 'TERRITORIAL X Y' ELSE 'PREDIAL X Y' END, 'CÓDIGO LOGRADOURO NÚMERO CEP',
    concat('123 RUA DA ', o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(' ', CAST(o_orderkey % 900 + 1 AS STRING)) END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' 78.110-000' END),
    concat('  ', CAST(o_orderkey % 50 AS STRING), ' - ', CASE WHEN o_orderkey % 2 = 0 THEN 'BAIRRO ' ELSE '' END, 'CENTRO ', o_orderstatus), concat('QUADRA ', CAST(o_orderkey % 30 AS STRING)),
    'N° MATRÍCULA FRENTE (M)', CASE WHEN o_orderkey % 6 = 0 THEN '0,00 1,00' ELSE concat('0,00 ', CAST(o_orderkey % 1000 AS STRING), '.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ' 0,00') END,
    repeat(concat('UNIDADE CÓDIGO DA UNIDADE AREA TOTAL', CASE WHEN o_orderkey % 8 > 3 THEN concat(chr(10), 'x 1', chr(10), 'SUBTOTAL ') ELSE '' END, chr(10), '1 55', CASE WHEN o_orderkey % 13 > 6 THEN chr(10) ELSE ' ' END, '10,5 ', CAST(o_orderkey % 300 AS STRING), ',25', CASE WHEN o_orderkey % 10 > 4 THEN ' ' ELSE chr(10) END), CAST(o_orderkey % 4 AS INT)),
    CASE WHEN o_orderkey % 3 = 0 THEN concat('UNIDADE CÓDIGO DA UNIDADE AREA TOTAL', chr(10), 'sem dados') END,
    repeat('USO RESIDENCIAL TIPOLOGIA CASA ', CAST(o_orderkey % 3 AS INT)), repeat('USO COMERCIAL TIPOLOGIA sala ', CAST(o_orderkey % 2 AS INT)), CASE WHEN o_orderkey % 11 = 0 THEN 'USO INDUSTRIAL' END)"""


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderkey % 9 = 0 AS vac, o_orderkey % 3 AS h, o_orderkey % 2 AS c, o_orderkey % 4 AS u, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS i FROM orders)
    SELECT k AS o_orderkey, CASE WHEN vac THEN 'territorial' ELSE 'predial' END AS tipo_imovel,
    CASE WHEN vac THEN 'vacante' WHEN c > 0 AND h > 0 THEN 'mixto' WHEN c > 0 THEN 'comercial' WHEN i > 0 THEN 'industrial' ELSE 'residencial' END AS uso_principal,
    CAST(CASE WHEN vac THEN 0 ELSE h END AS INTEGER) AS uf_vivienda, CAST(CASE WHEN vac THEN 0 ELSE c END AS INTEGER) AS uf_comercio, CAST(CASE WHEN vac THEN 0 WHEN u > 0 THEN u ELSE h + c + i END AS INTEGER) AS uf_total,
    CASE WHEN NOT vac AND u > 0 THEN k % 300 + 25e-2 END AS area_m2_construida, CASE WHEN vac THEN NULL WHEN h > 0 AND h >= c THEN 'CASA' WHEN c > 0 THEN 'SALA' END AS tipologia,
    CASE WHEN k % 7 > 0 THEN '78110000' END AS codigo_postal, CASE WHEN k % 7 > 0 AND k % 5 > 0 THEN CAST(k % 900 + 1 AS VARCHAR) END AS numero, CASE WHEN k % 7 > 0 THEN concat('RUA DA ', st) END AS calle,
    concat('CENTRO ', st) AS barrio, CASE WHEN k % 6 > 0 THEN concat(k % 1000, '.', lpad(CAST(k % 1000 AS VARCHAR), 3, '0')) END AS partida_inmobiliaria FROM x""",
)
def property_reports(spark: SparkSession, d: str) -> DataFrame:
    """All fields of a report made for each order: lots without buildings, units, uses, addresses with and without number or postcode."""
    rows = spread(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"))
    return rows.select("o_orderkey", bci.report(F.expr(BCI_TEXT)).alias("r")).select("o_orderkey", "r.*")


# Space


def _zones(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "setores")
    return s.select(F.col("setor_id").alias("zone_id"), "distrito", "pop_total", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + SIDE, F.col("y0") + SIDE).alias("polygon"))


IN_ZONE = "p.centroid_lng BETWEEN z.x0 AND z.x0 + 2e-2 AND p.centroid_lat BETWEEN z.y0 AND z.y0 + 2e-2"


@query(
    f""", h AS (SELECT p.parcela_id, arg_min(z.distrito, z.setor_id) AS distrito FROM parcelas p JOIN setores z ON {IN_ZONE} GROUP BY p.parcela_id)
    SELECT p.parcela_id, h.distrito, CASE h.distrito WHEN 'R1' THEN 'residencial' WHEN 'NC1' THEN 'comercial' WHEN 'M2' THEN 'mixto' WHEN 'PI' THEN 'industrial' WHEN 'AGR' THEN 'vacante' ELSE 'sin_datos' END AS uso_principal FROM parcelas p LEFT JOIN h ON h.parcela_id = p.parcela_id""",
    "parcelas", "setores",
)
def zoning(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify_zones(table(spark, d, "parcelas"), _zones(spark, d), size=SIDE)


@query(f"SELECT p.parcela_id, z.setor_id AS zone_id FROM parcelas p JOIN setores z ON {IN_ZONE}", "parcelas", "setores")
def point_in_sector(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas").select("parcela_id", "centroid_lng", "centroid_lat")
    return spatial.point_in_polygon(p, _zones(spark, d), "centroid_lng", "centroid_lat", "polygon", SIDE).select("parcela_id", "zone_id")


@query(
    """, a AS (SELECT survey_id AS g, parcela_id, centroid_lat AS lat, centroid_lng AS lng FROM parcelas), b AS (SELECT survey_id AS g, parcela_id, centroid_lat + 3e-5 AS lat, centroid_lng - 2e-5 AS lng FROM parcelas)
    SELECT a.parcela_id AS a, b.parcela_id AS b FROM a JOIN b ON a.g = b.g AND abs(a.lat - b.lat) < 5e-5 AND abs(a.lng - b.lng) < 5e-5
    UNION ALL SELECT a.parcela_id, c.parcela_id + 1000000000 FROM a JOIN a c ON a.g = c.g AND abs(a.lat - c.lat) < 5e-5 AND abs(a.lng - c.lng) < 5e-5""",
    "parcelas",
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Parcels of one survey that lie within the band of each other, and of their own shifted places."""
    a = table(spark, d, "parcelas").select(F.col("survey_id").alias("g"), "parcela_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    b = a.withColumns({"lat": F.col("lat") + F.lit(3e-5), "lng": F.col("lng") - F.lit(2e-5)})
    x = spatial.band_join(a, b, 5e-5, ["g"]).select(F.col("parcela_id").alias("a"), F.col("parcela_id_r").alias("b"))
    return x.union(spatial.band_join(a, a, 5e-5, ["g"]).select("parcela_id", F.col("parcela_id_r") + 1000000000))


@query(
    """, s AS (SELECT *, x0 AS xa, x0 + 2e-2 AS xb FROM logradouros WHERE nome IS NOT NULL),
    h AS (SELECT p.parcela_id, s.logradouro_id, s.nome, greatest(0e0, least(1e0, (p.centroid_lng - s.xa) / (s.xb - s.xa))) AS t, sqrt(pow(p.centroid_lng - greatest(s.xa, least(s.xb, p.centroid_lng)), 2) + pow(p.centroid_lat - s.y, 2)) AS d FROM parcelas p CROSS JOIN s WHERE p.parcela_id % 20 = 0)
    SELECT parcela_id, round(min(d), 7) AS dist FROM h GROUP BY parcela_id""",
    "parcelas", "logradouros",
)
def nearest_street(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest street of the stated query set, every parcel whose id is divisible by 20, against all streets."""
    p = table(spark, d, "parcelas").where("parcela_id % 20 = 0").select("parcela_id", "centroid_lng", "centroid_lat")
    s = table(spark, d, "logradouros").where("nome IS NOT NULL")
    s = s.withColumn("line", F.array(G.point(F.col("x0"), F.col("y")), G.point(F.col("x0") + SIDE, F.col("y"))))
    near = quadtree.nearest_line(p, s, "centroid_lng", "centroid_lat", "line", "logradouro_id", ["nome"])
    return near.select("parcela_id", F.round("dist", 7).alias("dist"))


@query(
    """, p AS (SELECT parcela_id, centroid_lng AS x, centroid_lat AS y FROM parcelas WHERE calle IS NULL OR calle = ''),
    s AS (SELECT *, x0 AS xa, x0 + 2e-2 AS xb, floor(y / 2e-2) AS cy FROM logradouros WHERE nome IS NOT NULL),
    h AS (SELECT p.parcela_id, p.x, p.y AS py, s.*, greatest(0e0, least(1e0, (p.x - s.xa) / (s.xb - s.xa))) AS t FROM p JOIN s ON s.cy BETWEEN floor(p.y / 2e-2) - 1 AND floor(p.y / 2e-2) + 1 AND abs(s.y - p.y) <= 52e-4 AND p.x BETWEEN s.xa - 52e-4 AND s.xb + 52e-4),
    b AS (SELECT *, row_number() OVER (PARTITION BY parcela_id ORDER BY sqrt(pow(x - xa - t * (xb - xa), 2) + pow(py - y, 2)), logradouro_id) AS k FROM h),
    m AS (SELECT *, xa + t * (xb - xa) AS qx, CASE WHEN ini_esq > 0 AND fin_esq > 0 THEN ini_esq ELSE ini_dir END AS i, CASE WHEN ini_esq > 0 AND fin_esq > 0 THEN fin_esq ELSE fin_dir END AS f FROM b WHERE k = 1),
    r AS (SELECT *, 2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(y - py) / 2), 2) + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(qx - x) / 2), 2))) AS dist_m FROM m)
    SELECT parcela_id, concat_ws(' ', tipo, nome) AS calle, CASE WHEN i > 0 AND f > 0 THEN CAST(CAST(round_even(i + t * (f - i), 0) AS INTEGER) AS VARCHAR) END AS numero, round(dist_m, 3) AS dist_m FROM r WHERE dist_m <= 100""",
    "parcelas", "logradouros",
)
def street_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Address of each parcel without a street from the nearest street of its region, within 100 m."""
    p = classify.incomplete(table(spark, d, "parcelas")).select("parcela_id", "centroid_lng", "centroid_lat")
    s = table(spark, d, "logradouros")
    s = s.withColumn("line", F.array(G.point(F.col("x0"), F.col("y")), G.point(F.col("x0") + SIDE, F.col("y"))))
    return classify.street_candidates(p, s, on=[]).withColumn("dist_m", F.round("dist_m", 3))


@query(f""", h AS (SELECT p.parcela_id, min(z.setor_id) AS setor_id FROM parcelas p JOIN setores z ON {IN_ZONE} GROUP BY p.parcela_id), b AS (SELECT h.setor_id, h.parcela_id, p.area_m2_terreno AS w1, p.uf_vivienda AS w2, z.pop_total FROM h JOIN parcelas p ON p.parcela_id = h.parcela_id JOIN setores z ON z.setor_id = h.setor_id),
    t AS (SELECT *, CASE WHEN sum(coalesce(w1, 0)) OVER w > 0 THEN pop_total * coalesce(w1, 0) / sum(coalesce(w1, 0)) OVER w ELSE pop_total / count(*) OVER w END AS a, CASE WHEN sum(w2) OVER w > 0 THEN pop_total * (w2 / sum(w2) OVER w) ELSE pop_total / count(*) OVER w END AS c FROM b WINDOW w AS (PARTITION BY setor_id))
    SELECT parcela_id, round((a + c) / 2, 4) AS habitantes_estimados, round(least(a, c), 4) AS habitantes_low, round(greatest(a, c), 4) AS habitantes_high FROM t""", "parcelas", "setores")  # fmt: skip
def dasymetric_population(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas")
    z = _zones(spark, d)
    hit = spatial.first_polygon(p, z, "parcela_id", "zone_id", ["zone_id"], x="centroid_lng", y="centroid_lat", polygon="polygon", size=SIDE).where("zone_id IS NOT NULL").withColumnRenamed("zone_id", "setor_id")
    out = estimate.dasymetric(hit.drop("habitantes_estimados"), z.select(F.col("zone_id").alias("setor_id"), "pop_total"), {"area": F.col("area_m2_terreno"), "uf": F.col("uf_vivienda")})
    return out.select("parcela_id", *[F.round(c, 4).alias(c) for c in ("habitantes_estimados", "habitantes_low", "habitantes_high")])


FAULTY = """SELECT parcela_id, CASE WHEN parcela_id % 50 = 7 THEN -survey_id ELSE survey_id END AS survey_id, parcela_id % 100 AS setor_id, habitantes_estimados,
    CASE WHEN parcela_id % 40 = 5 THEN NULL WHEN parcela_id % 40 = 6 THEN 91e0 ELSE centroid_lat END AS centroid_lat, CASE WHEN parcela_id % 40 = 9 THEN -181e0 ELSE centroid_lng END AS centroid_lng FROM {p}
    UNION ALL SELECT parcela_id, survey_id, parcela_id % 100, NULL, centroid_lat, centroid_lng FROM {p} WHERE parcela_id % 30 = 3"""


@query(
    f""", p AS ({FAULTY.format(p="parcelas")}), h AS (SELECT setor_id, sum(habitantes_estimados) AS hab FROM p GROUP BY setor_id)
    SELECT 'habitantes_por_setor' AS control, count(*) AS filas, count_if(abs(coalesce(h.hab, 0) - s.pop_total) > 0.05 * greatest(s.pop_total, 1)) AS fallas FROM setores s LEFT JOIN h ON h.setor_id = s.setor_id
    UNION ALL SELECT 'parcelas_repetidas', count(*), count_if(k > 1) FROM (SELECT parcela_id, count(*) AS k FROM p GROUP BY parcela_id)
    UNION ALL SELECT 'survey_existe', count(*), count_if(survey_id NOT IN (SELECT survey_id FROM surveys)) FROM p
    UNION ALL SELECT 'centroide_valido', count(*), count_if(centroid_lat IS NULL OR abs(centroid_lat) > 90 OR abs(centroid_lng) > 180) FROM p
    UNION ALL SELECT 'geometria_valida', count(*), count_if(centroid_lat IS NULL OR parcela_id % 10 < 2) FROM p""",
    "parcelas", "setores", "surveys",
)
def validator(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the checks over parcels of which some repeat, name no survey, or lie nowhere."""
    p = spark.sql(FAULTY.format(p="{p}"), p=table(spark, d, "parcelas"))
    at = lambda dx, dy: G.point(F.col("centroid_lng") + dx * 1e-4, F.col("centroid_lat") + dy * 1e-4)
    square, bow, spike = (F.array(F.array(*(at(*c) for c in ring))) for ring in (((0, 0), (1, 0), (1, 1), (0, 1)), ((0, 0), (1, 1), (1, 0), (0, 1)), ((0, 0), (1, 0), (2, 0), (1, 0), (1, 1), (0, 1))))
    p = p.withColumn("polygon", F.when(F.col("parcela_id") % 10 == 0, bow).when(F.col("parcela_id") % 10 == 1, spike).otherwise(square))
    return estimate.validate(p, table(spark, d, "setores"), table(spark, d, "surveys"))


@query("SELECT parcela_id, CAST(round(area_m2_terreno / 80) AS BIGINT) AS unidades FROM parcelas", "parcelas")
def unit_counter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parcelas").select("parcela_id", estimate.units_from_area(F.col("area_m2_terreno")).alias("unidades"))


@query(
    """SELECT setor_id, round(x0 + 1e-2, 9) AS cx, round(y0 + 1e-2, 9) AS cy, round(4e-4 * 111320e0 * 111320e0, 0) AS area, round(x0 + 2 * 2e-2 / 5, 9) AS mx FROM setores""",
    "setores",
)
def geometry_functions(spark: SparkSession, d: str) -> DataFrame:
    z = _zones(spark, d)
    c, m = G.centroid(F.col("polygon")), G.vertex_mean(F.col("polygon")[0])
    # of the five listed corners two lie right of the middle: the mean of x is x0 + 2/5 of the side
    return z.select(F.col("zone_id").alias("setor_id"), F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), F.round(G.area_degrees_m2(F.col("polygon")), 0).alias("area"), F.round(m["x"], 9).alias("mx"))


@query(
    """, f AS MATERIALIZED (SELECT parcela_id AS id, survey_id % 25 AS g, row_number() OVER (PARTITION BY survey_id % 25 ORDER BY parcela_id) AS k, centroid_lat + (parcela_id % 7) * 13e-6 AS lat, centroid_lng + (parcela_id % 5) * 13e-6 AS lng FROM parcelas),
    n AS MATERIALIZED (SELECT a.g, a.id, b.id AS other, a.k, b.k AS ok, pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) AS d FROM f a JOIN f b ON a.g = b.g AND b.k < a.k AND abs(a.lat - b.lat) < 5e-5 AND abs(a.lng - b.lng) < 5e-5),
    w AS (SELECT g, k, id, CAST([id] AS BIGINT[]) AS led FROM f WHERE k = 1
        UNION ALL SELECT f.g, f.k, f.id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = f.id AND list_contains(w.led, n.other)) THEN w.led ELSE list_append(w.led, f.id) END FROM w JOIN f ON f.g = w.g AND f.k = w.k + 1),
    l AS (SELECT g, unnest(led) AS id FROM (SELECT g, arg_max(led, k) AS led FROM w GROUP BY g))
    SELECT f.id AS parcela_id, coalesce(CASE WHEN l.id IS NOT NULL THEN f.id END, (SELECT arg_min(n.other, struct_pack(d := n.d, o := n.other)) FROM n JOIN l m ON m.id = n.other WHERE n.id = f.id)) AS leader FROM f LEFT JOIN l ON l.id = f.id""",
    "parcelas", recursive=True,
)
def fuzzy_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Which parcel each parcel of the feed updates under the fuzzy centroid key."""
    p = table(spark, d, "parcelas").select("parcela_id", (F.col("survey_id") % 25).alias("g"), F.expr("centroid_lat + (parcela_id % 7) * 13e-6").alias("lat"), F.expr("centroid_lng + (parcela_id % 5) * 13e-6").alias("lng"))
    return clustering.leaders(p, "parcela_id", "parcela_id", ["g"])


@query(
    """, b AS (SELECT min(centroid_lat) AS s, min(centroid_lng) AS w, max(centroid_lat) AS n, max(centroid_lng) AS e FROM parcelas),
    c AS (SELECT k.k AS pass, i.i AS i, j.j AS j, b.*, s - 1e-2 * k.k / 2 AS lat0, w - 1e-2 * k.k / 2 AS lng0 FROM b, range(0, 2) k(k), range(0, 60) i(i), range(0, 60) j(j)),
    g AS (SELECT pass, i, j, greatest(lat0 + i * 1e-2, s) AS s, greatest(lng0 + j * 1e-2, w) AS w, least(lat0 + (i + 1) * 1e-2, n) AS n, least(lng0 + (j + 1) * 1e-2, e) AS e FROM c)
    SELECT pass, i, j, round(s, 9) AS s, round(w, 9) AS w, round(n, 9) AS n, round(e, 9) AS e FROM g WHERE n > s AND e > w""",
    "parcelas",
)
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a two-pass grid over the parcels' box."""
    b = table(spark, d, "parcelas").agg(*[f(c).alias(n) for f, c, n in ((F.min, "centroid_lat", "s"), (F.min, "centroid_lng", "w"), (F.max, "centroid_lat", "n"), (F.max, "centroid_lng", "e"))]).first()
    return grids.grid_cells(spark, b.s, b.w, b.n, b.e, 0.01, 2).select("pass", "i", "j", *[F.round(c, 9).alias(c) for c in ("s", "w", "n", "e")])


@query("SELECT survey_id, min(centroid_lat) - 1e-3 AS south, min(centroid_lng) - 1e-3 AS west, max(centroid_lat) + 1e-3 AS north, max(centroid_lng) + 1e-3 AS east FROM parcelas GROUP BY survey_id", "parcelas")
def survey_bounds(spark: SparkSession, d: str) -> DataFrame:
    pad = F.lit(1e-3)
    return table(spark, d, "parcelas").groupBy("survey_id").agg((F.min("centroid_lat") - pad).alias("south"), (F.min("centroid_lng") - pad).alias("west"), (F.max("centroid_lat") + pad).alias("north"), (F.max("centroid_lng") + pad).alias("east"))


@query("SELECT date_trunc('hour', ts) AS start, lvl, count(*) AS n FROM activity_log GROUP BY 1, 2", "activity_log")
def activity_by_hour(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activity_log").groupBy(F.window("ts", "1 hour"), "lvl").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "lvl", "n")


@query("""SELECT count(*) AS done, round(count(*) / 20000, 4) AS share, round(epoch(max(date_trunc('second', ts)) - min(date_trunc('second', ts))) / (count(*) - 1), 3) AS mean_s FROM activity_log""", "activity_log")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return sequences.progress(table(spark, d, "activity_log"), 20000).select("done", "share", "mean_s")


# Feeds: payload text made from the tables, read back by the feed readers


def _square(x0: str, y0: str) -> str:
    corners = [(x0, y0), (f"({x0} + 2e-2)", y0), (f"({x0} + 2e-2)", f"({y0} + 2e-2)"), (x0, f"({y0} + 2e-2)"), (x0, y0)]
    return "concat('[[', " + ", ',', ".join(f"'[', CAST({x} AS STRING), ',', CAST({y} AS STRING), ']'" for x, y in corners) + ", ']]')"


@query("SELECT concat('K', setor_id) AS nomenclatura, CASE WHEN setor_id % 3 = 0 THEN NULL ELSE CAST(setor_id AS VARCHAR) END AS numero, round(x0 + 1e-2, 7) AS lng, round(y0 + 1e-2, 7) AS lat FROM setores", "setores")
def cadastral_feed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "setores")
    text = F.expr(f"""concat('{{"type":"FeatureCollection","features":[{{"properties":{{"VINCULACIO":"K', setor_id, '","NROPUERTA":"', CASE WHEN setor_id % 3 = 0 THEN '00' ELSE CAST(setor_id AS STRING) END, '"}},"geometry":{{"type":"Polygon","coordinates":', {_square("x0", "y0")}, '}}}},{{"properties":{{}},"geometry":null}}]}}')""")
    got = feeds.parcel_features(s.select("setor_id", text.alias("text"))).where("problem IS NULL")
    return got.select("nomenclatura", "numero", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"))


@query("SELECT CAST(setor_id AS VARCHAR) AS external_id, round(x0 + 1e-2, 7) AS lng, round(y0 + 1e-2, 7) AS lat, CAST(setor_id % 5 AS INTEGER) AS pisos, concat('Rua ', setor_id) AS direccion FROM setores", "setores")
def building_feed(spark: SparkSession, d: str) -> DataFrame:
    node = lambda k, x, y: f"""'{{"type":"node","id":', setor_id * 10 + {k}, ',"lon":', CAST({x} AS STRING), ',"lat":', CAST({y} AS STRING), '}},'"""
    nodes = ", ".join(node(k, x, y) for k, (x, y) in enumerate([("x0", "y0"), ("x0 + 2e-2", "y0"), ("x0 + 2e-2", "y0 + 2e-2"), ("x0", "y0 + 2e-2")]))
    refs = ", ',', ".join(f"setor_id * 10 + {k}" for k in (0, 1, 2, 3, 0))
    text = F.expr(f"""concat('{{"elements":[', {nodes}, '{{"type":"way","id":', setor_id, ',"nodes":[', {refs}, '],"tags":{{"addr:street":"Rua","addr:housenumber":"', setor_id, '","building:levels":"', setor_id % 5, '"}}}}]}}')""")
    got = feeds.osm_buildings(feeds.osm_elements(table(spark, d, "setores").select(text.alias("text"))))
    return got.select("external_id", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), "pisos", "direccion")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS setor, CAST(sum(o_orderkey % 2000) AS BIGINT) AS domicilios_total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2000 ELSE 0 END) AS BIGINT) AS domicilios_casas,
    CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 2000 ELSE 0 END) AS BIGINT) AS domicilios_aptos FROM orders GROUP BY 1""",
)
def census_feed(spark: SparkSession, d: str) -> DataFrame:
    row = """concat('{"D1C":"', o_custkey, '","V":"', format_number(o_orderkey % 2000, 0), '","D2N":"', CASE o_orderstatus WHEN 'F' THEN 'Casa' WHEN 'O' THEN 'Apartamento' ELSE 'Casa de vila' END, '"}')"""
    head = F.lit('{"D1C":"Setor (Código)","V":"Valor","D2N":"Tipo"}')
    docs = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("["), head, F.lit(","), F.expr(row), F.lit("]")).alias("text"))
    return feeds.dwellings(feeds.sidra(docs))


@query("SELECT CAST(p_partkey AS INTEGER) AS id, p_partkey % 40 AS quadra, p_partkey % 9 AS lote, p_partkey AS codigo, 1000 + p_size + 5e-1 AS area, '78110000' AS cep, p_size AS unidades FROM part")
def lot_feed(spark: SparkSession, d: str) -> DataFrame:
    text = """concat('{"id":', p_partkey, ',"inscricao":"401-', p_partkey % 40, '-', p_partkey % 9, '#', p_partkey, '","geoJson":"","unidadesCount":', p_size, ',"fieldItemGroups":[{"fieldItems":[{"name":"Área","value":"1.', lpad(p_size, 3, '0'), ',5"},{"name":"CEP","value":"78.110-000"}]}]}')"""
    got = feeds.lots(spark.read.parquet(f"{d}/part.parquet").select(F.expr(text).alias("text")))
    return got.select("id", "quadra", "lote", "codigo", "area", "cep", "unidades")


@query("SELECT setor_id, round(x0, 9) AS west, round(y0, 9) AS south, round(x0 + 2e-2, 9) AS east, round(y0 + 2e-2, 9) AS north FROM setores", "setores")
def zone_bounds(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"""concat('{{"type":"Polygon","coordinates":', {_square("x0", "y0")}, '}}')""")
    b = table(spark, d, "setores").select("setor_id", feeds.coordinate_bounds(text).alias("b"))
    return b.select("setor_id", *[F.round(F.col(f"b.{c}"), 9).alias(c) for c in ("west", "south", "east", "north")])


@query("SELECT p_partkey, p_brand AS barrio FROM part")
def html_labels(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<tr><td>Bairro:</td><td> "), F.col("p_brand"), F.lit(" </td></tr>"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", bci.labelled(html, "Quarteirão", "Bairro").alias("barrio"))


# Lookups and classifiers


@query(
    """SELECT parcela_id, CASE WHEN calle IS NULL OR calle = '' THEN CASE WHEN parcela_id % 2 = 0 THEN 'S' WHEN parcela_id % 3 = 0 THEN 'G' END ELSE calle END AS calle,
    CASE WHEN coalesce(calle, '') = '' AND parcela_id % 2 = 0 THEN '5' WHEN parcela_id % 3 = 0 THEN '7' ELSE numero END AS numero,
    CASE WHEN coalesce(calle, '') = '' AND parcela_id % 2 = 0 THEN 'logradouros' WHEN parcela_id % 3 = 0 THEN 'geocode' END AS direccion_source FROM parcelas""",
    "parcelas",
)
def address_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas")
    street = p.where("parcela_id % 2 = 0").select("parcela_id", F.lit("S").alias("calle"), F.lit("5").alias("numero"))
    geo = p.where("parcela_id % 3 = 0").select("parcela_id", F.lit("G").alias("calle"), F.lit("7").alias("numero"))
    return classify.resolve_addresses(p, street, geo).drop("direccion_confidence")


@query(
    """, c AS (SELECT parent, count_if(n % 3 = 0) AS k FROM unit_counts GROUP BY parent)
    SELECT p.parcela_id, CASE WHEN v + s = 0 THEN 'sin_datos' WHEN v > 0 AND s > 0 THEN 'mixto' WHEN s > 0 THEN 'comercial' ELSE 'residencial' END AS uso_principal
    FROM (SELECT p.parcela_id, p.uf_vivienda AS v, CASE WHEN p.uf_comercio > 0 THEN p.uf_comercio ELSE coalesce(c.k, 0) END AS s FROM parcelas p LEFT JOIN c ON c.parent = p.parcela_id) p""",
    "parcelas", "unit_counts",
)
def use_from_places(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n") % 3 == 0, F.array(F.lit("bar"), F.lit("premise"))).when(F.col("n") % 3 == 1, F.array(F.lit("premise"))).otherwise(F.array(F.lit("park")))
    places = table(spark, d, "unit_counts").select(F.col("parent").alias("parcela_id"), kind.alias("types"))
    return classify.classify_use(table(spark, d, "parcelas"), places)


@query(
    """SELECT parcela_id, CASE WHEN parcela_id % 4 = 0 THEN 'RURAL' WHEN parcela_id % 4 = 1 THEN 'URBANO' END AS tipo, CASE WHEN parcela_id % 4 = 0 THEN 'vacante' WHEN parcela_id % 4 = 1 THEN 'residencial' END AS uso_principal FROM parcelas""",
    "parcelas",
)
def use_from_registry(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas").select("parcela_id", F.col("parcela_id").cast("string").alias("nomenclatura"))
    one = p.where("parcela_id % 4 < 2").select(F.lit(0).alias("pos"), F.col("nomenclatura").alias("vinculacion"), F.lit("CLUB DE CAMPO").alias("tipo"))
    two = p.where("parcela_id % 4 < 2").select(F.lit(1).alias("pos"), F.col("nomenclatura").alias("vinculacion"), F.when(F.col("parcela_id") % 4 == 0, "RURAL").otherwise("URBANO").alias("tipo"))
    return classify.classify_registry(p, one.union(two))


@query(
    """SELECT parcela_id, CASE WHEN parcela_id % 3 = 0 THEN 'vacante' WHEN parcela_id % 3 = 1 THEN 'edificado' ELSE 'sin_match' END AS resultado FROM parcelas WHERE coalesce(uso_principal, '') <> 'vacante' AND cca_code IS NOT NULL""",
    "parcelas",
)
def use_from_valuation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcelas")
    third = F.col("parcela_id") % 3
    v = p.where((third < 2) & F.col("cca_code").isNotNull()).select("cca_code", F.when(third == 0, "0.00").otherwise("15,673.60").alias("valor_edificado"), F.lit("1.00").alias("valor_terreno"))
    return classify.classify_valuation(p, v)


@query("SELECT p.parcela_id, coalesce(u.n, p.uf_vivienda) AS uf FROM parcelas p LEFT JOIN (SELECT parent, count(*) AS n FROM unit_counts WHERE s_m2 > 40 GROUP BY parent) u ON u.parent = p.parcela_id", "parcelas", "unit_counts")
def document_patch(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "unit_counts").where("s_m2 > 40").groupBy(F.col("parent").alias("parcela_id")).agg(F.count("*").alias("n"))
    return table(spark, d, "parcelas").join(patch, "parcela_id", "left").select("parcela_id", F.coalesce("n", "uf_vivienda").alias("uf"))


@query("SELECT survey_id, string_agg(CAST(parcela_id AS VARCHAR), ',' ORDER BY parcela_id) AS ids FROM parcelas GROUP BY survey_id", "parcelas")
def parcel_id_lists(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each survey's parcels; a survey is one district's parcels."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("parcela_id")), lambda i: i.cast("string")), ",")
    return table(spark, d, "parcelas").groupBy("survey_id").agg(ids.alias("ids"))


@query("SELECT survey_id, calle, round(avg(centroid_lat), 7) AS lat, round(avg(centroid_lng), 7) AS lng FROM parcelas GROUP BY survey_id, calle", "parcelas")
def mean_centroids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parcelas").groupBy("survey_id", "calle").agg(F.round(F.avg("centroid_lat"), 7).alias("lat"), F.round(F.avg("centroid_lng"), 7).alias("lng"))


@query(
    """SELECT parcela_id, CASE WHEN centroid_lat BETWEEN -15.7e0 AND -15.6e0 AND centroid_lng BETWEEN -56.2e0 AND -56.1e0 THEN 'a' WHEN centroid_lat BETWEEN -15.65e0 AND -15.55e0 AND centroid_lng BETWEEN -56.2e0 AND -56.0e0 THEN 'b' END AS slug FROM parcelas""",
    "parcelas",
)
def city_routing(spark: SparkSession, d: str) -> DataFrame:
    cities = spark.createDataFrame([(0, "a", -15.7, -56.2, -15.6, -56.1), (1, "b", -15.65, -56.2, -15.55, -56.0)], "ord int, slug string, south double, west double, north double, east double")
    return spatial.route(table(spark, d, "parcelas").select("parcela_id", "centroid_lat", "centroid_lng"), cities, "parcela_id", "centroid_lat", "centroid_lng").select("parcela_id", "slug")


# Generators and text rules


@query("SELECT id, lpad(CAST(id AS VARCHAR), 15, '0') AS code FROM (SELECT unnest(range(min(parcela_id), max(parcela_id) + 1)) AS id FROM parcelas)", "parcelas")
def padded_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every code from the first parcel's to the last one's."""
    ends = table(spark, d, "parcelas").agg(F.min("parcela_id").alias("a"), F.max("parcela_id").alias("b")).first()
    return grids.padded_ids(spark, ends.a, ends.b)


@query(
    """, b AS (SELECT min(y0) AS s0, min(x0) AS w0, max(y0) + 2e-2 AS n0, max(x0) + 2e-2 AS e0 FROM setores)
    SELECT i, CAST(j AS INTEGER) AS j, round(s0 + i * 3e-3, 9) AS s, round(w0 + j * 3e-3, 9) AS w, round(least(s0 + i * 3e-3 + 3e-3, n0), 9) AS n, round(least(w0 + j * 3e-3 + 3e-3, e0), 9) AS e
    FROM (SELECT *, unnest(range(0, CAST(trunc((n0 - s0) / 3e-3) AS BIGINT) + 1)) AS i FROM b), unnest(range(0, CAST(trunc((e0 - w0) / 3e-3) AS BIGINT) + 1)) x(j)""",
    "setores",
)
def plain_grid(spark: SparkSession, d: str) -> DataFrame:
    """One grid over the box of all sectors."""
    b = table(spark, d, "setores").agg(F.min("y0").alias("s"), F.min("x0").alias("w"), (F.max("y0") + SIDE).alias("n"), (F.max("x0") + SIDE).alias("e")).first()
    g = grids.plain_grid(spark, b.s, b.w, b.n, b.e, 3e-3)
    return g.select("i", "j", *[F.round(c, 9).alias(c) for c in ("s", "w", "n", "e")])


@query(
    """SELECT p.parcela_id, s.setor_id FROM parcelas p JOIN setores s ON p.centroid_lng >= s.x0 + 5e-5 AND p.centroid_lat >= s.y0 + 5e-5 AND (p.centroid_lng - s.x0 - 5e-5) + (p.centroid_lat - s.y0 - 5e-5) <= 2e-2""",
    "parcelas", "setores",
)
def tiled_zones(spark: SparkSession, d: str) -> DataFrame:
    """Parcels in triangular zones, by map tiles of zoom 12 to 16: whole tiles inside, an exact test along the boundary."""
    x, y = F.col("x0") + 5e-5, F.col("y0") + 5e-5
    zones = table(spark, d, "setores").select("setor_id", F.array(F.array(G.point(x, y), G.point(x + SIDE, y), G.point(x, y + SIDE), G.point(x, y))).alias("zone"))
    cover = grids.tile_cover(zones, "setor_id", "zone", 12, 16)
    return grids.in_tiles(table(spark, d, "parcelas"), zones, cover, "parcela_id", "centroid_lat", "centroid_lng", "setor_id", "zone", 12, 16)


@query("SELECT parcela_id, m.pos AS pos, round(centroid_lat + m.a, 7) AS plat, round(centroid_lng + m.b, 7) AS plng FROM parcelas, (VALUES (0, 0e0, 0e0), (1, 1e-4, 0e0), (2, -1e-4, 0e0), (3, 0e0, 1e-4), (4, 0e0, -1e-4), (5, 1e-4, 1e-4)) m(pos, a, b)", "parcelas")
def probe_points(spark: SparkSession, d: str) -> DataFrame:
    got = grids.probe_points(table(spark, d, "parcelas").select("parcela_id", "centroid_lat", "centroid_lng"), "centroid_lat", "centroid_lng")
    return got.select("parcela_id", "pos", F.round("plat", 7).alias("plat"), F.round("plng", 7).alias("plng"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1 + p_size % 26 WHEN 2 THEN 1 + p_size % 26 ELSE p_size * (1 + p_size % 26) + 1 + p_size % 26 END AS unidades_min FROM part""")
def unit_codes(spark: SparkSession, d: str) -> DataFrame:
    letter = "chr(65 + p_size % 26)"
    code = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN {letter} WHEN 2 THEN concat('pb ', {letter}) ELSE concat(p_size, ' ', {letter}) END")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", U.building_from_unit(code)["unidades_min"].alias("unidades_min"))


NOTICES = """CASE p_partkey % 8 WHEN 0 THEN 'luminoso' WHEN 1 THEN 'Hermoso PH' WHEN 2 THEN concat('Dpto. ', p_size) WHEN 3 THEN concat('piso ', p_size, ' dpto B') WHEN 4 THEN concat('piso 1 y piso ', p_size)
    WHEN 5 THEN concat(repeat('a', 40), ' 4º B con ph fondo') WHEN 6 THEN concat('Vendo ', p_size, 'C, monoambiente ') END"""


@query(
    f"""SELECT p_partkey, CASE k WHEN 1 THEN 'ph:ph:Hermoso PH' WHEN 2 THEN concat('dpto:dpto. ', s, ':', t) WHEN 3 THEN concat('piso:piso ', s, ':', t, '|dpto:dpto b:', t) WHEN 4 THEN concat('piso:piso 1:', t, '|piso:piso ', s, ':', t)
    WHEN 5 THEN concat('ph:ph:', repeat('a', 20), ' 4º B con ph fondo|piso_letra:4º b:', repeat('a', 29), ' 4º B con ph fondo') WHEN 6 THEN concat('piso_letra:', s, 'c:', trim(t), '|ambientes:monoambiente:', trim(t)) WHEN 7 THEN NULL ELSE '' END AS pistas,
    CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN greatest(1, s) WHEN 5 THEN 10 WHEN 6 THEN 3 * s END AS unidades_min FROM (SELECT p_partkey, p_partkey % 8 AS k, p_size AS s, {NOTICES} AS t FROM part)"""
)
def unit_hints(spark: SparkSession, d: str) -> DataFrame:
    """Hints at several units in notices, with their contexts, and the least number of units that they make."""
    found = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", U.hints(F.expr(NOTICES)).alias("h"))
    listed = F.transform("h", lambda h: F.concat_ws(":", h["tipo"], h["match"], h["raw"]))
    known = F.col("h").isNotNull()
    return found.select("p_partkey", F.when(known, F.array_join(listed, "|")).alias("pistas"), F.when(known, U.least_units_from_hints(F.col("h"))).alias("unidades_min"))


@query("""SELECT survey_id, concat('{"paso_actual":"coverage","pasos":{', CASE WHEN survey_id % 2 = 0 THEN '"zone":"1",' ELSE '' END, '"coverage":"2"}}') AS notes, CASE WHEN survey_id % 2 = 0 THEN 'zone' END AS antes FROM surveys""", "surveys")
def notes_merge(spark: SparkSession, d: str) -> DataFrame:
    notes = F.when(F.col("survey_id") % 2 == 0, '{"paso_actual":"zone","pasos":{"zone":"1"}}').otherwise("broken {")
    return table(spark, d, "surveys").select("survey_id", surveys.merge_notes(notes, F.lit("coverage"), F.lit("2")).alias("notes"), surveys.current_step(notes).alias("antes"))


@query(
    """SELECT survey_id, CAST(row_number() OVER w AS INTEGER) AS n, concat(row_number() OVER w, ';', coalesce(calle, ''), ';', coalesce(numero, ''), ';', parcela_id) AS line FROM parcelas WINDOW w AS (PARTITION BY survey_id ORDER BY calle NULLS LAST, numero NULLS LAST, parcela_id)""",
    "parcelas",
)
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    order = [F.asc_nulls_last("calle"), F.asc_nulls_last("numero"), F.asc("parcela_id")]
    return exports.csv_lines(table(spark, d, "parcelas"), "survey_id", ["calle", "numero", "parcela_id"], order)


@query(
    """, g AS (SELECT survey_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY survey_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM activity_log),
    s AS (SELECT survey_id, ts, sum(new) OVER (PARTITION BY survey_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT survey_id, min(ts) AS start, count(*) AS n FROM s GROUP BY survey_id, k""",
    "activity_log",
)
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activity_log").groupBy("survey_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return rows.select("survey_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT DISTINCT parent % 500 AS id FROM unit_counts UNION SELECT DISTINCT parent % 700 FROM unit_counts", "unit_counts")
def ids_over_cells(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "unit_counts")
    return grids.ids_over_cells(u.select(F.array(F.col("parent") % 500, F.col("parent") % 700).alias("ids")))
