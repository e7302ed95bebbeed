"""Domain tables as projections of the driver's tables, one text for both engines.

Each entry is SQL that Spark and DuckDB read alike; `tables` gives DataFrames,
`cte` the same text as common table expressions for an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "regions": ("nation",),
    "surveys": ("customer", "orders"),
    "parcelas": ("orders",),
    "edificios": ("lineitem", "orders"),
    "setores": ("supplier",),
    "logradouros": ("part",),
    "activity_log": ("events",),
    "unit_counts": ("lineitem",),
}

PROJECTIONS = {
    "regions": """SELECT n_nationkey AS region_key, concat('zona-', lower(replace(n_name, '_', '-'))) AS region_id, n_name AS name,
        CASE WHEN n_regionkey % 2 = 0 THEN 'BRA' ELSE 'ARG' END AS country_code FROM nation""",
    "surveys": """SELECT c.c_custkey AS survey_id, c.c_nationkey AS region_key,
        CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'running' WHEN 'BUILDING' THEN 'completed' WHEN 'FURNITURE' THEN 'partial' WHEN 'HOUSEHOLD' THEN 'failed' ELSE 'stopped' END AS status,
        o.started_at AS started_at, o.finished_at AS finished_at
        FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS started_at, max(o_orderdate) AS finished_at FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "parcelas": """SELECT o_orderkey AS parcela_id, o_custkey AS survey_id,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('Rua ', o_orderpriority) END AS calle,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS STRING) END AS numero,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE lpad(CAST(o_orderkey AS STRING), 15, '0') END AS cca_code,
        o_orderkey % 4 AS uf_vivienda, o_orderkey % 3 AS uf_comercio,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS area_m2_terreno,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 4) * 2e0 END AS habitantes_estimados,
        CASE o_orderstatus WHEN 'F' THEN 'sin_datos' WHEN 'O' THEN NULL ELSE 'vacante' END AS uso_principal,
        -157e-1 + (o_orderkey % 1000) * 2e-4 AS centroid_lat, -562e-1 + ((o_orderkey * 7) % 1000) * 2e-4 AS centroid_lng FROM orders""",
    "edificios": """SELECT l.l_orderkey * 10 + l.l_linenumber AS edificio_id, o.o_custkey AS survey_id, l.l_orderkey AS parcela_id, l.l_quantity AS area_m2,
        CASE WHEN l.l_suppkey % 2 = 0 THEN l.l_suppkey END AS setor_id FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "setores": """SELECT s_suppkey AS setor_id, s_nationkey AS region_key, -562e-1 + (s_suppkey % 10) * 2e-2 AS x0, -157e-1 + floor(s_suppkey / 10) * 2e-2 AS y0,
        CAST(floor(abs(s_acctbal)) AS BIGINT) AS pop_total,
        CASE s_suppkey % 6 WHEN 0 THEN 'R1' WHEN 1 THEN 'NC1' WHEN 2 THEN 'M2' WHEN 3 THEN 'PI' WHEN 4 THEN 'AGR' ELSE 'ZZ' END AS distrito FROM supplier""",
    "logradouros": """SELECT p_partkey AS logradouro_id, p_partkey % 25 AS region_key, p_name AS nome, p_type AS tipo,
        -562e-1 + (p_partkey % 10) * 2e-2 AS x0, -157e-1 + (p_partkey % 1000) * 2e-4 + 5e-5 AS y,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 1 END AS ini_esq, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 100 + p_size END AS fin_esq,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 2 END AS ini_dir, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 102 + p_size END AS fin_dir FROM part""",
    "activity_log": """SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_type AS lvl, user_id AS survey_id, value, props FROM events""",
    "unit_counts": """SELECT l_orderkey AS parent, l_linenumber AS n, l_quantity AS s_m2 FROM lineitem""",
}

SIDE = 2e-2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table; the driver's tables under it are read where they are used, columns pruned by the scan."""
    sources = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES[name]}
    text = PROJECTIONS[name]
    for s in sources:
        text = text.replace(f"FROM {s}", f"FROM {{{s}}}").replace(f"JOIN {s}", f"JOIN {{{s}}}")
    return spark.sql(text, **sources)


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({PROJECTIONS[n]})" for n in names) + "\n"
