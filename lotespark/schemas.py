"""Schemas of the silver tables. Geometry is arrays of x, y points: rings for polygons, one array for lines."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"
MULTIPOLYGON = f"array<{POLYGON}>"

TABLES = {
    "regions": "region_id string, name string, country_code string, state_code string, municipio_codigo string, bbox_wkt string, created_at timestamp_ntz, zone_geojson string",
    "surveys": "survey_id string, region_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, steps_count int, llm_tokens_used int, llm_cost_usd double, notes string",
    "setores": f"setor_id string, region_id string, geometry {MULTIPOLYGON}, pop_total int, domicilios_total int, domicilios_casas int, domicilios_aptos int, area_km2 double, source_file string, loaded_at timestamp_ntz",
    "parcelas": f"parcela_id string, survey_id string, region_id string, setor_id string, geometry {POLYGON}, centroid_lat double, centroid_lng double, area_m2_terreno double, area_m2_construida double, calle string, numero string, piso string, depto string, barrio string, codigo_postal string, municipio string, direccion_source string, direccion_confidence double, habitantes_estimados double, habitantes_low double, habitantes_high double, habitantes_metodo string, habitantes_confidence double, uso_principal string, footprints_count int, pisos_estimados_max int, unidades_funcionales_estimadas int, uf_vivienda int, uf_comercio int, cca_code string, nomenclatura_catastral string, partida_inmobiliaria string, fuente_parcela string, fecha_relevamiento date, validado_manual boolean",
    "edificios": f"edificio_id string, survey_id string, parcela_id string, setor_id string, footprint {POLYGON}, lat double, lng double, area_m2 double, pisos_estimados int, source string, external_id string",
    "unidades": "unidad_id string, edificio_id string, piso int, depto string, tipo string",
    "logradouros": f"logradouro_id string, region_id string, setor_id string, geometry {LINE}, tipo_logradouro string, titulo_logradouro string, nome_logradouro string, nro_inicial_esq int, nro_final_esq int, nro_inicial_dir int, nro_final_dir int, cep_esq string, cep_dir string, cod_municipio string, nom_municipio string, loaded_at timestamp_ntz",
    "step_log": "log_id string, survey_id string, step int, agent_called string, input_summary string, output_summary string, tokens_input int, tokens_output int, costo_usd double, duration_ms int, error string, created_at timestamp_ntz",
    "activity_log": "id bigint, ts timestamp, lvl string, msg string, survey_id bigint",
}
