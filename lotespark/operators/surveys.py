"""Survey lists, status, coverage and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import delta_share, minutes_between, ratio

FINAL = ("completed", "failed", "stopped")
STOPPED = ("stopped", "failed")


def latest(surveys: DataFrame, by: str = "region_key") -> DataFrame:
    """The last started survey of each region; one without a start counts as latest, ties go to the least id."""
    order = F.struct(F.col("started_at").isNotNull().alias("a"), (-F.unix_micros("started_at")).alias("b"), F.col("survey_id").alias("c"))
    rest = [c for c in surveys.columns if c != by]
    best = F.min_by(F.struct(*rest), order)
    return surveys.withColumn("started_at", F.col("started_at").cast("timestamp")).groupBy(by).agg(best.alias("s")).select(by, "s.*")


def coverage(regions: DataFrame, surveys: DataFrame, setores: DataFrame, logradouros: DataFrame, edificios: DataFrame, parcelas: DataFrame, log: DataFrame) -> DataFrame:
    """Coverage of each region's latest survey: one grouped pass per table, then ratios with guarded divisors.

    A region without a survey has the empty report, `no_survey_found`.
    """
    n = F.count("*").cast("bigint")
    last = latest(surveys).select("region_key", "survey_id")
    by_sector = setores.groupBy("region_key").agg(n.alias("setores"), F.coalesce(F.sum("pop_total"), F.lit(0)).cast("bigint").alias("pop_total_ibge"))
    by_street = logradouros.groupBy("region_key").agg(n.alias("logradouros_count"))
    only = lambda df: df.join(last.select("survey_id"), "survey_id", "left_semi")
    built = only(edificios).groupBy("survey_id").agg(n.alias("footprints"), F.count("setor_id").alias("footprints_con_setor"))
    lots = only(parcelas).groupBy("survey_id").agg(
        n.alias("parcelas"), F.count("calle").alias("parcelas_con_direccion"), F.count("habitantes_estimados").alias("parcelas_con_habitantes"), F.coalesce(F.sum("habitantes_estimados"), F.lit(0.0)).alias("suma_hab")
    )
    steps = only(log).groupBy("survey_id").agg(n.alias("step"))
    out = regions.select("region_key", "region_id").join(last, "region_key", "left")
    for part, key in ((by_sector, "region_key"), (by_street, "region_key"), (built, "survey_id"), (lots, "survey_id"), (steps, "survey_id")):
        out = out.join(part, key, "left")
    known = F.col("survey_id").isNotNull()
    count = lambda c: F.when(known, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint")
    counts = {c: count(c) for c in ("step", "setores", "pop_total_ibge", "logradouros_count", "footprints", "footprints_con_setor", "parcelas", "parcelas_con_direccion", "parcelas_con_habitantes")}
    out = out.select("region_id", "survey_id", *[v.alias(k) for k, v in counts.items()], F.lit(0).cast("bigint").alias("edificios_con_direccion"), F.when(known, F.coalesce("suma_hab", F.lit(0.0))).otherwise(0.0).alias("suma_hab"))
    address = F.when(F.col("parcelas") > 0, F.round(F.col("parcelas_con_direccion") / F.col("parcelas"), 4)).when(F.col("footprints") > 0, F.round(F.col("edificios_con_direccion") / F.col("footprints"), 4)).otherwise(0.0)
    return out.select(
        "*",
        ratio(F.col("footprints_con_setor"), F.col("footprints")).alias("cobertura_footprints_pct"),
        address.alias("cobertura_direccion_pct"),
        ratio(F.col("parcelas_con_habitantes"), F.col("parcelas")).alias("cobertura_habitantes_pct"),
        delta_share(F.col("suma_hab"), F.col("pop_total_ibge")).alias("suma_hab_vs_ibge_delta_pct"),
        F.when(F.col("survey_id").isNull(), "no_survey_found").alias("errores"),
    ).drop("suma_hab")


def survey_list(surveys: DataFrame, regions: DataFrame, edificios: DataFrame, parcelas: DataFrame) -> DataFrame:
    """Surveys with counts and sums over both children at once: sums are multiplied by the number of buildings, as asked.

    The fan-out is never made: a survey's sums over the pairs are its parcels' sums times its buildings (at least one row each).
    """
    return _list(surveys, regions, edificios, parcelas, F.greatest(F.coalesce("_rows", F.lit(0)), F.lit(1)))


def survey_list_exact(surveys: DataFrame, regions: DataFrame, edificios: DataFrame, parcelas: DataFrame) -> DataFrame:
    """The same with each parcel summed once."""
    return _list(surveys, regions, edificios, parcelas, F.lit(1))


def _list(surveys: DataFrame, regions: DataFrame, edificios: DataFrame, parcelas: DataFrame, times: Column) -> DataFrame:
    built = edificios.groupBy("survey_id").agg(F.count_distinct("edificio_id").alias("edificios"), F.count("*").alias("_rows"))
    lots = parcelas.groupBy("survey_id").agg(
        F.count_distinct("parcela_id").alias("parcelas"),
        F.count_distinct(F.when(F.col("calle").isNotNull(), F.col("parcela_id"))).alias("con_direccion"),
        F.count_distinct(F.when(F.col("cca_code").isNotNull(), F.col("parcela_id"))).alias("con_codigo"),
        F.sum("uf_vivienda").alias("v"),
        F.sum("uf_comercio").alias("c"),
    )
    out = surveys.join(regions, "region_key").join(built, "survey_id", "left").join(lots, "survey_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("survey_id", "region_id", "name", "status", "started_at", zero("edificios").alias("edificios"), zero("parcelas").alias("parcelas"), zero("con_direccion").alias("con_direccion"), zero("con_codigo").alias("con_codigo"), zero(F.col("v") * times).alias("uf_vivienda"), zero(F.col("c") * times).alias("uf_comercio"))


def status(surveys: DataFrame, regions: DataFrame, parcelas: DataFrame, edificios: DataFrame, now: Column, only_running: bool = False, most: int = 20) -> DataFrame:
    """The last surveys with their minutes and counts, newest first."""
    shown = surveys.where("status = 'running'") if only_running else surveys
    shown = shown.orderBy(F.desc_nulls_first("started_at"), "survey_id").limit(most)
    count = lambda df, name: df.join(F.broadcast(shown.select("survey_id")), "survey_id", "left_semi").groupBy("survey_id").agg(F.count("*").alias(name))
    out = shown.join(regions.select("region_key", "region_id"), "region_key").join(count(parcelas, "parcelas"), "survey_id", "left").join(count(edificios, "edificios"), "survey_id", "left")
    return out.select("survey_id", "region_id", "status", minutes_between(F.col("started_at"), F.col("finished_at"), now).alias("minutos"), F.coalesce("parcelas", F.lit(0)).alias("parcelas"), F.coalesce("edificios", F.lit(0)).alias("edificios"))


def fold_states(surveys: DataFrame, updates: DataFrame) -> DataFrame:
    """Status after updates (survey_id, seq, status) in order: stopped is final; null updates change nothing; unknown surveys are not_found."""
    last = F.max(F.when(F.col("status").isNotNull(), F.struct("seq", "status")))["status"]
    folded = updates.groupBy("survey_id").agg(last.alias("last"), F.max(F.col("status") == "stopped").alias("stopped"), F.count("*").alias("n"))
    both = surveys.select("survey_id", F.col("status").alias("before")).join(folded, "survey_id", "right")
    after = F.when((F.col("before") == "stopped") | F.col("stopped"), "stopped").otherwise(F.coalesce("last", "before"))
    out = both.select("survey_id", F.col("n").cast("bigint").alias("updates"), F.when(F.col("before").isNull(), "not_found").otherwise(after).alias("status"))
    return out.select("*", F.col("status").isin(*FINAL).alias("finished"), (F.col("status").isin(*STOPPED) | (F.col("status") == "not_found")).alias("should_stop"))


def orphans(surveys: DataFrame) -> DataFrame:
    """Surveys that were running or stopping when the service went down, as stopped."""
    return surveys.where(F.col("status").isin("running", "stopping")).withColumn("status", F.lit("stopped"))


def guard(status: Column, action: str) -> Column:
    """May a survey be started, stopped or deleted in this state? The reason if not."""
    busy = {"start": status.isin("running", "stopping"), "stop": ~status.isin("running"), "delete": status.isin("running", "stopping")}[action]
    return F.when(busy, F.concat(F.lit(f"409 cannot {action}: "), status))


def merge_notes(notes: Column, step: Column, result: Column) -> Column:
    """Survey notes (JSON text) with the step's result put in and made current; malformed notes start anew."""
    kind = "struct<paso_actual:string,pasos:map<string,string>>"
    pasos = F.coalesce(F.from_json(notes, kind)["pasos"], F.create_map().cast("map<string,string>"))
    kept = F.map_filter(pasos, lambda k, v: k != step)
    return F.to_json(F.struct(step.alias("paso_actual"), F.map_concat(kept, F.create_map(step, result)).alias("pasos")))


def current_step(notes: Column) -> Column:
    return F.get_json_object(notes, "$.paso_actual")


def set_status(surveys: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Surveys after setting new statuses (survey_id, status): each change stamps finished_at, whatever the status."""
    new = changes.select("survey_id", F.col("status").alias("_s"))
    out = surveys.join(new, "survey_id", "left").withColumn("finished_at", F.when(F.col("_s").isNotNull(), now.cast(surveys.schema["finished_at"].dataType)).otherwise(F.col("finished_at")))
    return out.withColumn("status", F.coalesce("_s", "status")).select(surveys.columns)
