"""The activity log as a stream: filter, bounded buffers, state machine, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..runtime import ready

LOG_DDL = "id bigint, ts timestamp, lvl string, msg string, survey_id bigint"


def read_log(spark: SparkSession, path: str, schema: str = LOG_DDL, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def only(log: DataFrame, prefix: str, column: str = "msg") -> DataFrame:
    return log.where(F.col(column).startswith(prefix))


def with_keyed_state(spark: SparkSession) -> None:
    """State by key (lists, values, times to live) needs the RocksDB store; sets it where the session has the default one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ring(StatefulProcessor):
    """The last `size` ids of a key, in a list state that holds no more."""

    def __init__(self, key: str, order: str, size: int, ttl_ms: int | None):
        self.key, self.order, self.size, self.ttl_ms = key, order, size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        held = [i for (i,) in self.ids.get()] if self.ids.exists() else []
        for b in rows:
            held = sorted({*held, *map(int, b[self.order])})[-self.size :]
        self.ids.put([(i,) for i in held])
        yield pd.DataFrame({self.key: [key[0]], "ids": [held]})

    def close(self) -> None:
        pass


def ring_buffer(log: DataFrame, size: int = 100, key: str = "survey_id", order: str = "id", ttl_ms: int | None = None) -> DataFrame:
    """Per key the last `size` ids after each batch, as rows key, ids. With `ttl_ms` a key that nothing came for so long is forgotten; give such a query a trigger by time, as it has a batch at every trigger."""
    with_keyed_state(log.sparkSession)
    mode = "ProcessingTime" if ttl_ms else "None"
    return log.select(key, order).transform(ready).groupBy(key).transformWithStateInPandas(Ring(key, order, size, ttl_ms), f"{key} bigint, ids array<bigint>", "Update", mode)


class States(StatefulProcessor):
    """Status of a survey with the number of the update that set it; stopped is final. Without a state it is `first`, the table's.

    An update that is older than the one held changes nothing, in whatever batch it
    comes, unless it stops the survey: that it was stopped at any time is enough.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "status string, seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.held.exists()
        status, seq = self.held.get() if known else (None, None)
        for b in rows:
            if not known:
                known, status = True, b["first"].iloc[0] if isinstance(b["first"].iloc[0], str) else None
            for new, at, stop in zip(b["status"], b["seq"], b["stop"]):
                if status == "stopped":
                    break
                if stop or new == "stopped":
                    status, seq = "stopped", None
                elif isinstance(new, str) and (seq is None or int(at) >= seq):
                    status, seq = new, int(at)
        self.held.update((status, seq))
        yield pd.DataFrame({"survey_id": [key[0]], "status": [status], "should_stop": [status in ("stopped", "failed")]})

    def close(self) -> None:
        pass


def survey_states(updates: DataFrame, surveys: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """Running status of each survey from updates (survey_id, seq, status): stopped is final.

    `surveys` (survey_id, status) is the table that a survey starts from, looked up when its first
    row comes, so surveys without rows have no state; `stops` (survey_id) is the control stream whose
    rows ask a survey to stop.
    """
    with_keyed_state(updates.sparkSession)
    rows = updates.select("survey_id", "seq", "status", F.lit(False).alias("stop"))
    if stops is not None:
        rows = rows.unionByName(stops.select("survey_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("stop")))
    if surveys is not None:
        rows = rows.join(surveys.groupBy("survey_id").agg(F.first("status").alias("first")), "survey_id", "left")
    else:
        rows = rows.withColumn("first", F.lit(None).cast("string"))
    return rows.transform(ready).groupBy("survey_id").transformWithStateInPandas(States(), "survey_id bigint, status string, should_stop boolean", "Update", "None")


def by_batch(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Run a stream to the end of what is there, each batch in a folder of its own, which a batch that is repeated writes anew; the rows with their batch."""
    spark = stream.sparkSession
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def activity_windows(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries per level in tumbling windows of event time; later than `late` is dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "lvl").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "lvl", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return log.withWatermark("ts", late).groupBy("survey_id", w).agg(F.count("*").alias("n")).select("survey_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
