from pyspark.sql import functions as F

from lotespark.streaming import activity


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def log(spark, tmp_path, files=4):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "info" if i % 3 else "error", f"m{i % 2}", i % 5) for i in range(200)]
    path = str(tmp_path / "log")
    for k in range(files):
        spark.createDataFrame(rows[k::files], "id bigint, t string, lvl string, msg string, survey_id bigint").select("id", F.col("t").cast("timestamp").alias("ts"), "lvl", "msg", "survey_id").coalesce(1).write.mode("append").parquet(path)
    return path


def test_ring_buffer_keeps_the_last(spark, tmp_path):
    got = run(activity.ring_buffer(activity.read_log(spark, log(spark, tmp_path), files_per_trigger=1), 7), "ring", "update")
    last = {}
    for r in got.collect():
        last[r.survey_id] = max(last.get(r.survey_id, []), list(r.ids), key=lambda v: (len(v), max(v, default=0), sum(v)))
    assert last == {s: [i for i in range(200) if i % 5 == s][-7:] for s in range(5)}


def test_windows_match_the_batch(spark, tmp_path):
    path = log(spark, tmp_path)
    stream = activity.read_log(spark, path)
    got = run(activity.activity_windows(stream, late="10 hours"), "win", "complete")
    want = spark.read.parquet(path).groupBy(F.date_trunc("hour", "ts").alias("start"), "lvl").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert run(activity.only(activity.read_log(spark, path), "m1"), "flt", "append").count() == 100


def test_stream_states(spark, tmp_path):
    path = str(tmp_path / "u")
    spark.createDataFrame([(1, 1, "running"), (1, 2, "stopped"), (1, 3, "completed"), (2, 1, "failed")], "survey_id bigint, seq bigint, status string").write.parquet(path)
    s = spark.readStream.schema("survey_id bigint, seq bigint, status string").parquet(path)
    assert sorted(map(tuple, run(activity.survey_states(s), "st", "update").collect())) == [(1, "stopped", True), (2, "failed", True)]


UPDATES = "survey_id bigint, seq bigint, status string"


def put(spark, path, rows, schema=UPDATES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def last(df):
    return sorted(map(tuple, df.groupBy("survey_id").agg(F.max_by("status", "batch"), F.max_by("should_stop", "batch")).collect()))


def test_states_go_on_from_a_checkpoint(spark, tmp_path):
    """Late batches with older numbers, the table that states start from, stops by the control stream, and a restart in between."""
    batches = [[(1, 5, "running"), (2, 1, "running"), (4, 9, "running")], [(1, 3, "queued"), (2, 2, None), (3, 1, "running"), (4, 9, "running")], [(1, 4, "partial"), (3, 2, "completed"), (5, 1, "running"), (6, 1, "failed")], [(1, 9, "failed"), (5, 0, "queued"), (3, 1, "stopped")]]
    surveys = spark.createDataFrame([(1, "queued"), (5, "stopped"), (9, "running")], "survey_id bigint, status string")

    def stream(at):
        updates = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(f"{at}/u")
        stops = spark.readStream.schema("survey_id bigint").parquet(f"{at}/stops")
        return activity.by_batch(activity.survey_states(updates, surveys, stops), f"{at}/out", f"{at}/state")

    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    for at in (whole, parts):
        put(spark, f"{at}/stops", [], "survey_id bigint")
    for b in batches:
        put(spark, f"{whole}/u", b)
    put(spark, f"{whole}/stops", [(2,)], "survey_id bigint")
    once = last(stream(whole))
    for k, b in enumerate(batches):
        put(spark, f"{parts}/u", b)
        if k == 1:
            put(spark, f"{parts}/stops", [(2,)], "survey_id bigint")
        restarted = last(stream(parts))
    assert once == restarted == [(1, "failed", True), (2, "stopped", True), (3, "stopped", True), (4, "running", False), (5, "stopped", True), (6, "failed", True)]


def test_ring_goes_on_from_a_checkpoint_and_a_repeated_batch_counts_once(spark, tmp_path):
    at = str(tmp_path)
    rows = [(i, i % 3) for i in range(90)]
    for k in range(3):
        put(spark, f"{at}/log", rows[k * 30 : k * 30 + 30], "id bigint, survey_id bigint")
        got = activity.by_batch(activity.ring_buffer(spark.readStream.schema("id bigint, survey_id bigint").parquet(f"{at}/log"), 4), f"{at}/out", f"{at}/state")
    ids = {r[0]: r[1] for r in got.groupBy("survey_id").agg(F.max_by("ids", "batch")).collect()}
    assert ids == {s: [i for i in range(90) if i % 3 == s][-4:] for s in range(3)}
    n = got.count()
    got.where("batch = 1").drop("batch").write.mode("overwrite").parquet(f"{at}/out-copy")
    spark.read.parquet(f"{at}/out-copy").write.mode("overwrite").parquet(f"{at}/out/batch=1")  # as a retry would
    assert spark.read.parquet(f"{at}/out").count() == n


def test_ring_with_a_time_to_live(spark, tmp_path):
    put(spark, str(tmp_path / "log"), [(1, 1), (2, 1)], "id bigint, survey_id bigint")
    # state that expires by the clock makes a batch at every trigger, so a run "to the end of what is there" wouldn't end
    stream = activity.ring_buffer(spark.readStream.schema("id bigint, survey_id bigint").parquet(str(tmp_path / "log")), 4, ttl_ms=60_000)
    q = stream.writeStream.format("memory").queryName("ttl").outputMode("update").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("ttl").count():
                break
            q.awaitTermination(1)
        assert [list(r.ids) for r in spark.table("ttl").collect()] == [[1, 2]]
    finally:
        q.stop()


def test_sessions_and_repeats_plan(spark, tmp_path):
    path = log(spark, tmp_path)
    assert run(activity.without_repeats(activity.read_log(spark, path)), "rep", "append").count() <= 200
    assert activity.sessions(activity.read_log(spark, path)).isStreaming


def test_only_updated_surveys_have_state(spark, tmp_path):
    """A survey starts from the table when its first row comes; a table of many surveys makes no work by itself."""
    put(spark, str(tmp_path / "u"), [(1, 1, None), (2, 1, "running"), (3, 1, "running"), (4, 1, "failed")])
    surveys = spark.range(1, 2000).select(F.col("id").alias("survey_id"), F.when(F.col("id") < 3, "stopped").otherwise("queued").alias("status"))
    q = activity.survey_states(spark.readStream.schema(UPDATES).parquet(str(tmp_path / "u")), surveys).writeStream.format("memory").queryName("few").outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("few").collect())) == [(1, "stopped", True), (2, "stopped", True), (3, "running", False), (4, "failed", True)]
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) < 100
