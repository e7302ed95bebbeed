"""Paged feeds and the report writer: ends, missing pages, failed and repeated tasks."""

import json

import pytest
from pyspark.sql import functions as F

from lotespark.sources import feeds, paged


def land(path, pages, manifest=None):
    path.mkdir(exist_ok=True)
    for k, n in pages.items():
        (path / f"p{k}.json").write_text(json.dumps({"features": [{"k": k + i} for i in range(n)]}))
    lines = [{"start": k, "file": f"p{k}.json"} for k in pages] if manifest is None else manifest
    (path / "manifest.jsonl").write_text("\n".join(map(json.dumps, reversed(lines))))
    return str(path)


def read(spark, path):
    return feeds.pages(spark, path, batch=3)


def test_a_feed_ends_at_a_short_or_empty_page(spark, tmp_path):
    short = read(spark, land(tmp_path / "a", {0: 3, 3: 3, 6: 2, 9: 3}))
    assert sorted((r.pos, json.loads(r.text)["k"]) for r in short.collect()) == [(k, k) for k in range(8)]
    assert short.rdd.getNumPartitions() == 3
    assert read(spark, land(tmp_path / "b", {0: 3, 3: 0})).count() == 3
    assert read(spark, land(tmp_path / "c", {0: 0})).count() == 0


def test_missing_pages_are_errors(spark, tmp_path):
    for name, pages in (("gap", {0: 3, 6: 1}), ("unseen end", {0: 3, 3: 3})):
        with pytest.raises(Exception, match="is missing"):
            read(spark, land(tmp_path / name, pages)).count()
    with pytest.raises(Exception, match="no file p3.json"):
        read(spark, land(tmp_path / "lost", {0: 3}, [{"start": 0, "file": "p0.json"}, {"start": 3, "file": "p3.json"}])).count()


def reports(spark, rows):
    paged.register(spark)
    return spark.createDataFrame(rows, "k int, line string")


def test_reports_of_tasks_that_fail_leave_nothing(spark, tmp_path):
    df = reports(spark, [(k % 5, f"line {k}") for k in range(50)]).repartition(3, "k").sortWithinPartitions("k", "line")
    df.write.format("survey_reports").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"relevamiento_{k}.csv" for k in range(5)]
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    bad = df.withColumn("line", F.when((F.col("k") == 4) & (F.col("line") > "line 4"), F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("survey_reports").mode("append").save(str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before
    fewer = reports(spark, [(1, "only")])
    fewer.write.format("survey_reports").mode("overwrite").save(str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"relevamiento_1.csv": b"\xef\xbb\xbfonly\r\n"}


def test_reports_whose_rows_are_scattered_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="don't come together|two tasks"):
        reports(spark, [(1, "a"), (2, "b"), (1, "c")]).coalesce(1).write.format("survey_reports").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.suffix == ".csv"]


def test_report_lines_are_read_by_key_and_missing_ones_are_errors(spark, tmp_path):
    df = reports(spark, [(k, t) for k in range(300) for t in ("a", "", f"línea {k}")]).repartition(3, "k").sortWithinPartitions("k")
    df.write.format("survey_reports").mode("append").save(str(tmp_path))
    keys = df.select("k")
    got = paged.report_lines(keys, str(tmp_path), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert got.rdd.getNumPartitions() == 16  # however small the table of keys is
    with pytest.raises(Exception, match="relevamiento_300"):
        paged.report_lines(keys.union(spark.sql("SELECT 300")), str(tmp_path), "k").collect()


def test_what_a_report_task_tells_the_driver_is_a_name_for_each_file(tmp_path):
    writer = paged.ReportWriter({"path": str(tmp_path)}, False)
    done = writer.write(iter([(k, "x") for k in range(100)]))
    assert len(done.names) == 100 and sum(map(len, done.names)) < 30 * 100
    writer.commit([done])
    assert len(list(tmp_path.glob("*.csv"))) == 100
