"""File sources and sinks on small files that the tests write."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import ledger
from fieldaudit.sources import files


def test_delimiters_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("age;job;y\n30;x;yes\nbad;y;no\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "age int, job string, y string").collect()
    assert [(r.age, r.job) for r in got] == [(30, "x"), (None, "y")]
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id,v\n1,a\n2,b\n3,c\n")
    keys = spark.createDataFrame([(3,), (1,), (1,)], "id int")
    assert sorted(r.v for r in files.read_chosen(spark, str(tmp_path / "b.csv.gz"), "id int, v string", keys, "id").collect()) == ["a", "c"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("data.csv", "FlightDate,ArrDel15,Other\n2024-01-02,1,x\n2024-01-03,,y\n")
    got = files.read_zip(spark, str(tmp_path / "f.zip"), "FlightDate date, ArrDel15 double").collect()
    assert [r.ArrDel15 for r in got] == [1.0, None] and str(got[0].FlightDate) == "2024-01-02"


def test_results_choice_and_lineage(spark, tmp_path):
    for i, status in enumerate(("COMPLETED", "FAILED", "COMPLETED")):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"run": i, "status": status}))
    assert sorted(r.run for r in files.read_results(spark, str(tmp_path / "*.json"), "run int, status string").collect()) == [0, 2]
    (tmp_path / "x.csv").write_text("a\n" * 50)
    (tmp_path / "x.csv.gz").write_bytes(b"1" * 100)
    assert files.choose_file(spark, str(tmp_path / "x.*"), [".csv.gz", ".csv"]).endswith("x.csv.gz")
    assert files.lineage(spark, str(tmp_path / "x.csv")).first().bytes == 100
    (tmp_path / "r9.json").write_text('{"run": 9, "status": ')
    assert sorted(r.run for r in files.read_results(spark, str(tmp_path / "*.json"), "run int, status string").collect()) == [0, 2]
    assert [r.name for r in files.broken_results(spark, str(tmp_path / "*.json"), "run int, status string").collect()] == ["r9.json"]
    times = spark.createDataFrame([("2024-01-03 01:02:03",), (None,), ("2023-12-31 00:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert tuple(files.time_lineage(times, "t").first()) == ("t", "2023-12-31T00:00:00", "2024-01-03T01:02:03")
    assert tuple(files.time_lineage(times.where("t IS NULL"), "t").first()) == ("t", None, None)


def test_append_and_export(spark, tmp_path):
    plan = spark.range(6).select(F.col("id").alias("run_id"))
    evaluate = lambda df: df.withColumn("score", F.col("run_id") * 2.0)
    assert files.append_ledger(f"{tmp_path}/done", plan.where("run_id < 4"), evaluate).count() == 4
    assert files.append_ledger(f"{tmp_path}/done", plan, evaluate).count() == 6
    files.export(spark.read.parquet(f"{tmp_path}/done"), ["run_id"], f"{tmp_path}/out")
    with pytest.raises(ledger.GateError):
        files.export(spark.createDataFrame([(1, "")], "run_id long, t string"), ["run_id"], f"{tmp_path}/bad")
