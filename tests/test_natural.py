"""Natural panels from files: five kinds of source, their order, labels, samples, codes, availability and lineage."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import natural
from fieldaudit.operators.columns import tolerant_date
from fieldaudit.operators.ledger import GateError

GOOD, BAD = ("fully paid", "0", "false"), ("charged off", "default", "1", "true")
LOANS = natural.Source(
    "loans", "lc_", natural.words("loan_status", BAD, GOOD), tuple(natural.SOURCE), ("loan_status",), lambda df: tolerant_date(F.col("issue_d"), "MMM-yyyy"), "issue_d",
    late_parts=("recoveries", "last_credit_pull", "payment_plan_start_date"), most=20,
)
LOAN_FILES = {"suffixes": [".parquet", ".csv.gz", ".csv"], "like": "^accepted"}


def values(panel, name):
    return [r[0] for r in panel.rows.orderBy("pos").select(f"`{name}`").collect()]


def late(panel):
    return {r.feature_id for r in natural.contamination(panel.registry).where("is_leak").collect()}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_loans_from_gzip_drop_unresolved_and_sort(spark, tmp_path):
    write(tmp_path / "loans" / "rejected_oversized.csv", "id,loan_status\n999,Fully Paid\n" + "1,x\n" * 200)
    with pytest.raises(GateError):
        natural.from_files(spark, str(tmp_path / "loans"), "id int", LOANS, LOAN_FILES)
    rows = ["id,issue_d,loan_status,annual_inc,recoveries,last_credit_pull_d,payment_plan_start_date", "1,Mar-2018,Fully Paid,10,0,Apr-2018,May-2018", "2,Feb-2018,Current,20,0,Apr-2018,May-2018",
            "3,Jan-2018, Charged Off ,30,25,Apr-2018,May-2018", "4,Feb-2018,Fully Paid,40,0,Apr-2018,May-2018", "5,soon,Default,,0,,"]
    with gzip.open(tmp_path / "loans" / "accepted_a.csv.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    schema = "id int, issue_d string, loan_status string, annual_inc double, recoveries double, last_credit_pull_d string, payment_plan_start_date string"
    panel, lineage = natural.from_files(spark, str(tmp_path / "loans"), schema, LOANS, LOAN_FILES)
    assert values(panel, "lc_id") == [3, 4, 1, 5] and [r.y for r in panel.rows.orderBy("pos").collect()] == [1, 0, 0, 1]
    assert values(panel, "lc_annual_inc") == [30, 40, 10, -1] and values(panel, "lc_issue_d") == [1, 0, 2, 3]
    assert late(panel) == {"lc_recoveries", "lc_last_credit_pull_d", "lc_payment_plan_start_date"}
    told = lineage.first()
    assert (told.resolved_rows, told.rows_loaded, told.sort_column, told.name, len(told.sha256)) == (4, 4, "issue_d", "accepted_a.csv.gz", 64)
    assert str(told.time_min).startswith("2018-01") and str(told.time_max).startswith("2018-03") and told.positives == 2


def test_systematic_sample_spans_the_period(spark):
    rows = [(i, f"Jan-20{10 + i}", ("Fully Paid", "Charged Off")[i % 2], i) for i in (7, 3, 0, 9, 1, 8, 2, 5, 4, 6)]
    df = spark.createDataFrame(rows, "id int, issue_d string, loan_status string, at int").repartition(3)
    source = natural.Source("loans", "lc_", LOANS.label, ("at",), ("loan_status",), LOANS.time, "issue_d", most=3)
    panel = natural.panel(df, source)
    assert values(panel, "lc_id") == [0, 4, 9] and panel.audit.first().sampling_rule == "systematic_over_chronologically_sorted_resolved_outcomes"
    with pytest.raises(GateError):
        natural.panel(df.where("false"), source)
    with pytest.raises(GateError):
        natural.panel(df.drop("loan_status"), source)


def test_marketing_takes_the_named_file_and_keeps_its_order(spark, tmp_path):
    write(tmp_path / "bank" / "nested" / "bank-additional.csv", "age;duration;y\n99;1;no\n")
    source = natural.Source("marketing", "bm_", natural.words("y", ("yes",), ("no",)), tuple(natural.SOURCE), ("y",), late=("duration",), checked=True)
    files = {"suffixes": [".csv"], "like": "full", "first": ("bank-additional-full.csv", "bank-full.csv")}
    with pytest.raises(GateError):
        natural.from_files(spark, str(tmp_path / "bank"), "age int", source, files)
    write(tmp_path / "bank" / "other-full.csv", "age;job;duration;y\n" + "1;x;1;no\n" * 50)
    write(tmp_path / "bank" / "nested" / "bank-additional-full.csv", "age;job;duration;y\n20;c;5;no\n30;b;10;yes\n40;a;15;no\n")
    panel, lineage = natural.from_files(spark, str(tmp_path / "bank"), "age int, job string, duration int, y string", source, files)
    assert values(panel, "bm_age") == [20, 30, 40] and values(panel, "bm_job") == [2, 1, 0] and late(panel) == {"bm_duration"}
    told = lineage.first()
    assert told.chronological_sort is False and told.sort_column is None and told.name == "bank-additional-full.csv"
    write(tmp_path / "bank" / "nested" / "bank-additional-full.csv", "age;job;duration;y\n20;c;5;maybe\n")
    with pytest.raises(GateError):
        natural.from_files(spark, str(tmp_path / "bank"), "age int, job string, duration int, y string", source, files)


def test_service_requests_sort_by_creation(spark, tmp_path):
    write(tmp_path / "requests.csv", "unique_key,created_date,closed_date,agency,status,resolution_description\n30,2024-03-01,2024-03-03,A,Closed,x\n10,2024-01-01,2024-01-20,B,Closed,y\n20,2024-02-01,,C,Open,z\n40,,2024-02-02,C,Closed,\n")
    source = natural.Source(
        "requests", "nyc_", natural.within_days("closed_date", "created_date", 7), tuple(natural.SOURCE), ("created_date", "closed_date"), lambda df: F.col("created_date").try_cast("timestamp"), "created_date",
        late=("status", "resolution_description"), first=100,
    )
    panel, lineage = natural.from_files(spark, str(tmp_path), "unique_key int, created_date string, closed_date string, agency string, status string, resolution_description string", source, {"suffixes": [".csv"]})
    assert values(panel, "nyc_unique_key") == [10, 20, 30, 40] and [r.y for r in panel.rows.orderBy("pos").collect()] == [0, 0, 1, 0]
    assert late(panel) == {"nyc_status", "nyc_resolution_description"} and values(panel, "nyc_resolution_description")[3] == natural.MISSING
    assert str(lineage.first().time_min).startswith("2024-01")


def test_inspections_rename_and_keep_the_outcome_as_a_late_feature(spark):
    rows = [(3, "2024-03-01", "Pass", "none", 1.0), (1, "2024-01-01", "Fail - twice", "bad", 2.0), (2, "2024-02-01", None, None, None)]
    df = spark.createDataFrame(rows, "inspection_id int, inspection_date string, results string, violations string, risk double")
    source = natural.Source(
        "inspections", "chi_", natural.starts("chi_results", "fail"), ("inspection_id",), (), lambda df: F.col("chi_inspection_date").try_cast("timestamp"), "inspection_date",
        renames={"inspection_date": "chi_inspection_date", "results": "chi_results", "violations": "chi_violations", "dba_name": "chi_dba_name"}, late=("chi_results", "chi_violations"),
    )
    panel = natural.panel(df, source)
    assert values(panel, "chi_inspection_id") == [1, 2, 3] and [r.y for r in panel.rows.orderBy("pos").collect()] == [1, 0, 0]
    assert late(panel) == {"chi_chi_results", "chi_chi_violations"} and values(panel, "chi_risk") == [2, -1, 1]


def test_flights_from_an_archive_by_allow_list(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "flights.csv.zip", "w") as z:
        z.writestr("b.csv", "FlightDate,ArrDel15\n1,1\n")
        z.writestr("a.csv", "FlightDate,ArrDel15,Cancelled,Diverted,DepDelay\n2023-03-01,0,0,0,1\n2023-01-01,1,0,0,2\n2023-02-01,0,0,,3\n")
    source = natural.Source("flights", "bts_", natural.flags("ArrDel15", "Cancelled", "Diverted"), tuple(natural.SOURCE), (), lambda df: F.col("FlightDate").try_cast("timestamp"), "FlightDate", known=("FlightDate",), first=2)
    schema = "FlightDate string, ArrDel15 double, Cancelled double, Diverted double, DepDelay double"
    panel, _ = natural.from_files(spark, str(tmp_path), schema, source, {"suffixes": [".csv.zip"]}, archive=True)
    assert values(panel, "bts_FlightDate") == [0, 1] and values(panel, "bts_DepDelay") == [2, 1] and [r.y for r in panel.rows.orderBy("pos").collect()] == [1, 0]
    assert late(panel) == {"bts_ArrDel15", "bts_Cancelled", "bts_Diverted", "bts_DepDelay"}


def test_codes_by_train_rows_count_unseen_values(spark):
    rows = [(1, "x", 1), (2, "z", 0), (3, "x", 1), (4, "y", 0), (5, "z", 1), (6, None, 0), (7, "q", 1)]
    df = spark.createDataFrame(rows, "id int, kind string, y int")
    source = natural.Source("codes", "", lambda d: F.col("y"), ("id",), ("y",), cuts=(0.43, 0.72), codes="train")
    panel = natural.panel(df, source)
    assert values(panel, "kind") == [0, 1, 0, -2, 1, -1, -2]
    assert {(r.split, r.n_unseen) for r in natural.unseen(panel).collect()} == {("train", 0), ("validation", 1), ("test", 1)}
    same, other = natural.panel(df.repartition(3), source), natural.panel(df.where("id <> 2"), source)
    digest = lambda p: natural.mapping_digest(p).first().digest
    assert digest(panel) == digest(same) != digest(other)


def test_ranks_and_quantiles_are_exact(spark):
    from pyspark.sql import Window

    from fieldaudit.operators import order

    df = spark.range(3000).selectExpr("id % 4 AS g", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 5.0 ELSE pmod(hash(id), 1007) / 7.0 END AS v", "id")
    at = [0.1, 0.25, 0.5, 0.75, 0.9]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert {r.g: r.q for r in order.quantiles(df, ["g"], "v", at).collect()} == want
    assert order.quantiles(df, [], "v", at).first().q == df.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]
    assert order.quantiles(df.where("v IS NULL"), ["g"], "v", at).count() == 0
    ranked = order.ranked(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")])
    checked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "id")))
    assert checked.where("n <> pos").count() == 0 and checked.count() == 3000
