import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clean as C

from .builders import daily, day

BY = ["profile_id"]


def cleaned(df):
    return C.clean_daily(df, BY, ["ingest_seq"]).orderBy("date").collect()


@pytest.mark.parametrize(
    "column, kept, nulled",
    [
        ("avg_stress", [35, 0], [-1, -2]),
        ("max_stress", [55], [-1]),
        ("resting_hr", [25, 28, 60, 200], [20, 24, 201, 250]),
        ("sleep_seconds", [28800, 57600], [0, 57601, 72000]),
        ("total_calories", [2000, 500, 10000], [100, 50000]),
        ("active_calories", [500, 0], [-50, 15000]),
        ("steps", [8000, 0], [-100, 500000]),
    ],
)
def test_range_rules(spark, column, kept, nulled):
    rows = cleaned(daily(spark, *[{column: v} for v in kept + nulled]))
    assert [r[column] for r in rows] == kept + [None] * len(nulled)


def test_battery_endpoints_are_nulled_together(spark):
    pairs = [(80, 20), (-1, 50), (80, 150), (None, 150), (None, 50)]
    rows = cleaned(daily(spark, *[{"body_battery_start": a, "body_battery_end": b} for a, b in pairs]))
    assert [(r.body_battery_start, r.body_battery_end) for r in rows] == [(80, 20), (None, None), (None, None), (None, None), (None, 50)]


def test_no_wear_days_are_dropped(spark):
    off = {"resting_hr": None, "sleep_seconds": None}
    rows = cleaned(daily(spark, {**off, "steps": 5000}, {**off, "steps": 0}, {**off, "steps": None}, {**off, "steps": 0, "resting_hr": 60}))
    assert [r.date.day for r in rows] == [1, 4]


def test_last_write_of_a_day_wins(spark):
    d = {"date": day("2024-01-05")}
    rows = cleaned(daily(spark, {**d, "resting_hr": 60}, {**d, "resting_hr": 65, "steps": 7000}))
    assert [(r.resting_hr, r.steps) for r in rows] == [(65, 7000)]


def test_empty_last_write_lets_the_earlier_one_survive(spark):
    d = {"date": day("2024-01-05")}
    rows = cleaned(daily(spark, {**d, "resting_hr": 61}, {**d, "resting_hr": 10, "sleep_seconds": 0, "steps": 0}))
    assert [r.resting_hr for r in rows] == [61]


def test_rules_for_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, day("2024-01-01"), 250)], "profile_id INT, date DATE, resting_hr INT")
    rows = C.clean_daily(df, BY, ["date"]).collect()
    assert len(rows) == 1 and rows[0].resting_hr is None


def test_prune_sparse_is_strict_and_counts_missing_columns(spark):
    df = spark.range(10).select(
        F.when(F.col("id") >= 3, F.col("id")).alias("at_limit"), F.when(F.col("id") >= 4, F.col("id")).alias("beyond"), "id"
    )
    assert C.prune_sparse(df, ["at_limit", "beyond", "id", "absent"]) == ["at_limit", "id"]
    assert C.prune_sparse(df.limit(0), ["at_limit", "absent"]) == ["at_limit", "absent"]


def test_quality_gate_and_its_error(spark):
    df = daily(spark, *[{"steps": None if i < 4 else 1} for i in range(10)])
    checks = {r.check: r.ok for r in C.quality_gate(df, BY, min_rows=10).collect()}
    assert checks == {"rows": True, "null_rate:resting_hr": True, "null_rate:sleep_seconds": True, "null_rate:steps": False}
    with pytest.raises(C.QualityError):
        C.require_quality(df, BY, min_rows=10)


def test_ingest_range_counts(spark):
    rows = [(1, day("2024-01-01")), (1, day("2024-02-01")), (1, None), (1, day("2023-12-31"))]
    df = spark.createDataFrame(rows, "profile_id INT, date DATE")
    kept, counts = C.ingest_range(df, "date", "2024-01-01", "2024-01-31", BY)
    assert [(r.date, r.iso_week) for r in kept.collect()] == [(dt.date(2024, 1, 1), "2024-W01")]
    assert counts.first().asDict() == {"profile_id": 1, "considered": 4, "unparseable": 1, "out_of_range": 2}


def test_prefer_rows_falls_back_per_key(spark):
    df = spark.createDataFrame([(1, "INTERVAL"), (1, "REST"), (2, "REST"), (2, None)], "a INT, t STRING")
    rows = sorted((r.a, r.t or "") for r in C.prefer_rows(df, ["a"], F.col("t") == "INTERVAL").collect())
    assert rows == [(1, "INTERVAL"), (2, ""), (2, "REST")]


def test_class_contribution_keeps_unknown_distances(spark):
    df = spark.createDataFrame([("running", 2.0), ("running", None), ("yoga", 5.0)], "activity_type STRING, km DOUBLE")
    assert [r[0] for r in df.select(C.class_contribution(F.col("km"), ["running"])).collect()] == [2.0, None, 0.0]
