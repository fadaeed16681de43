import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import trees
from pulsegrid.sources import entities as E
from pulsegrid.sources import payloads as P
from pulsegrid.sources import pointer
from pulsegrid.sources import sinks as K
from pulsegrid.sources.schemas import ENTITY_DDL, ENTITY_KEYS, entity_schema
from pulsegrid.streaming import upsert as U

from .builders import day


# ----------------------------------------------------------- schema evolution
def write(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))


def test_old_file_without_a_column(spark, tmp_path):
    write(spark, tmp_path / "daily_health", [("2024-01-01", 1), ("2024-01-02", 2)], "date STRING, steps INT")
    write(spark, tmp_path / "daily_health", [("2024-01-03", 3, 900)], "date STRING, steps INT, consumed_calories INT")
    rows = E.scan_entity(spark, str(tmp_path), "daily_health").collect()
    assert len(rows) == 3 and sum(r.consumed_calories is None for r in rows) == 2


def test_uniform_files(spark, tmp_path):
    write(spark, tmp_path / "x", [(1, 1), (2, 2)], "id INT, val INT")
    write(spark, tmp_path / "x", [(3, 3)], "id INT, val INT")
    assert E.scan_entity(spark, str(tmp_path), "x").count() == 3


def test_missing_dataset(spark, tmp_path):
    assert not E.dataset_exists(spark, str(tmp_path / "none"))
    assert E.load_optional(spark, str(tmp_path), "none") is None
    with pytest.raises(E.MissingDataset):
        E.scan_entity(spark, str(tmp_path), "none")
    with pytest.raises(E.MissingDataset, match="decompose"):
        E.load_decomposed(spark, str(tmp_path), required=True)
    assert E.load_decomposed(spark, str(tmp_path)) is None


def test_union_of_overlapping_columns(spark, tmp_path):
    write(spark, tmp_path / "x", [(1, 2)], "x INT, y INT")
    write(spark, tmp_path / "x", [(3, 4)], "y INT, z BIGINT")
    got = {f.name: f.dataType for f in E.union_schema(spark, str(tmp_path / "x")).fields}
    assert got == {"x": T.IntegerType(), "y": T.IntegerType(), "z": T.LongType()}


@pytest.mark.parametrize("a, b, wide", [("INT", "BIGINT", T.LongType()), ("BIGINT", "DOUBLE", T.DoubleType()), ("INT", "FLOAT", T.DoubleType())])
def test_promotion_is_scanned_with_values(spark, tmp_path, a, b, wide):
    write(spark, tmp_path / "x", [(1,)], f"val {a}") if a != "FLOAT" else None
    big = 2.5 if b in ("DOUBLE", "FLOAT") else 2**40
    write(spark, tmp_path / "x", [(big,)], f"val {b}")
    assert E.union_schema(spark, str(tmp_path / "x"))["val"].dataType == wide
    df = E.scan_entity(spark, str(tmp_path), "x")
    assert df.schema["val"].dataType == wide and sorted(r.val for r in df.collect()) == [1, big]


def test_conflicting_types_are_an_error(spark, tmp_path):
    write(spark, tmp_path / "x", [(1,)], "val INT")
    write(spark, tmp_path / "x", [("a",)], "val STRING")
    with pytest.raises(E.SchemaConflict):
        E.scan_entity(spark, str(tmp_path), "x")


def test_numeric_supertype_table():
    i8, i16, i32, i64, f32, f64 = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
    assert E.numeric_supertype(i8, i64) == i64 and E.numeric_supertype(i16, i8) == i16
    assert E.numeric_supertype(i32, f32) == f64 and E.numeric_supertype(f32, f64) == f64
    assert E.numeric_supertype(f32, f32) == f32 and E.numeric_supertype(i32, T.StringType()) is None


def test_entity_catalogue():
    assert len(entity_schema("daily_health")) == 27 and len(entity_schema("activities")) == 29
    for name, keys in ENTITY_KEYS.items():
        assert set(keys) <= set(entity_schema(name).names)
    assert "raw_payloads" in ENTITY_DDL


# --------------------------------------------------------------------- upsert
DAILY = "profile_id INT, date DATE, steps INT, resting_hr INT"


def test_upsert_fresh_overlap_and_untouched_partitions(spark, tmp_path):
    def put(*rows):
        df = spark.createDataFrame([(1, day(d), s, None) for d, s in rows], DAILY)
        K.upsert_entity(spark, str(tmp_path), "daily_health", df)

    put(("2024-01-01", 5000), ("2024-01-02", 6000), ("2024-02-01", 1))
    assert spark.read.parquet(str(tmp_path / "daily_health")).count() == 3
    feb = sorted(p.name for p in (tmp_path / "daily_health" / "ym=2024-02").glob("*.parquet"))
    put(("2024-01-02", 7000), ("2024-01-03", 8000))
    rows = {r.date.isoformat(): r.steps for r in E.load(spark, str(tmp_path), "daily_health").collect()}
    assert rows == {"2024-01-01": 5000, "2024-01-02": 7000, "2024-01-03": 8000, "2024-02-01": 1}
    assert sorted(p.name for p in (tmp_path / "daily_health" / "ym=2024-02").glob("*.parquet")) == feb
    known = E.load(spark, str(tmp_path), "daily_health", schema=entity_schema("daily_health"))
    assert known.columns[:27] == entity_schema("daily_health").names and known.where("sleep_score IS NULL").count() == 4
    ranged = E.load(spark, str(tmp_path), "daily_health", frm="2024-01-02", to="2024-01-31")
    assert ranged.count() == 2
    months = {r.month for r in E.landed_partitions(spark, str(tmp_path / "daily_health")).collect()}
    assert months == {day("2024-01-01"), day("2024-02-01")}


def test_upsert_keeps_rows_without_a_partition_value(spark, tmp_path):
    ddl, path = "k INT, ym STRING, v INT", str(tmp_path / "t")
    K.upsert(spark, path, spark.createDataFrame([(10, None, 1), (11, "2024-01", 1)], ddl), ["k"], ["ym"])
    K.upsert(spark, path, spark.createDataFrame([(12, None, 2), (10, None, 3)], ddl), ["k"], ["ym"])
    rows = {(r.k, r.ym, r.v) for r in spark.read.parquet(path).collect()}
    assert rows == {(10, None, 3), (11, "2024-01", 1), (12, None, 2)}


def test_upsert_reads_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([(i, f"2024-{1 + i % 9:02d}", i) for i in range(90)], "k INT, ym STRING, v INT")
    K.upsert(spark, path, table, ["k"], ["ym"])
    batch = spark.createDataFrame([(3, "2024-04", 0), (500, "2025-01", 0), (501, None, 0)], "k INT, ym STRING, v INT")
    assert [f.rsplit("/", 1)[1] for f in K.touched_folders(spark, path, batch, ["ym"])] == ["ym=2024-04"]


@pytest.mark.parametrize("entity,ddl,keys", [("activity_details", "activity_id BIGINT, row_pos BIGINT, speed DOUBLE", 2), ("activity_splits", "activity_id BIGINT, split_number INT, distance_m DOUBLE", 2)])
def test_per_activity_tables_have_folders(spark, tmp_path, entity, ddl, keys):
    put = lambda *rows: K.upsert_entity(spark, str(tmp_path), entity, spark.createDataFrame(list(rows), ddl))
    put((1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0))
    put((1, 1, 9.0), (3, 0, 1.0))
    rows = {tuple(r) for r in E.scan_entity(spark, str(tmp_path), entity).drop("activity_slot").collect()}
    assert rows == {(1, 0, 1.0), (1, 1, 9.0), (2, 0, 1.0), (3, 0, 1.0)}
    assert all(p.name.startswith("activity_slot=") for p in (tmp_path / entity).iterdir() if p.is_dir() and p.name != pointer.FOLDER)


def test_files_at_any_depth_are_read(spark, tmp_path):
    write(spark, tmp_path / "x" / "a=1" / "b=2" / "c=3" / "d=4" / "e=5", [(1,)], "val INT")
    write(spark, tmp_path / "x" / "a=1" / "b=2" / "c=3" / "d=4" / "e=6", [(2.0,)], "val DOUBLE")
    assert E.dataset_exists(spark, str(tmp_path / "x")) and not E.dataset_exists(spark, str(tmp_path / "absent"))
    assert len(E.parquet_files(spark, str(tmp_path / "x"))) == 2
    assert sorted(r.val for r in E.scan_entity(spark, str(tmp_path), "x").collect()) == [1.0, 2.0]


def test_footer_jobs_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("cast(id as int) AS val").repartition(60).write.parquet(str(tmp_path / "x" / "gen=1"))
    spark.range(400).selectExpr("id + 0.5e0 AS val", "id AS more").repartition(60).write.parquet(str(tmp_path / "x" / "gen=2"))
    asked, merged = [], E._merged_schema
    monkeypatch.setattr(E, "_merged_schema", lambda s, files: asked.append(len(files)) or merged(s, files))
    df = E.scan_entity(spark, str(tmp_path), "x")
    assert df.count() == 800 and df.agg(F.sum("val")).first()[0] == 2 * sum(range(400)) + 200 and df.where("more IS NULL").count() == 400
    assert len(E.parquet_files(spark, str(tmp_path / "x"))) == 120 and len(asked) <= 16


def alternating(folder, n):
    """Files whose ``val`` is an integer and a floating-point number in turn, every tenth with one more column."""
    folder.mkdir()
    for i in range(n):
        columns = {"val": pa.array([i], pa.int32() if i % 2 else pa.float64())} | ({"more": pa.array([i], pa.int64())} if i % 10 == 3 else {})
        pq.write_table(pa.table(columns), folder / f"part-{i:05d}.parquet")


def test_jobs_do_not_grow_with_files_of_alternating_schemas(spark, tmp_path):
    jobs = {}
    for n in (20, 2000):
        alternating(tmp_path / f"x{n}", n)
        spark.sparkContext.setJobGroup(f"footers{n}", "")
        groups = E._schema_groups(spark, str(tmp_path / f"x{n}"))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"footers{n}"))
        assert len(groups) == 2 and sum(len(files) for _, files in groups) == n
    spark.sparkContext.setJobGroup("", "")
    assert jobs[20] == jobs[2000] <= 4
    df = E.scan_entity(spark, str(tmp_path), "x2000")
    assert df.dtypes == [("val", "double"), ("more", "bigint")] == [(f.name, f.dataType.simpleString()) for f in E.union_schema(spark, str(tmp_path / "x2000")).fields]
    assert df.agg(F.count("val"), F.sum("val"), F.count("more")).first() == (2000, sum(range(2000)), 200)


def test_footers_that_tasks_cannot_open_are_merged_by_spark(spark, tmp_path, monkeypatch):
    alternating(tmp_path / "x", 12)
    want = [(schema.simpleString(), len(files)) for schema, files in E._schema_groups(spark, str(tmp_path / "x"))]
    footers = E._footers
    monkeypatch.setattr(E, "_footers", lambda s, path: footers(s, path).withColumn("kind", F.lit(None).cast("string")))
    df = E.scan_entity(spark, str(tmp_path), "x")
    assert df.dtypes == [("val", "double"), ("more", "bigint")] and df.agg(F.sum("val")).first()[0] == sum(range(12))
    assert [n for _, n in want] == [6, 6]


def test_only_an_absent_table_is_optional(spark, tmp_path):
    write(spark, tmp_path / "x", [(1,)], "val INT")
    write(spark, tmp_path / "x", [("a",)], "val STRING")
    assert E.load_optional(spark, str(tmp_path), "absent") is None
    with pytest.raises(E.SchemaConflict):
        E.load_optional(spark, str(tmp_path), "x")


def test_wider_old_rows_are_narrowed_unless_kept(spark):
    old = spark.createDataFrame([(9, 1, day("2024-01-01"), 5, "{}")], "id BIGINT, profile_id INT, date DATE, steps INT, raw_json STRING")
    new = spark.createDataFrame([(1, day("2024-01-02"), 6, 50)], DAILY)
    merged = K.merge_rows(old, new, ["profile_id", "date"])
    assert merged.columns == ["profile_id", "date", "steps", "resting_hr"] and merged.count() == 2
    kept = K.merge_rows(old, new, ["profile_id", "date"], keep_old_columns=True)
    assert {"id", "raw_json"} <= set(kept.columns)


def test_null_keys_compare_equal(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 2)], "k INT, t STRING, seq INT")
    assert [r.seq for r in K.merge_rows(None, df, ["k", "t"], ["seq"]).collect()] == [2]


def test_pending_keys(spark):
    def frame(*days):
        return spark.createDataFrame([(day(d),) for d in days], "date DATE")

    wanted = frame("2024-01-30", "2024-02-01", "2024-02-02", "2024-02-03")
    have = frame("2024-01-30", "2024-02-02", "2024-02-03")

    def pending(entity, **kw):
        out = K.pending_keys(wanted, have, ["date"], K.refresh_recent(entity, "date", "2024-02-03"), **kw)
        return sorted(r.date.isoformat() for r in out.collect())

    assert pending("daily_health") == ["2024-02-01", "2024-02-02", "2024-02-03"]
    assert pending("nutrition") == ["2024-02-01", "2024-02-02", "2024-02-03"]
    assert pending("activities") == ["2024-01-30", "2024-02-01", "2024-02-02", "2024-02-03"]
    assert len(pending("nutrition", force=True)) == 4
    assert K.enabled(None, "daily") and K.enabled("daily", "daily", "all") and not K.enabled("weight", "daily")


def test_stream_upsert_is_idempotent_and_incremental(spark, tmp_path):
    schema = T._parse_datatype_string("profile_id INT, date DATE, ym STRING, steps INT")

    def land(name, *rows):
        spark.createDataFrame([(1, day(d), d[:7], s) for d, s in rows], schema).coalesce(1).write.parquet(str(tmp_path / "land" / name))

    def run():
        stream = U.landing_stream(spark, str(tmp_path / "land" / "*"), schema)
        U.stream_upsert(stream, str(tmp_path / "t"), ["profile_id", "date"], ["ym"], str(tmp_path / "cp")).awaitTermination()
        return {r.date.isoformat(): r.steps for r in spark.read.parquet(str(tmp_path / "t")).collect()}

    land("a", ("2024-01-01", 1), ("2024-01-02", 2))
    assert run() == {"2024-01-01": 1, "2024-01-02": 2}
    land("b", ("2024-01-02", 20), ("2024-02-01", 3))
    assert run() == {"2024-01-01": 1, "2024-01-02": 20, "2024-02-01": 3}
    assert run() == {"2024-01-01": 1, "2024-01-02": 20, "2024-02-01": 3}


# -------------------------------------------------------------------- payloads
RAW = "profile_id INT, endpoint STRING, key_date DATE, activity_id BIGINT, payload STRING, ingest_seq BIGINT"


def raw(spark, *rows):
    """(endpoint, payload) pairs of one day and activity, landed in order."""
    return spark.createDataFrame(
        [(1, e, day("2026-04-05"), 7, p if isinstance(p, str) else json.dumps(p), i) for i, (e, p) in enumerate(rows)], RAW
    )


def test_daily_health_payloads(spark):
    df = raw(
        spark,
        (P.SUMMARY, {"totalSteps": 1}),
        (P.SUMMARY, {"totalSteps": 8000.9, "averageStressLevel": -1, "maxStressLevel": 0, "sleepingSeconds": 100, "restingHeartRate": "51"}),
        (P.SLEEP, {"dailySleepDTO": {"deepSleepSeconds": 1, "lightSleepSeconds": 2, "remSleepSeconds": 3, "sleepScores": {"overall": {"value": 81}}}}),
        (P.HRV, {"hrvSummary": {"lastNightAvg": 44, "status": "LOW"}}),
    )
    r = P.flatten_daily_health(df).first()
    assert (r.steps, r.avg_stress, r.max_stress, r.sleep_seconds, r.sleep_score) == (8000, None, 0, 6, 81)
    assert (r.hrv_last_night, r.hrv_status, r.resting_hr, r.hydration_ml) == (44, "LOW", None, None)
    assert set(P.flatten_daily_health(df).columns) == set(entity_schema("daily_health").names)
    partial = P.flatten_daily_health(raw(spark, (P.SUMMARY, {"sleepingSeconds": 100}), (P.SLEEP, {"deepSleepSeconds": 1, "lightSleepSeconds": 2}))).first()
    assert (partial.sleep_seconds, partial.deep_sleep_seconds) == (100, 1)


def status_doc(when):
    return {"mostRecentTrainingStatus": {"latestTrainingStatusData": {"3497": {"calendarDate": when, "trainingStatusFeedbackPhrase": "RECOVERY_2"}}}}


def test_training_status_never_uses_another_day(spark):
    same = P.flatten_performance(raw(spark, (P.STATUS, status_doc("2026-04-05")))).first()
    other = P.flatten_performance(raw(spark, (P.STATUS, status_doc("2026-04-04")))).first()
    assert (same.training_status, other.training_status) == ("RECOVERY_2", None)
    history = {"trainingStatusHistory": [{"calendarDate": "2026-04-04", "trainingStatusFeedbackPhrase": "A"}, {"calendarDate": "2026-04-05", "trainingStatusFeedbackPhrase": "MAINTAINING_1"}]}
    assert P.flatten_performance(raw(spark, (P.STATUS, history))).first().training_status == "MAINTAINING_1"


def test_performance_payloads_as_object_or_array(spark):
    df = raw(
        spark,
        (P.VO2, [{"generic": {"vo2MaxValue": 51.5, "fitnessAge": 30}}]),
        (P.RACE, {"time5K": 1200, "time10K": 2500}),
        (P.READINESS, [{"score": 70}, {"score": 1}]),
        (P.ENDURANCE, {"overallScore": 6000}),
    )
    r = P.flatten_performance(df).first()
    assert (r.vo2max, r.fitness_age, r.race_5k_sec, r.race_half_sec, r.training_readiness, r.endurance_score, r.hill_score) == (51.5, 30, 1200, None, 70, 6000, None)
    aged = P.flatten_performance(raw(spark, (P.FITNESS_AGE, {"fitnessAge": 39.5}), (P.VO2, {"generic": {"fitnessAge": 20}}))).first()
    assert aged.fitness_age == 40
    assert set(P.flatten_performance(df).columns) == set(entity_schema("performance_metrics").names)


def test_weight_list_empty_list_and_latest_only(spark):
    m = {"samplePk": 5, "weight": 70500.0, "date": 1_700_000_000_000}
    listed = {"dailyWeightSummaries": [{"summaryDate": "2026-04-05", "allWeightMetrics": [m, {**m, "samplePk": 6, "calendarDate": "2026-04-06"}], "latestWeight": m}]}
    rows = P.flatten_weight(raw(spark, (P.WEIGHT, listed))).orderBy("sample_pk").collect()
    assert [(r.date, r.weight_kg, r.timestamp_gmt) for r in rows] == [
        (day("2026-04-05"), 70.5, "2023-11-14T22:13:20"),
        (day("2026-04-06"), 70.5, "2023-11-14T22:13:20"),
    ]
    empty = {"dailyWeightSummaries": [{"summaryDate": "2026-04-05", "allWeightMetrics": [], "latestWeight": m}]}
    latest = {"dailyWeightSummaries": [{"summaryDate": "2026-04-05", "latestWeight": m}]}
    assert P.flatten_weight(raw(spark, (P.WEIGHT, empty))).count() == 0
    assert P.flatten_weight(raw(spark, (P.WEIGHT, latest))).count() == 1
    assert P.flatten_weight(raw(spark, (P.WEIGHT, {}))).count() == 0


def test_blood_pressure_both_shapes(spark):
    m = {"measurementTimestampLocal": "2026-04-05T07:00:00", "systolic": 120, "pulse": 55.5}
    nested = P.flatten_bp(raw(spark, (P.PRESSURE, {"measurementSummaries": [{"measurements": [m, m]}, {}]}))).collect()
    flat = P.flatten_bp(raw(spark, (P.PRESSURE, [m]))).collect()
    assert len(nested) == 2 and len(flat) == 1
    assert (flat[0].date, flat[0].timestamp_gmt, flat[0].systolic, flat[0].pulse) == (day("2026-04-05"), "2026-04-05T07:00:00", 120, None)


def test_nutrition_without_calories_is_dropped(spark):
    for doc, n in [({"dailyNutritionContent": {"calories": 1900, "fat": 1}}, 1), ({"dailyNutritionContent": {"calories": 0}}, 0), ({"dailyNutritionContent": {}}, 0), ({"dailyNutritionContent": []}, 0), ({}, 0)]:
        assert P.flatten_nutrition(raw(spark, (P.NUTRITION, doc))).count() == n


def test_activity_payload(spark):
    doc = {"activityId": 7, "startTimeLocal": "2026-04-05 06:30:00", "startTimeGMT": "yesterday", "averageHR": 140.5, "averageBikingCadenceInRevsPerMinute": 80, "eventType": {"typeKey": "race"}}
    r = P.flatten_activities(raw(spark, (P.ACTIVITY, doc))).first()
    assert (r.avg_hr, r.avg_cadence, r.start_time_gmt, r.start_time_local) == (141, 80.0, None, dt.datetime(2026, 4, 5, 6, 30))
    assert json.loads(r.raw_json)["eventType"]["typeKey"] == "race"
    assert set(P.flatten_activities(raw(spark, (P.ACTIVITY, doc))).columns) == set(entity_schema("activities").names)


def test_details_pivot(spark):
    doc = {
        "metricDescriptors": [{"key": "directHeartRate", "metricsIndex": 0}, {"key": "directHeartRate", "metricsIndex": 1}, {"key": "bikeCadence", "metricsIndex": 2}, {"metricsIndex": 3}, {"key": "directSpeed"}],
        "activityDetailMetrics": [{"metrics": [1.0, 140.5, 80.0]}, {"metrics": [1.0]}, {"metrics": [1.0, None, 81.4]}],
    }
    rows = P.flatten_details(raw(spark, (P.DETAILS, doc))).orderBy("row_pos").collect()
    assert [(r.row_pos, r.heart_rate, r.cadence, r.speed) for r in rows] == [(0, 141, 80, None), (1, None, None, None), (2, None, 81, None)]
    assert P.flatten_details(raw(spark, (P.DETAILS, {"activityDetailMetrics": []}))).count() == 0
    assert set(P.flatten_details(raw(spark, (P.DETAILS, doc))).columns) == set(entity_schema("activity_details").names)


def test_splits_shapes(spark):
    lap = {"distance": 1000.0, "intensityType": "INTERVAL"}
    laps = P.flatten_splits(raw(spark, (P.SPLITS, {"lapDTOs": [lap, {**lap, "lapIndex": 9}], "splitDTOs": [lap]}))).orderBy("split_number").collect()
    assert [(r.split_number, r.split_type) for r in laps] == [(1, "INTERVAL"), (9, "INTERVAL")]
    only = P.flatten_splits(raw(spark, (P.SPLITS, {"splitDTOs": [{"splitType": "REST"}]}))).collect()
    assert [(r.split_number, r.split_type) for r in only] == [(1, "REST")]


def test_payload_shape_handles_multibyte_text(spark):
    df = raw(spark, ("x", {"a": "🐎" * 100, "b": [1]}), ("x", {"a": None}), ("x", "{broken"), ("x", [{"c": {}}]))
    shape = P.payload_shape(df).collect()
    assert {(r.path, r.kind): r.n for r in shape} == {("a", "str"): 1, ("a", "null"): 1, ("b", "array"): 1, ("[0].c", "object"): 1}
    assert {r.path: (r.least_size, r.most_size) for r in shape if r.kind in ("array", "object")} == {"b": (1, 1), "[0].c": (0, 0)}


def test_tolerant_parsers(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("2024-13-05 10:00:00",), ("2024-01-05",), (None,)], "s STRING")
    rows = df.select(P.parse_ts(F.col("s")).alias("t"), P.parse_date(F.col("s")).alias("d")).collect()
    assert [r.t is None for r in rows] == [False, True, True, True]
    assert [r.d for r in rows] == [None, None, day("2024-01-05"), None]


# ------------------------------------------------------------ pointer, versions
TABLE = "k INT, ym STRING, v INT"


def rows_of(df):
    return {(r.k, r.ym, r.v) for r in df.collect()}


def test_pointer_is_compare_and_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    assert pointer.read(spark, path) == (0, None)
    assert pointer.swap(spark, path, 0, {"a": 1}) and not pointer.swap(spark, path, 0, {"a": 2})
    assert pointer.read(spark, path) == (1, {"a": 1})
    assert pointer.swap(spark, path, 1, {"a": 3}) and pointer.read(spark, path) == (2, {"a": 3})
    assert not [p for p in (tmp_path / "t" / "_pointer").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


@pytest.mark.parametrize("partition_by", [["ym"], []])
def test_a_writer_lost_at_any_moment_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, partition_by):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "2024-01", 1), (2, "2024-02", 1), (3, "2024-03", 1)], TABLE)
    batch = spark.createDataFrame([(1, "2024-01", 2), (4, "2024-02", 2), (5, "2024-04", 2)], TABLE)
    before = {(1, "2024-01", 1), (2, "2024-02", 1), (3, "2024-03", 1)}
    after = {(1, "2024-01", 2), (2, "2024-02", 1), (3, "2024-03", 1), (4, "2024-02", 2), (5, "2024-04", 2)}
    K.upsert(spark, path, first, ["k"], partition_by)

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:  # all new files are written, nothing points to them
        m.setattr(K, "_point_to", lost)
        with pytest.raises(Lost):
            K.upsert(spark, path, batch, ["k"], partition_by)
    assert rows_of(E.read_table(spark, path)) == before
    with monkeypatch.context() as m:  # committed, but old folders are only partly removed
        real = pointer.remove
        m.setattr(K.pointer, "remove", lambda s, f: lost() if "2024-02" in f or not partition_by else real(s, f))
        with pytest.raises(Lost):
            K.upsert(spark, path, batch, ["k"], partition_by)
    assert rows_of(E.read_table(spark, path)) == after
    K.upsert(spark, path, batch, ["k"], partition_by)
    assert rows_of(E.read_table(spark, path)) == after
    K.vacuum(spark, path)
    assert rows_of(E.read_table(spark, path)) == after == rows_of(spark.read.parquet(path))


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    K.upsert(spark, path, spark.createDataFrame([(1, "2024-01", 1), (2, "2024-02", 1)], TABLE), ["k"], ["ym"])
    real, others = K._point_to, [[(3, "2024-01", 9)], [(4, "2024-02", 9)]]

    def slow(*args):
        if others:
            rows = others.pop()
            with monkeypatch.context() as m:
                m.setattr(K, "_point_to", real)
                K.upsert(spark, path, spark.createDataFrame(rows, TABLE), ["k"], ["ym"])
        return real(*args)

    monkeypatch.setattr(K, "_point_to", slow)
    K.upsert(spark, path, spark.createDataFrame([(1, "2024-01", 5)], TABLE), ["k"], ["ym"])
    assert others == [[(3, "2024-01", 9)]]  # another folder: one attempt
    K.upsert(spark, path, spark.createDataFrame([(1, "2024-01", 6)], TABLE), ["k"], ["ym"])
    assert rows_of(E.read_table(spark, path)) == {(1, "2024-01", 6), (2, "2024-02", 1), (3, "2024-01", 9), (4, "2024-02", 9)}


def test_a_table_without_versions_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "2024-01", 1), (2, "2024-02", 1), (3, None, 1)], TABLE).write.partitionBy("ym").parquet(path)
    K.upsert(spark, path, spark.createDataFrame([(1, "2024-01", 2), (4, None, 2)], TABLE), ["k"], ["ym"])
    want = {(1, "2024-01", 2), (2, "2024-02", 1), (3, None, 1), (4, None, 2)}
    assert rows_of(E.read_table(spark, path)) == want
    assert rows_of(E.scan_entity(spark, str(tmp_path), "t")) == want and E.dataset_exists(spark, path)
    K.upsert(spark, path, spark.createDataFrame([(2, "2024-02", 3)], TABLE), ["k"], ["ym"], keep_superseded=True)
    assert rows_of(E.read_table(spark, path)) == want - {(2, "2024-02", 1)} | {(2, "2024-02", 3)}


def test_model_versions(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3), float(i % 5) * 2) for i in range(60)], "k INT, a DOUBLE, b DOUBLE, y DOUBLE")
    fitted = lambda seed: trees.fit(rows, ["a", "b"], "y", ["k"], trees.Settings(3, 3, 2, seed))
    path = str(tmp_path / "m")
    with pytest.raises(E.MissingDataset):
        K.load_model(spark, path)
    one = K.save_model(fitted(1), {"mae": 1.0}, path)
    assert K.save_model(fitted(1), {"mae": 1.0}, path) == one and pointer.read(spark, path)[0] == 1
    two = K.save_model(fitted(2), {"mae": 2.0}, path)
    assert two != one and K.save_model(fitted(2), {"mae": 3.0}, path) not in (one, two)
    model, meta = K.load_model(spark, path)
    assert meta == {"mae": 3.0} and model.features == ["a", "b"] and model.settings.seed == 2
    old, meta = K.load_model(spark, path, one)
    assert meta == {"mae": 1.0}
    key = lambda m: sorted((r.k, r.prediction) for r in m.predict(rows).collect())
    assert key(old) == key(fitted(1))


def test_a_model_half_written_is_not_the_latest(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 5), float(i)) for i in range(30)], "k INT, a DOUBLE, y DOUBLE")
    model, path = trees.fit(rows, ["a"], "y", ["k"], trees.Settings(2, 2)), str(tmp_path / "m")
    K.save_model(model, {"n": 1}, path)
    monkeypatch.setattr(K.pointer, "swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        K.save_model(model, {"n": 2}, path)
    assert K.load_model(spark, path)[1] == {"n": 1}


def test_details_are_read_from_the_wanted_folders_only(spark, tmp_path, capsys):
    rows = [(a, i, float(i)) for a in range(200) for i in range(3)]
    K.upsert_entity(spark, str(tmp_path), "activity_details", spark.createDataFrame(rows, "activity_id BIGINT, row_pos BIGINT, speed DOUBLE"))
    details = E.load_activity_details(spark, str(tmp_path))
    wanted = spark.createDataFrame([(7,), (8,), (7,), (999,)], "activity_id BIGINT")
    found = E.details_for(details, wanted)
    assert {(r.activity_id, r.row_pos) for r in found.collect()} == {(a, i) for a in (7, 8) for i in range(3)}
    found.explain()
    text = capsys.readouterr().out
    assert "PartitionFilters: [" in text and "activity_slot" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(activity_id,7)" in text
    assert len({f for f in found.inputFiles()}) >= 1 and E.details_for(details, wanted.limit(0)).count() == 0
    plain = details.drop("activity_slot")
    assert E.details_for(plain, wanted).count() == 6
