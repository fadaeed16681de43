import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import forest as M
from pulsegrid.operators.trees import Settings
from pulsegrid.operators import linear as L
from pulsegrid.operators.clean import QualityError
from pulsegrid.plans import decompose, features, fitness, injury, races, readiness, recap, routes, status, training
from pulsegrid.sources.sinks import load_model

from .builders import day
from .test_steady import DDL as DETAIL_DDL
from .test_steady import series

BY = ["profile_id"]
HEALTH = (
    "profile_id INT, date DATE, ingest_seq BIGINT, resting_hr INT, sleep_seconds INT, sleep_score INT, steps INT, total_calories INT, active_calories INT, "
    "avg_stress INT, max_stress INT, body_battery_start INT, body_battery_end INT, hrv_last_night INT, hrv_status STRING, avg_spo2 INT"
)
ACTS = (
    "profile_id INT, activity_id BIGINT, activity_name STRING, activity_type STRING, date DATE, start_time_local TIMESTAMP_NTZ, distance_m DOUBLE, duration_sec DOUBLE, "
    "calories INT, avg_hr INT, training_effect DOUBLE, training_load DOUBLE, start_lat DOUBLE, start_lon DOUBLE, location_name STRING, raw_json STRING"
)


def person(pid, days=200, seed=0, start="2023-06-01"):
    """Daily readings and runs of one entity, driven by its own seed."""
    rng = random.Random(seed)
    health, acts = [], []
    for i in range(days):
        d = day(start) + dt.timedelta(days=i)
        if rng.random() < 0.05:
            continue
        load = rng.random()
        health.append(
            (pid, d, i, int(50 + 6 * load + rng.gauss(0, 2)), int(25000 + rng.gauss(0, 2000)), rng.randrange(60, 95), rng.randrange(2000, 15000), 2300, 500, int(30 + 10 * load + rng.gauss(0, 4)), 60, 80, 30, rng.choice([None, 45, 50, 55]), "BALANCED", 96)
        )
        if rng.random() < 0.5:
            km = rng.choice([5.0, 8.0, 10.0, 21.1])
            race = rng.random() < 0.3
            acts.append(
                (pid, pid * 10_000 + i, f"Run {i}", "running", d, dt.datetime(d.year, d.month, d.day, 7), km * 1000, km * rng.uniform(280, 340), 500, 145, rng.uniform(1, 5), 100.0, 40.0, -75.0, "Cary", json.dumps({"eventType": {"typeKey": "race" if race else "training"}}))
            )
    return health, acts


def frames(spark, *people, parts=4):
    health = [r for h, _ in people for r in h]
    acts = [r for _, a in people for r in a]
    rng = random.Random(9)
    rng.shuffle(health)
    rng.shuffle(acts)
    details = []
    for a in acts:
        if a[1] % 4 == 0:
            details += series(a[1], 100, hr=lambda i, k=a[1]: 135 + (i + k) % 12)
    return {
        "daily_health": spark.createDataFrame(health, HEALTH).repartition(parts),
        "activities": spark.createDataFrame(acts, ACTS).repartition(parts),
        "activity_details": spark.createDataFrame(details, DETAIL_DDL).repartition(parts),
    }


def rows(df, pid=1):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.where(f"profile_id = {pid}").select(*cols).collect())


AS_OF = "2023-12-10"


def outputs(fr):
    as_of = F.lit(AS_OF).cast("date")
    race = races.races_report(fr)
    out = {
        "injury": injury.injury_report(fr)["weekly"],
        "features": features.feature_frame(fr)[0],
        "load": decompose.load_features(fr),
        "state": fitness.fitness_report(fr, as_of)["state"],
        "plan": fitness.fitness_report(fr, as_of)["plan"],
        "drift": fitness.drift_report(fr)["runs"],
        "ready": readiness.readiness_report(fr, as_of)["summary"],
        "expected": readiness.readiness_report(fr, as_of)["expected"],
        "recap": recap.recap_report(fr)["summary"].drop("raw_json"),
        "race": race["features"],
        "contrast": race["contrast"],
        "correlations": race["correlations"],
        "routes": routes.routes_report(fr, None)["routes"],
    }
    return {k: rows(v) for k, v in out.items()}


def test_an_entity_is_the_same_alone_or_among_many(spark):
    one = person(1, seed=1)
    alone = outputs(frames(spark, one, parts=1))
    many = outputs(frames(spark, one, person(2, seed=2), person(3, 90, seed=3), parts=6))
    for name in alone:
        assert alone[name] == many[name], name
    assert all(alone[k] for k in ("injury", "features", "state", "drift", "ready", "recap", "race", "routes"))


def test_rows_after_as_of_never_change_a_report(spark):
    as_of = "2023-10-15"
    whole = frames(spark, person(1, seed=1), person(2, seed=2))
    known = {**whole, **{n: whole[n].where(F.col("date") <= as_of) for n in ("daily_health", "activities")}}

    def reports(fr):
        day_ = F.lit(as_of).cast("date")
        out = {f"fitness {k}": v for k, v in fitness.fitness_report(fr, day_).items()}
        out |= {f"readiness {k}": v for k, v in readiness.readiness_report(fr, day_).items()}
        out |= {f"routes {k}": v for k, v in routes.routes_report(fr, day_).items()}
        return {k: rows(v) for k, v in out.items()}

    full, cut = reports(whole), reports(known)
    for name in full:
        assert full[name] == cut[name], name
    assert all(cut[k] for k in ("fitness state", "fitness plan", "fitness recovery", "readiness summary", "routes routes"))


# ------------------------------------------------------------------ regression
def test_gram_ols_matches_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 50, 2000] + [0, 10, 5000]
    y = 4 + x @ [2.0, -0.3, 0.001] + rng.normal(size=300)
    data = [(1 + i % 2, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))] + [(3, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "e INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    got = {r.e: (r.intercept, r.coef_a, r.coef_b, r.coef_c) for r in L.ols_gram(df, ["a", "b", "c"], "y", ["e"]).collect()}
    assert set(got) == {1, 2}
    for e in (1, 2):
        m = np.array([(i % 2) + 1 == e for i in range(300)])
        want = np.linalg.lstsq(np.column_stack([np.ones(m.sum()), x[m]]), y[m], rcond=None)[0]
        np.testing.assert_allclose(got[e], want, rtol=1e-6)


def test_gram_ols_survives_constant_and_collinear_features(spark):
    data = [(1, float(i), 2.0 * i, 7.0, 3.0 * i + 1) for i in range(120)]
    df = spark.createDataFrame(data, "e INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    coefs = L.ols_gram(df, ["a", "b", "c"], "y", ["e"])
    fitted = L.apply_coefficients(df, coefs, ["a", "b", "c"], ["e"], "p")
    assert fitted.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 1e-6


def test_decompose_splits_the_signal(spark):
    fr = frames(spark, person(1, 320, seed=4), person(2, 120, seed=5))
    out = decompose.decompose(fr)
    # entity 2 has fewer than 100 complete rows (90 are needed as history)
    assert {(r.target, r.profile_id) for r in out["coefficients"].collect()} == {("stress", 1), ("rhr", 1)}
    d = out["decomposed_health"].where("stress IS NOT NULL")
    assert d.agg(F.max(F.abs(F.col("stress") - F.col("stress_training") - F.col("stress_external")))).first()[0] < 1e-9
    assert d.agg(F.avg("stress_external")).first()[0] == pytest.approx(0, abs=1e-9)
    assert out["top_residuals"].where("target = 'stress'").count() == 10
    fit = out["fit"].where("target = 'rhr'").first()
    assert fit.rows_before - fit.dropped == fit.n >= 100
    assert 0 <= fit.r_squared <= 1 and fit.residual_min <= 0 <= fit.residual_max


# ----------------------------------------------------------------------- races
def race(aid, date, km, sec, raw='{"eventType":{"typeKey":"race"}}', kind="running"):
    d = day(date)
    return (1, aid, "x" * 60, kind, d, dt.datetime(d.year, d.month, d.day), None if km is None else km * 1000, sec, 1, 1, 1.0, 1.0, None, None, None, raw)


def test_race_classification_and_records(spark):
    acts = spark.createDataFrame(
        [
            race(1, "2024-01-01", 5.0, 1500.0),
            race(2, "2024-02-01", 5.0, 1500.0),
            race(3, "2024-03-01", 5.0, 1575.0),
            race(4, "2024-04-01", 5.0, 1650.0),
            race(5, "2024-04-02", 5.0, 1600.0),
            race(6, "2024-04-03", 5.41, 1500.0),
            race(7, "2024-04-04", 0.05, 1500.0),
            race(8, "2024-04-05", None, 1500.0),
            race(9, "2024-04-06", 5.0, 1500.0, "{bad"),
            race(10, "2024-04-07", 5.0, 1500.0, None),
            race(11, "2024-04-08", 5.0, 1500.0, "{}"),
            race(12, "2024-04-09", 5.0, 1.0),
            race(13, "2024-04-10", 5.0, 100.0, kind="cycling"),
        ],
        ACTS,
    )
    report = races.races_report({"activities": acts})
    assert {r.activity_id: r.quality for r in report["races"].collect()} == {1: "good", 2: "good", 3: "good", 4: "bad", 5: "neutral"}
    pr = report["records"].first()
    assert (pr.activity_id, pr.pace_text, pr.time_text) == (1, "5:00", "25:00")
    assert {r.reject_reason: r.n for r in report["rejects"].collect()} == {"unrecognised_distance": 1, "tiny": 3, "malformed_json": 2}
    assert all(len(r.short_name) == 50 for r in report["races"].collect())
    first = report["features"].where("activity_id = 1").first()
    assert (first.mileage_4w_km, first.n_runs_4w, first.longest_run_8w_km, first.taper_pct, first.stress_7d) == (0.0, 0.0, None, None, None)
    assert [f for f in races.RACE_FEATURES] == report["features"].columns[-29:]


def test_decomposed_features_reach_the_races(spark):
    fr = frames(spark, person(1, 320, seed=4))
    fr["decomposed_health"] = decompose.decompose(fr)["decomposed_health"]
    got = races.races_report(fr)["features"]
    assert got.where("stress_external_28d IS NOT NULL AND rhr_external_7d IS NOT NULL").count() > 0


# ------------------------------------------------------------------- readiness
def health_days(values, end="2024-03-31"):
    """One row per day up to ``end``; each value is a resting rate."""
    last = day(end)
    n = len(values)
    return [
        (1, last - dt.timedelta(days=n - 1 - i), i, v, 28000 + i % 7 * 100, 80, 5000, 2300, 500, 30 + i % 5, 50, 80, 40, 50, "BALANCED", 96)
        for i, v in enumerate(values)
    ]


def test_readiness_falls_back_to_yesterday(spark):
    as_of = F.lit("2024-03-31").cast("date")
    base = [50 + i % 3 for i in range(30)]
    full = spark.createDataFrame(health_days([*base, 60]), HEALTH)
    gap = spark.createDataFrame(health_days([*base, None]), HEALTH)
    assert readiness.assess(full, as_of).first().assessed_on == day("2024-03-31")
    assert readiness.assess(gap, as_of).first().assessed_on == day("2024-03-30")
    assert readiness.assess(full, F.lit("2024-04-03").cast("date")).count() == 0


def test_baseline_includes_the_day_for_readiness_but_not_for_recap(spark):
    daily = spark.createDataFrame(health_days([50] * 20 + [90]), HEALTH)
    ready = readiness.assess(daily, F.lit("2024-03-31").cast("date")).first()
    assert ready.resting_hr_mean == pytest.approx((20 * 50 + 90) / 21)
    latest = spark.createDataFrame([(1, day("2024-03-31"))], "profile_id INT, date DATE")
    back = recap.recovery_context(latest, daily).first()
    assert (back.resting_hr_mean, back.resting_hr_std, back.z_resting_hr) == (50.0, 0.0, 0.0)
    few = spark.createDataFrame(health_days([50] * 9 + [60]), HEALTH)
    assert recap.recovery_context(latest, few).count() == 0


# --------------------------------------------------------------------- fitness
def runs_frame(spark, items):
    data = [(1, i, day(d), dt.datetime.combine(day(d), dt.time(7)), km, 3.0, ce) for i, (d, km, ce) in enumerate(items)]
    return spark.createDataFrame(data, "profile_id INT, activity_id BIGINT, date DATE, start_time_local TIMESTAMP_NTZ, distance_km DOUBLE, gap_speed DOUBLE, ce DOUBLE")


def test_rolling_peak_needs_ten_runs_and_takes_the_first(spark):
    nine = runs_frame(spark, [(f"2024-01-{i + 1:02d}", 5.0, 0.02) for i in range(9)])
    assert fitness.rolling_peak(nine, BY).first()[1:] == (0.0, day("2024-01-01"))
    twelve = runs_frame(spark, [(f"2024-01-{i + 1:02d}", 5.0, 0.02) for i in range(12)])
    peak = fitness.rolling_peak(twelve, BY).first()
    assert peak.peak_ce == pytest.approx(0.02) and peak.peak_date == day("2024-01-10")


def test_week_plan_regimes(spark):
    as_of = F.lit("2024-03-31").cast("date")  # a Sunday

    def plan(now, before):
        items = [(f"2024-03-{d:02d}", now, 0.02) for d in (8, 15, 22, 29)] + [(f"2024-02-{d:02d}", before, 0.02) for d in (5, 12, 19, 26)]
        return fitness.week_plan(runs_frame(spark, items), BY, as_of).first()

    low, high, safe = plan(5.0, 10.0), plan(20.0, 10.0), plan(10.0, 10.0)
    assert (low.regime, high.regime, safe.regime) == ("detraining", "overtraining", "safe")
    assert low.target_vol == pytest.approx(34.0) and low.vol_gap == pytest.approx(14.0) and low.needs_quality and low.days_left == 0
    assert high.excess_km == pytest.approx(32.0) and high.reduced_run_km == 14.0 and high.n_easy_a is None
    assert safe.maintain_km == pytest.approx(10.0) and safe.recovery_favorable
    assert fitness.week_plan(runs_frame(spark, [("2024-03-08", 5.0, 0.02)]), BY, as_of).count() == 0


# -------------------------------------------------------------------- training
def test_feature_fill_before_and_after_the_join(spark):
    fr = frames(spark, person(1, 60, seed=1))
    first = fr["daily_health"].agg(F.min("date")).first()[0]
    fr["weight"] = spark.createDataFrame([(1, first, "t", 1, 70.0, 12.0)], "profile_id INT, date DATE, timestamp_gmt STRING, sample_pk BIGINT, weight_kg DOUBLE, body_fat DOUBLE")
    before, feats = features.feature_frame(fr)
    after, _ = features.feature_frame(fr, fill="after_join")
    assert before.where("weight_kg IS NOT NULL").count() == 1 and after.where("weight_kg IS NOT NULL").count() == 31
    assert "weight_kg" in feats and "vo2max" not in feats and len(feats) == 9 + 2 + 5 + 2 + 6
    _, kept = features.feature_matrix(fr, "next_day_steps")
    assert "weight_kg" not in kept and "steps" in kept


def test_unknown_target_and_bad_data(spark):
    with pytest.raises(KeyError):
        M.target_source("next_day_mood")
    assert M.target_source("next_day_hrv") == ("hrv_last_night", 1)
    with pytest.raises(QualityError):
        training.train(frames(spark, person(1, 30, seed=1)), "next_day_resting_hr")


def test_train_save_and_predict(spark, tmp_path):
    fr = frames(spark, person(1, 110, seed=1), person(2, 110, seed=2))
    fr = {k: fr[k] for k in ("daily_health", "activities")}
    out = training.train(fr, "next_day_resting_hr", path=str(tmp_path), start=40, step=20, settings=Settings(trees=5, depth=4))
    by_model = {r.model: r for r in out["metrics"].collect()}
    assert set(by_model) == {"forest", "mean", "persistence"}
    assert by_model["forest"].n == by_model["mean"].n == by_model["persistence"].n and by_model["forest"].mae < 6
    names = [r.feature for r in out["importance"].collect()]
    assert sorted(names) == sorted(out["features"])
    _, meta = load_model(spark, f"{tmp_path}/next_day_resting_hr")
    assert meta["feature_names"] == out["features"] and meta["n_training_rows"] > 0
    f = training.predict(spark, fr, "next_day_resting_hr", str(tmp_path)).collect()
    assert len(f) == 2 and all((r.forecast_date - r.feature_date).days == 1 and 40 < r.prediction < 70 for r in f)


def test_no_complete_fold_is_an_error(spark):
    fr = frames(spark, person(1, 40, seed=1))
    matrix, feats = features.feature_matrix({"daily_health": fr["daily_health"]}, "next_day_steps")
    with pytest.raises(ValueError):
        M.time_series_cv(matrix, feats, "next_day_steps", BY, start=60, step=7)


def test_status_and_profile(spark):
    fr = frames(spark, person(1, 20, seed=1))
    s = {r.dataset: r for r in status.status(fr).collect()}
    assert set(s) == {"daily_health", "activities"} and s["daily_health"].row_count == fr["daily_health"].count()
    p = status.profile_all({"daily_health": fr["daily_health"]})
    hrv = p["columns"].where("column = 'hrv_last_night'").first()
    assert hrv.null_count + hrv.non_null == hrv.row_count and 45 <= hrv.mean <= 55
    assert p["dates"].first().unique_dates == hrv.row_count
