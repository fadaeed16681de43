"""Races, contrasts, correlations, regressions, baselines and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import aggregates as A
from ..operators import forest as M
from ..operators import linear as L
from ..operators.trees import Settings, fit
from ..plans import decompose, features, races
from ..session import durable, scratch_path
from ..sources import entities as E
from ..sources import sinks as K
from .fits import COMPLETE, DECOMPOSED_SQL, LOADED, SOLVED
from .frames import BY, Frames
from .registry import query
from .rollups import FEATURE_NAMES, FEATURES_SQL, NATION_DAY, nation_day

CLASSIFIED = """
  SELECT *, CASE WHEN NOT json_valid(raw_json) THEN 'malformed_json'
      WHEN coalesce(CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.eventType.typeKey' END, '') <> 'race' THEN 'not_a_race'
      WHEN coalesce(distance_m, 0) < 100 OR coalesce(duration_sec, 0) < 60 THEN 'tiny' WHEN bucket IS NULL THEN 'unrecognised_distance' END AS reject_reason
  FROM (SELECT *, coalesce(distance_m, 0) / 1000 AS distance_km,
          CASE WHEN coalesce(distance_m, 0) / 1000 BETWEEN 4.8e0 AND 5.4e0 THEN '5K' WHEN coalesce(distance_m, 0) / 1000 BETWEEN 9.6e0 AND 10.8e0 THEN '10K'
               WHEN coalesce(distance_m, 0) / 1000 BETWEEN 20.5e0 AND 22.2e0 THEN 'Half Marathon' WHEN coalesce(distance_m, 0) / 1000 BETWEEN 41.5e0 AND 43.5e0 THEN 'Marathon' END AS bucket
        FROM run_like)"""
RACES = f"(SELECT *, duration_sec / distance_km AS pace FROM ({CLASSIFIED}) WHERE reject_reason IS NULL)"
GRADED = f"""(SELECT *, (pace - best_pace) / best_pace * 100 AS off_pct,
    CASE WHEN (pace - best_pace) / best_pace <= 0.05e0 THEN 'good' WHEN (pace - best_pace) / best_pace >= 0.1e0 THEN 'bad' ELSE 'neutral' END AS quality
  FROM (SELECT *, min(pace) OVER (PARTITION BY profile_id, bucket) AS best_pace, count(*) OVER (PARTITION BY profile_id, bucket) AS in_bucket FROM {RACES}))"""


@query("bucket_classify", "activity_id:i, bucket, reject_reason", CLASSIFIED)
def bucket_classify(f: Frames) -> DataFrame:
    return races.classify_activities(f.acts)


@query(
    "reject_counters",
    "profile_id, reject_reason, n:i",
    f"SELECT profile_id, reject_reason, count(*) AS n FROM ({CLASSIFIED}) WHERE reject_reason <> 'not_a_race' GROUP BY 1, 2",
)
def reject_counters(f: Frames) -> DataFrame:
    return A.reject_counts(races.classify_activities(f.acts).where("reject_reason IS NULL OR reject_reason <> 'not_a_race'"), BY)


@query(
    "pr_per_bucket",
    "profile_id, bucket, activity_id:i, date:d, pace:6, pace_text, time_text",
    f"""SELECT profile_id, bucket, activity_id, date, pace, CAST(p // 60 AS STRING) || ':' || lpad(CAST(p % 60 AS STRING), 2, '0') AS pace_text,
          CASE WHEN t >= 3600 THEN CAST(t // 3600 AS STRING) || ':' || lpad(CAST(t % 3600 // 60 AS STRING), 2, '0') ELSE CAST(t // 60 AS STRING) END || ':' || lpad(CAST(t % 60 AS STRING), 2, '0') AS time_text
        FROM (SELECT *, CAST(round(pace) AS BIGINT) AS p, CAST(duration_sec AS BIGINT) AS t FROM {RACES}
              QUALIFY row_number() OVER (PARTITION BY profile_id, bucket ORDER BY pace, date, activity_id) = 1)""",
)
def pr_per_bucket(f: Frames) -> DataFrame:
    return races.personal_records(races.load_races(races.classify_activities(f.acts)))


@query("quality_class", "profile_id, activity_id:i, bucket, pace:6, off_pct:6, quality", f"SELECT * FROM {GRADED}")
def quality_class(f: Frames) -> DataFrame:
    return races.with_quality(races.load_races(races.classify_activities(f.acts)))


def _runs(agg: str, cond: str) -> str:
    return f"(SELECT {agg} FROM run_like x WHERE x.profile_id = r.profile_id AND {cond})"


_DAILY_RACE = """
  SELECT r.activity_id, avg(sleep_seconds) FILTER (b <= 7) / 3600 AS sleep_hours_7d, avg(sleep_seconds) FILTER (b <= 28) / 3600 AS sleep_hours_28d,
    avg(avg_stress) FILTER (b <= 7) AS stress_7d, avg(avg_stress) FILTER (b <= 28) AS stress_28d, avg(avg_stress) AS stress_12w,
    avg(CASE WHEN avg_stress > 50 THEN 1e0 WHEN avg_stress IS NOT NULL THEN 0e0 END) FILTER (b <= 28) AS high_stress_days_28d_pct,
    avg(resting_hr) FILTER (b <= 7) AS rhr_7d, avg(resting_hr) FILTER (b <= 28) AS rhr_28d,
    avg(hrv_last_night) FILTER (b <= 7) AS hrv_7d, avg(hrv_last_night) FILTER (b <= 28) AS hrv_28d, avg(hrv_last_night) AS hrv_12w,
    avg(CASE WHEN hrv_status IN ('UNBALANCED', 'LOW') THEN 1e0 WHEN hrv_status IS NOT NULL THEN 0e0 END) FILTER (b <= 28) AS hrv_unbalanced_days_28d_pct
  FROM {races} r JOIN (SELECT *, 0 AS one FROM daily) d ON d.profile_id = r.profile_id AND d.date BETWEEN r.date - 84 AND r.date - 1, LATERAL (SELECT r.date - d.date AS b)
  GROUP BY 1"""
_DECOMPOSED_MEANS = ", ".join(
    f"avg({c}) FILTER (r.date - d.date <= {k}) AS {c}_{k}d" for c in ("stress_external", "stress_training", "rhr_external") for k in (7, 28)
)
RACE_FEATURES_SQL = f"""
  SELECT r.profile_id, r.bucket, r.activity_id, r.pace, r.quality, f.* EXCLUDE (activity_id), v.* EXCLUDE (activity_id), d.* EXCLUDE (activity_id), w.weight_kg, p.vo2max_at_race,
    CASE r.bucket WHEN '5K' THEN p5 / 5 WHEN '10K' THEN p10 / 10 WHEN 'Half Marathon' THEN ph / 21.0975e0 WHEN 'Marathon' THEN pm / 42.195e0 END AS garmin_predicted_pace,
    rhr_7d - rhr_28d AS rhr_delta_7d_vs_28d, hrv_7d - hrv_28d AS hrv_delta_7d_vs_28d,
    CASE WHEN prior3 > 0 THEN 1 - lw / (prior3 / 3) END AS taper_pct
  FROM (SELECT * FROM {GRADED} WHERE in_bucket >= 2) r
  LEFT JOIN ({_DAILY_RACE.format(races=RACES)}) f USING (activity_id)
  LEFT JOIN (SELECT r.activity_id, coalesce(sum(x.distance_m / 1000) FILTER (r.date - x.date <= 28), 0) AS mileage_4w_km, coalesce(sum(x.distance_m / 1000) FILTER (r.date - x.date <= 56), 0) AS mileage_8w_km,
      coalesce(sum(x.distance_m / 1000), 0) AS mileage_12w_km, max(x.distance_m / 1000) FILTER (r.date - x.date <= 56) AS longest_run_8w_km, count(x.activity_id) FILTER (r.date - x.date <= 28) AS n_runs_4w,
      coalesce(sum(x.distance_m / 1000) FILTER (r.date - x.date <= 7), 0) AS lw, coalesce(sum(x.distance_m / 1000) FILTER (r.date - x.date BETWEEN 8 AND 28), 0) AS prior3
    FROM {RACES} r LEFT JOIN run_like x ON x.profile_id = r.profile_id AND x.date BETWEEN r.date - 84 AND r.date - 1 GROUP BY 1) v USING (activity_id)
  LEFT JOIN (SELECT r.activity_id, arg_max(w.weight_kg, (w.date, w.timestamp_gmt, w.sample_pk)) FILTER (w.weight_kg IS NOT NULL) AS weight_kg
    FROM {RACES} r JOIN weight w ON w.profile_id = r.profile_id AND w.date BETWEEN r.date - 30 AND r.date - 1 GROUP BY 1) w USING (activity_id)
  LEFT JOIN (SELECT r.activity_id, arg_max(vo2max, (p.date, p.ingest_seq)) FILTER (vo2max IS NOT NULL) AS vo2max_at_race, arg_max(race_5k_sec, (p.date, p.ingest_seq)) FILTER (race_5k_sec IS NOT NULL) AS p5,
      arg_max(race_10k_sec, (p.date, p.ingest_seq)) FILTER (race_10k_sec IS NOT NULL) AS p10, arg_max(race_half_sec, (p.date, p.ingest_seq)) FILTER (race_half_sec IS NOT NULL) AS ph, arg_max(race_marathon_sec, (p.date, p.ingest_seq)) FILTER (race_marathon_sec IS NOT NULL) AS pm
    FROM {RACES} r JOIN performance p ON p.profile_id = r.profile_id AND p.date BETWEEN r.date - 30 AND r.date - 1 GROUP BY 1) p USING (activity_id)
  LEFT JOIN (SELECT r.activity_id, {_DECOMPOSED_MEANS}
    FROM {RACES} r JOIN ({DECOMPOSED_SQL}) d ON d.profile_id = r.profile_id AND d.date BETWEEN r.date - 28 AND r.date - 1 GROUP BY 1) d USING (activity_id)"""


def race_report(f: Frames) -> dict[str, DataFrame]:
    """The report with all sources, the decomposed signals included as the derived table they are stored as."""
    return races.races_report({**f.order_frames, "decomposed_health": durable(decompose.decompose(f.order_frames)["decomposed_health"])})


@query(
    "race_features",
    "profile_id, activity_id:i, bucket, " + ", ".join(f"{c}:6" for c in races.RACE_FEATURES),
    RACE_FEATURES_SQL,
)
def race_features(f: Frames) -> DataFrame:
    return race_report(f)["features"]


_MELTED = " UNION ALL ".join(f"SELECT profile_id, bucket, quality, pace, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM rf" for c in races.RACE_FEATURES)


@query(
    "good_bad_contrast",
    "profile_id, bucket, feature, n_good:i, n_bad:i, good_mean:7, bad_mean:7, delta:7",
    f"""WITH rf AS MATERIALIZED ({RACE_FEATURES_SQL})
        SELECT profile_id, bucket, feature, count(*) FILTER (quality = 'good') AS n_good, count(*) FILTER (quality = 'bad') AS n_bad,
          avg(value) FILTER (quality = 'good') AS good_mean, avg(value) FILTER (quality = 'bad') AS bad_mean, avg(value) FILTER (quality = 'good') - avg(value) FILTER (quality = 'bad') AS delta
        FROM ({_MELTED}) GROUP BY 1, 2, 3 HAVING n_good > 0 AND n_bad > 0""",
)
def good_bad_contrast(f: Frames) -> DataFrame:
    return race_report(f)["contrast"]


@query(
    "feature_correlations",
    "bucket, feature, n:i, r:6, slope:5",
    f"""WITH rf AS MATERIALIZED ({RACE_FEATURES_SQL})
        SELECT bucket, feature, count(value) AS n, covar_pop(pace, value) / sqrt(var_pop(value) * var_pop(pace) FILTER (value IS NOT NULL)) AS r, covar_pop(pace, value) / var_pop(value) AS slope
        FROM ({_MELTED}) GROUP BY 1, 2 HAVING n >= 3 AND var_pop(value) > 0
        QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY abs(r) DESC, feature) <= 12""",
)
def feature_correlations(f: Frames) -> DataFrame:
    return races.feature_correlations(race_report(f)["features"], races.RACE_FEATURES, "pace", ["bucket"])


# --------------------------------------------------------- correlation and OLS
@query(
    "safe_corr_drivers",
    "l_returnflag, l_linenumber:i, n:i, r:6, r_or_zero:6, slope:6, intercept:4, flat, flat_or_zero:6",
    """SELECT l_returnflag, l_linenumber, count(*) AS n, corr(l_extendedprice, l_quantity) AS r, corr(l_extendedprice, l_quantity) AS r_or_zero,
         covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) AS slope, avg(l_extendedprice) - covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) * avg(l_quantity) AS intercept,
         CAST(NULL AS DOUBLE) AS flat, 0e0 AS flat_or_zero
       FROM lineitem GROUP BY 1, 2""",
)
def safe_corr_drivers(f: Frames) -> DataFrame:
    x, y, k = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    return f.table("lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        stats.corr_safe(x, y).alias("r"),
        stats.corr_or_zero(x, y).alias("r_or_zero"),
        stats.slope_safe(x, y).alias("slope"),
        stats.intercept_safe(x, y).alias("intercept"),
        stats.corr_safe(k, y).alias("flat"),
        stats.corr_or_zero(k, y).alias("flat_or_zero"),
    )


TWO = f"""(SELECT profile_id, date, volume, orders, prior FROM (
  SELECT *, sum(volume) OVER (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior, row_number() OVER (PARTITION BY profile_id ORDER BY date) AS i FROM ({NATION_DAY})) WHERE i > 7 AND volume IS NOT NULL)"""
COEFS = f"""(SELECT *, my - b1 * m1 - b2 * m2 AS intercept FROM (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2
  FROM (SELECT profile_id, count(*) AS n, avg(orders) AS m1, avg(prior) AS m2, avg(volume) AS my, var_pop(orders) AS v1, var_pop(prior) AS v2, covar_pop(orders, prior) AS c12, covar_pop(orders, volume) AS c1y, covar_pop(prior, volume) AS c2y
        FROM {TWO} GROUP BY 1) WHERE n >= 100))"""


def two_features(f: Frames) -> DataFrame:
    from ..operators.windows import trailing

    return nation_day(f).withColumn("prior", trailing("volume", BY, "date", 7, "sum", 0, shift=1)).withColumn(
        "rn", trailing("orders", BY, "date", 7, "count", 7, shift=1)
    ).where("rn IS NOT NULL AND volume IS NOT NULL")


@query("simple_ols", "profile_id, n:i, intercept:6, coef_orders:6, coef_prior:7", f"SELECT profile_id, n, intercept, b1 AS coef_orders, b2 AS coef_prior FROM {COEFS}")
def simple_ols(f: Frames) -> DataFrame:
    return L.two_feature_ols(two_features(f), BY, "orders", "prior", "volume", 100)


@query("gram_ols", "profile_id, n:i, intercept:6, coef_orders:6, coef_prior:7", f"SELECT profile_id, n, intercept, b1 AS coef_orders, b2 AS coef_prior FROM {COEFS}")
def gram_ols(f: Frames) -> DataFrame:
    return L.ols_gram(two_features(f), ["orders", "prior"], "volume", BY)


@query(
    "ols_decompose",
    "profile_id, date:d, actual:6, fitted:6, residual:6",
    f"SELECT profile_id, date, volume AS actual, intercept + b1 * orders + b2 * prior AS fitted, volume - (intercept + b1 * orders + b2 * prior) AS residual FROM {TWO} JOIN {COEFS} USING (profile_id)",
)
def ols_decompose(f: Frames) -> DataFrame:
    return decompose.fit_one(two_features(f), "volume", ["orders", "prior"])[1]


@query(
    "fit_metrics",
    "profile_id, n:i, r_squared:6, target_mean:6, residual_mae:6, residual_min:6, residual_max:6",
    f"""SELECT profile_id, count(*) AS n, 1 - sum(e * e) / (var_pop(volume) * count(*)) AS r_squared, avg(volume) AS target_mean, avg(abs(e)) AS residual_mae, min(e) AS residual_min, max(e) AS residual_max
        FROM (SELECT *, volume - (intercept + b1 * orders + b2 * prior) AS e FROM {TWO} JOIN {COEFS} USING (profile_id)) GROUP BY 1""",
)
def fit_metrics(f: Frames) -> DataFrame:
    return decompose.fit_report(decompose.fit_one(two_features(f), "volume", ["orders", "prior"])[1], BY)


@query(
    "top_residuals",
    "profile_id, rank:i, date:d, residual:6",
    f"""SELECT profile_id, date, e AS residual, row_number() OVER (PARTITION BY profile_id ORDER BY e DESC, date) AS rank
        FROM (SELECT *, volume - (intercept + b1 * orders + b2 * prior) AS e FROM {TWO} JOIN {COEFS} USING (profile_id)) QUALIFY rank <= 10""",
)
def top_residuals(f: Frames) -> DataFrame:
    return decompose.top_residuals(decompose.fit_one(two_features(f), "volume", ["orders", "prior"])[1], BY)


@query(
    "ols_normal_equations",
    "target, profile_id, n:i, mean_residual:6, worst_projection:6",
    " UNION ALL ".join(
        f"SELECT '{label}' AS target, profile_id, count(*) AS n, 0e0 AS mean_residual, 0e0 AS worst_projection FROM {LOADED} WHERE {COMPLETE} AND {target} IS NOT NULL GROUP BY 2 HAVING count(*) >= 100"
        for target, label in decompose.DECOMPOSE_TARGETS
    ),
)
def ols_normal_equations(f: Frames) -> DataFrame:
    """A least-squares fit leaves residuals orthogonal to every feature; the check expects zeros."""
    spine = decompose.load_features(f.order_frames)
    out = None
    for target, label in decompose.DECOMPOSE_TARGETS:
        rows = decompose.fit_one(spine, target)[1]
        leaks = [F.abs(stats.corr_or_zero(F.col("residual"), F.col(x))) for x in decompose.DECOMPOSE_FEATURES]
        one = rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"), F.greatest(*leaks).alias("worst_projection"))
        one = one.select(F.lit(label).alias("target"), *BY, "n", "mean_residual", "worst_projection")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "decomposed_health",
    "profile_id, date:d, stress:2, stress_training:4, stress_external:4, rhr:2, rhr_training:4, rhr_external:4",
    DECOMPOSED_SQL,
)
def decomposed_health(f: Frames) -> DataFrame:
    """Both signals with their two parts."""
    return decompose.decompose(f.order_frames)["decomposed_health"]


@query(
    "stored_decomposed",
    "profile_id, date:d, stress:2, stress_training:4, stress_external:4, rhr:2, rhr_training:4, rhr_external:4",
    DECOMPOSED_SQL,
)
def stored_decomposed(f: Frames) -> DataFrame:
    """The decomposition saved as a derived table and loaded again."""
    path = scratch_path(f.spark, "decomposed")
    K.save(decompose.decompose(f.order_frames)["decomposed_health"], f"{path}/decomposed_health")
    return E.load_decomposed(f.spark, path, required=True)


@query(
    "ols_decompose_full",
    "target, profile_id, n:i, intercept:3, " + ", ".join(f"coef_{c}:5" for c in decompose.DECOMPOSE_FEATURES),
    " UNION ALL ".join(
        f"SELECT '{label}' AS target, profile_id, n, intercept, {', '.join(f'c_{i} AS coef_{c}' for i, c in enumerate(decompose.DECOMPOSE_FEATURES))} FROM ({SOLVED[target]})"
        for target, label in decompose.DECOMPOSE_TARGETS
    ),
)
def ols_decompose_full(f: Frames) -> DataFrame:
    return decompose.decompose(f.order_frames)["coefficients"]


# --------------------------------------------------------- validation, forests
def _folds_sql(rows: str) -> str:
    """(date, fold, first) on the calendar of all entities: 30 days, then every 7."""
    return f"""(SELECT date, fold, min(date) OVER (PARTITION BY fold) AS first
      FROM (SELECT date, (i - 30) // 7 AS fold FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {rows}))
            WHERE i >= 30 AND 30 + 7 * ((i - 30) // 7 + 1) <= n))"""


_CV_ROWS = f"""(SELECT * FROM (SELECT *, lead(resting_hr) OVER (PARTITION BY profile_id ORDER BY date) AS y FROM ({FEATURES_SQL})) WHERE y IS NOT NULL AND resting_hr IS NOT NULL)"""
_BASELINES = f"""(WITH r AS {_CV_ROWS}, g AS {_folds_sql('r')}, f AS (SELECT DISTINCT fold, first FROM g),
  o AS (SELECT r.profile_id, fold, avg(r.y) AS own FROM f JOIN r ON r.date < f.first GROUP BY 1, 2),
  e AS (SELECT fold, avg(r.y) AS every FROM f JOIN r ON r.date < f.first GROUP BY 1)
  SELECT r.profile_id, r.date, g.fold, r.y, r.resting_hr AS persistence_pred, coalesce(own, every) AS mean_pred
  FROM r JOIN g ON r.date = g.date JOIN e ON e.fold = g.fold LEFT JOIN o ON o.profile_id = r.profile_id AND o.fold = g.fold)"""


def _cv_rows(f: Frames) -> DataFrame:
    df, _ = features.feature_frame({"daily_health": f.daily_raw})
    return features.with_target(df, "next_day_resting_hr", BY).dropna(subset=["resting_hr", "next_day_resting_hr"])


@query(
    "cv_baselines",
    "profile_id, date:d, fold:i, persistence_pred:4, mean_pred:6",
    f"SELECT * FROM {_BASELINES}",
)
def cv_baselines(f: Frames) -> DataFrame:
    return M.cv_baselines(_cv_rows(f), "next_day_resting_hr", M.TARGETS["next_day_resting_hr"][0], BY)


@query(
    "cv_baseline_metrics",
    "model, n:i, mae:6, rmse:6, r_squared:6",
    f"""SELECT model, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r_squared
        FROM (SELECT 'mean' AS model, y, mean_pred AS p FROM {_BASELINES} UNION ALL SELECT 'persistence', y, persistence_pred FROM {_BASELINES}) GROUP BY 1""",
)
def cv_baseline_metrics(f: Frames) -> DataFrame:
    rows = M.cv_baselines(_cv_rows(f), "next_day_resting_hr", M.TARGETS["next_day_resting_hr"][0], BY)
    return M.baseline_metrics(rows, "next_day_resting_hr")


# Rows with all features that feature_matrix keeps, and their target.
_NULLS = f"""m AS (SELECT *, lead(resting_hr) OVER (PARTITION BY profile_id ORDER BY date) AS y FROM ({FEATURES_SQL})),
  s AS (SELECT {', '.join(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_{c}' for c in FEATURE_NAMES)} FROM m)"""
_COMPLETE = " AND ".join(f"(null_{c} > 0.3e0 OR {c} IS NOT NULL)" for c in FEATURE_NAMES)
_FOREST_ROWS = f"(WITH {_NULLS} SELECT m.* FROM m, s WHERE y IS NOT NULL AND {_COMPLETE})"
_NEWEST = f"(WITH {_NULLS} SELECT m.* FROM m, s WHERE {_COMPLETE} QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY date DESC) = 1)"
TARGET = "next_day_resting_hr"


def _matrix(f: Frames) -> tuple[DataFrame, list[str]]:
    rows, feats = features.feature_matrix(f.order_frames, TARGET)
    return durable(rows), feats


# SQL cannot grow the forests; tests compare them with a plain version. What follows from the rows alone
# (which rows are predicted from which, which features are ranked) has queries with SQL of its own.
@query("rf_cv", "model, n:i, mae:6, rmse:6, r_squared:6")
def rf_cv(f: Frames) -> DataFrame:
    rows, feats = _matrix(f)
    scored = M.time_series_cv(rows, feats, TARGET, BY)
    forest = M.metrics_frame(scored, TARGET, "prediction").select(F.lit("forest").alias("model"), "*")
    return forest.unionByName(M.baseline_metrics(M.cv_baselines(rows, TARGET, M.TARGETS[TARGET][0], BY), TARGET))


@query(
    "rf_cv_folds",
    "fold:i, n:i, first_day:d, last_day:d, trained_until:d",
    f"""WITH r AS {_FOREST_ROWS}, g AS {_folds_sql('r')}
      SELECT fold, count(*) AS n, min(r.date) AS first_day, max(r.date) AS last_day, any_value(until) AS trained_until
      FROM r JOIN g USING (date) JOIN (SELECT fold, max(r.date) AS until FROM (SELECT DISTINCT fold, first FROM g) f JOIN r ON r.date < f.first GROUP BY 1) b USING (fold) GROUP BY 1""",
)
def rf_cv_folds(f: Frames) -> DataFrame:
    rows, _ = _matrix(f)
    tested = rows.join(M.calendar_folds(rows).where("fold IS NOT NULL"), "date")
    return tested.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.max("trained_until").alias("trained_until")
    )


def _ranked(f: Frames) -> tuple[DataFrame, DataFrame]:
    rows, feats = _matrix(f)
    tail = M.importance_tail(rows, BY)
    return M.permutation_importance(fit(rows, feats, TARGET, [*BY, "date"], Settings()), tail, TARGET, BY), tail


@query("permutation_importance", "feature, importance:9, place:i")
def permutation_importance(f: Frames) -> DataFrame:
    ranked, _ = _ranked(f)
    # one row per feature
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


@query(
    "importance_rows",
    "feature, rows:i, finite",
    f"""WITH {_NULLS}, k AS (UNPIVOT s ON COLUMNS(*) INTO NAME feature VALUE share),
          r AS (SELECT row_number() OVER (PARTITION BY profile_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY profile_id) AS n FROM m, s WHERE y IS NOT NULL AND {_COMPLETE})
        SELECT substr(feature, 6) AS feature, (SELECT count(*) FROM r WHERE i >= floor(n * 0.8e0)) AS rows, true AS finite FROM k WHERE share <= 0.3e0""",
)
def importance_rows(f: Frames) -> DataFrame:
    ranked, tail = _ranked(f)
    finite = F.col("importance").isNotNull() & ~F.isnan("importance")
    return ranked.select("feature", F.lit(tail.count()).alias("rows"), finite.alias("finite"))


def _forecast(f: Frames) -> tuple[DataFrame, DataFrame]:
    rows, feats = _matrix(f)
    model = fit(rows, feats, TARGET, [*BY, "date"], Settings())
    return M.forecast(model, features.prediction_rows(f.order_frames, feats), BY), rows


@query("rf_forecast", "profile_id, feature_date:d, forecast_date:d, prediction:6")
def rf_forecast(f: Frames) -> DataFrame:
    return _forecast(f)[0]


@query(
    "rf_forecast_days",
    "profile_id, feature_date:d, forecast_date:d, in_range",
    f"SELECT profile_id, date AS feature_date, date + 1 AS forecast_date, true AS in_range FROM {_NEWEST}",
)
def rf_forecast_days(f: Frames) -> DataFrame:
    predicted, rows = _forecast(f)
    low, high = rows.agg(F.min(TARGET), F.max(TARGET)).first()
    return predicted.withColumn("in_range", F.col("prediction").between(low, high))


@query(
    "model_store",
    "profile_id, feature_date:d, model_rows:i, same_prediction",
    f"SELECT profile_id, date AS feature_date, (SELECT count(*) FROM {_FOREST_ROWS}) AS model_rows, true AS same_prediction FROM {_NEWEST}",
)
def model_store(f: Frames) -> DataFrame:
    """A model saved twice, with another in between; the latest is loaded by the pointer and predicts as it did before."""
    rows, feats = _matrix(f)
    path, meta = scratch_path(f.spark, "models"), {"target": TARGET, "rows": rows.count()}
    model = fit(rows, feats, TARGET, [*BY, "date"], Settings())
    version = K.save_model(model, meta, path)
    K.save_model(fit(rows, feats, TARGET, [*BY, "date"], Settings(trees=20, seed=1)), {"target": TARGET, "rows": 0}, path)
    if K.save_model(model, meta, path) != version:
        raise AssertionError("the same content has two versions")
    loaded, known = K.load_model(f.spark, path)
    newest = features.prediction_rows(f.order_frames, feats)
    before = M.forecast(model, newest, BY).select(*BY, F.col("prediction").alias("before"))
    return M.forecast(loaded, newest, BY).join(before, BY).withColumns({"model_rows": F.lit(known["rows"]), "same_prediction": F.abs(F.col("prediction") - F.col("before")) < 1e-9})


@query(
    "prediction_rows",
    "profile_id, date:d, resting_hr:2, sleep_hours:6, steps:2, activity_count:2, steps_7d_mean:4",
    f"SELECT * FROM {_NEWEST}",
)
def prediction_rows(f: Frames) -> DataFrame:
    return features.prediction_rows(f.order_frames, _matrix(f)[1])


@query(
    "volume_percentile",
    "profile_id, vol_pct:6",
    """SELECT m.profile_id, 100 * avg(CASE WHEN m.km < v.vol_28d * 30 / 28 THEN 1e0 ELSE 0e0 END) AS vol_pct
       FROM (SELECT profile_id, date_trunc('month', date), sum(coalesce(distance_m, 0)) / 1000 AS km FROM run_like GROUP BY 1, 2) m
       JOIN (SELECT profile_id, coalesce(sum(distance_m) FILTER (date > DATE '2001-06-30' - 28 AND date <= DATE '2001-06-30'), 0) / 1000 AS vol_28d FROM run_like GROUP BY 1) v ON m.profile_id = v.profile_id
       GROUP BY 1""",
)
def volume_percentile(f: Frames) -> DataFrame:
    from ..plans.fitness import running

    runs = running(f.acts).withColumn("distance_km", F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0)
    now = A.trailing_volumes(runs, BY, F.lit("2001-06-30").cast("date"))
    return A.volume_percentile(A.monthly_volume(runs, BY), now, BY)
