"""Cleaning, profiling, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import clean as C
from ..operators.windows import keep_last
from ..plans.status import profile_all, status
from .frames import BY, Frames
from .registry import query

DAILY_COLUMNS = (
    "profile_id, date:d, ingest_seq:i, resting_hr:i, sleep_seconds:i, sleep_score:i, steps:i, total_calories:i, "
    "active_calories:i, avg_stress:i, max_stress:i, body_battery_start:i, body_battery_end:i, hrv_last_night:i, hrv_status"
)


@query("clean_ranges", DAILY_COLUMNS, "SELECT * FROM ranged")
def clean_ranges(f: Frames) -> DataFrame:
    return C.null_together(C.null_out_of_range(f.daily_raw), C.BATTERY, 0, 100)


@query(
    "coupled_null",
    "ingest_seq:i, body_battery_start:i, body_battery_end:i",
    """SELECT ingest_seq, CASE WHEN bad THEN NULL ELSE body_battery_start END AS body_battery_start,
         CASE WHEN bad THEN NULL ELSE body_battery_end END AS body_battery_end
       FROM (SELECT *, coalesce(least(body_battery_start, body_battery_end) < 0 OR greatest(body_battery_start, body_battery_end) > 100, false) AS bad FROM daily_raw)""",
)
def coupled_null(f: Frames) -> DataFrame:
    return C.null_together(f.daily_raw, C.BATTERY, 0, 100)


@query("nowear_filter", "ingest_seq:i, resting_hr:i, sleep_seconds:i, steps:i", "SELECT * FROM worn")
def nowear_filter(f: Frames) -> DataFrame:
    return C.drop_no_wear(C.null_out_of_range(f.daily_raw))


@query("clean_daily", DAILY_COLUMNS, "SELECT * FROM daily")
def clean_daily(f: Frames) -> DataFrame:
    return f.daily


@query(
    "dedup_keep_last",
    "o_custkey:i, day:d, o_orderkey:i, o_totalprice:2",
    """SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
       FROM orders GROUP BY 1, 2""",
)
def dedup_keep_last(f: Frames) -> DataFrame:
    orders = f.table("orders").withColumn("day", F.to_date("o_orderdate"))
    return keep_last(orders, ["o_custkey", "day"], ["o_orderkey"])


@query(
    "cleaning_diff",
    "profile_id, rows_before:i, rows_after:i, rows_dropped:i, nulls_resting_hr:i, nulls_sleep_seconds:i, nulls_steps:i, "
    "nulls_total_calories:i, nulls_active_calories:i, nulls_avg_stress:i, nulls_max_stress:i, nulls_body_battery_start:i, nulls_body_battery_end:i",
    """SELECT profile_id, b.n AS rows_before, a.n AS rows_after, b.n - a.n AS rows_dropped, a.* EXCLUDE (profile_id, n)
       FROM (SELECT profile_id, count(*) AS n FROM daily_raw GROUP BY 1) b
       JOIN (SELECT profile_id, count(*) AS n, count(*) - count(resting_hr) AS nulls_resting_hr, count(*) - count(sleep_seconds) AS nulls_sleep_seconds,
               count(*) - count(steps) AS nulls_steps, count(*) - count(total_calories) AS nulls_total_calories,
               count(*) - count(active_calories) AS nulls_active_calories, count(*) - count(avg_stress) AS nulls_avg_stress,
               count(*) - count(max_stress) AS nulls_max_stress, count(*) - count(body_battery_start) AS nulls_body_battery_start,
               count(*) - count(body_battery_end) AS nulls_body_battery_end FROM daily GROUP BY 1) a USING (profile_id)""",
)
def cleaning_diff(f: Frames) -> DataFrame:
    return C.cleaning_diff(f.daily_raw, f.daily, BY)


_PROFILED = ["date", "resting_hr", "steps", "sleep_seconds", "sleep_score", "avg_stress", "hrv_last_night", "hrv_status", "avg_spo2"]


@query(
    "column_profile",
    "column, row_count:i, null_count:i, null_pct:6, non_null:i, mean:6, min:6, max:6",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
              (count(*) - count({c})) * 100e0 / count(*) AS null_pct, count({c}) AS non_null,
              {f'avg({c})' if c not in ('date', 'hrv_status') else 'CAST(NULL AS DOUBLE)'} AS mean,
              {f'min({c})' if c not in ('date', 'hrv_status') else 'CAST(NULL AS DOUBLE)'} AS min,
              {f'max({c})' if c not in ('date', 'hrv_status') else 'CAST(NULL AS DOUBLE)'} AS max FROM daily"""
        for c in _PROFILED
    ),
)
def column_profile(f: Frames) -> DataFrame:
    return A.profile(f.daily, _PROFILED)


@query(
    "date_profile",
    "dataset, min_date:d, max_date:d, unique_dates:i",
    """SELECT 'daily_health' AS dataset, min(date) AS min_date, max(date) AS max_date, count(DISTINCT date) AS unique_dates FROM daily_raw
       UNION ALL SELECT 'weight', min(date), max(date), count(DISTINCT date) FROM weight""",
)
def date_profile(f: Frames) -> DataFrame:
    return profile_all({"daily_health": f.daily_raw, "weight": f.weight})["dates"]


@query(
    "dataset_summary",
    "dataset, row_count:i, min_date:d, max_date:d",
    """SELECT 'daily_health' AS dataset, count(date) AS row_count, min(date) AS min_date, max(date) AS max_date FROM daily_raw
       UNION ALL SELECT 'activities', count(start_time_local), CAST(min(start_time_local) AS DATE), CAST(max(start_time_local) AS DATE) FROM acts
       UNION ALL SELECT 'performance_metrics', count(date), min(date), max(date) FROM performance
       UNION ALL SELECT 'weight', count(date), min(date), max(date) FROM weight
       UNION ALL SELECT 'blood_pressure', count(date), min(date), max(date) FROM pressure""",
)
def dataset_summary(f: Frames) -> DataFrame:
    return status(f.order_frames)


@query(
    "quality_gate",
    'profile_id, check, value:6, ok',
    """SELECT profile_id, "check", value, CASE WHEN "check" = 'rows' THEN value >= 60 ELSE value <= 0.30e0 END AS ok
       FROM (SELECT profile_id, unnest(['rows', 'null_rate:resting_hr', 'null_rate:sleep_seconds', 'null_rate:steps']) AS "check",
               unnest([CAST(count(*) AS DOUBLE), 1 - count(resting_hr) / count(*), 1 - count(sleep_seconds) / count(*), 1 - count(steps) / count(*)]) AS value
             FROM daily GROUP BY profile_id)""",
)
def quality_gate(f: Frames) -> DataFrame:
    return C.quality_gate(f.daily, BY)


@query(
    "sparse_columns",
    "feature, null_rate:6, kept",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS null_rate, 1 - count({c}) / count(*) <= 0.2e0 AS kept FROM daily"
        for c in ("resting_hr", "sleep_score", "hrv_last_night", "hrv_status", "body_battery_start")
    ),
)
def sparse_columns(f: Frames) -> DataFrame:
    cols = ["resting_hr", "sleep_score", "hrv_last_night", "hrv_status", "body_battery_start"]
    rates = C.null_rates(f.daily, cols)
    rate = F.col("value") / F.col("rows")
    return A.melt(rates, ["rows"], cols).select("feature", rate.alias("null_rate"), (rate <= 0.2).alias("kept"))


@query(
    "ingest_range",
    "iso_week, n:i",
    """SELECT printf('%04d-W%02d', CAST(isoyear(date) AS INT), CAST(week(date) AS INT)) AS iso_week, count(*) AS n FROM acts
       WHERE date BETWEEN DATE '1996-12-20' AND DATE '1999-01-10' GROUP BY 1""",
)
def ingest_range(f: Frames) -> DataFrame:
    kept, _ = C.ingest_range(f.acts, "date", "1996-12-20", "1999-01-10", BY)
    return kept.groupBy("iso_week").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_rejects",
    "profile_id, considered:i, unparseable:i, out_of_range:i",
    """SELECT profile_id, count(*) AS considered, count(*) FILTER (d IS NULL) AS unparseable,
         count(*) FILTER (d < DATE '1996-12-20' OR d > DATE '1999-01-10') AS out_of_range
       FROM (SELECT profile_id, CASE WHEN activity_id % 13 <> 0 THEN date END AS d FROM acts) GROUP BY 1""",
)
def ingest_rejects(f: Frames) -> DataFrame:
    text = F.when(F.col("activity_id") % 13 == 0, F.lit("not a date")).otherwise(F.col("date").cast("string"))
    acts = f.acts.withColumn("d", text.try_cast("date"))
    return C.ingest_range(acts, "d", "1996-12-20", "1999-01-10", BY)[1]


@query(
    "date_range_filter",
    "profile_id, activity_id:i, date:d",
    "SELECT profile_id, activity_id, date FROM run_like WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'",
)
def date_range_filter(f: Frames) -> DataFrame:
    return C.filter_dates(f.acts.where(S.type_in(S.RUNNING_TYPES)), "date", "1997-03-01", "1997-06-30")


@query(
    "derived_daily",
    "profile_id, date:d, sleep_hours:6, body_battery_delta:6, steps:2",
    "SELECT profile_id, date, sleep_seconds / 3600 AS sleep_hours, body_battery_end - body_battery_start AS body_battery_delta, steps FROM daily",
)
def derived_daily(f: Frames) -> DataFrame:
    return C.derive_daily(f.daily)


@query(
    "plausible_runs",
    "activity_id:i, distance_m:3, duration_sec:3",
    "SELECT * FROM runs WHERE distance_m >= 4000 AND duration_sec >= 2400 AND start_lat IS NOT NULL AND start_lon IS NOT NULL",
)
def plausible_runs(f: Frames) -> DataFrame:
    return C.plausible_runs(f.runs, min_distance_m=4000, min_duration_s=2400, need_start=True)


@query(
    "splits_fallback",
    "activity_id:i, split_number:i, split_type, distance_m:2, duration_sec:2",
    """SELECT * FROM (SELECT *, bool_or(split_type = 'INTERVAL') OVER (PARTITION BY activity_id) AS any_interval FROM splits)
       WHERE (NOT any_interval OR split_type = 'INTERVAL') AND distance_m >= 100""",
)
def splits_fallback(f: Frames) -> DataFrame:
    return C.prefer_rows(f.splits, ["activity_id"], F.col("split_type") == "INTERVAL").where(F.col("distance_m") >= 100)


# ------------------------------------------------------------- scalar functions
@query(
    "cyclical_weekday",
    "o_orderkey:i, day_sin:6, day_cos:6, week_start:d",
    """SELECT o_orderkey, sin(isodow(o_orderdate) * 2 * pi() / 7) AS day_sin, cos(isodow(o_orderdate) * 2 * pi() / 7) AS day_cos,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders""",
)
def cyclical_weekday(f: Frames) -> DataFrame:
    return f.table("orders").select(
        "o_orderkey",
        S.weekday_sin("o_orderdate").alias("day_sin"),
        S.weekday_cos("o_orderdate").alias("day_cos"),
        S.week_start("o_orderdate").alias("week_start"),
    )


@query(
    "calendar_labels",
    "o_orderkey:i, iso_week, month, last_day:d, week_before:d, age_days:i",
    """SELECT o_orderkey, printf('%04d-W%02d', CAST(isoyear(o_orderdate) AS INT), CAST(week(o_orderdate) AS INT)) AS iso_week,
         strftime(o_orderdate, '%Y-%m') AS month, last_day(o_orderdate) AS last_day, CAST(o_orderdate AS DATE) - 7 AS week_before,
         DATE '2001-12-31' - CAST(o_orderdate AS DATE) AS age_days FROM orders""",
)
def calendar_labels(f: Frames) -> DataFrame:
    d = F.to_date("o_orderdate")
    return f.table("orders").select(
        "o_orderkey",
        S.iso_week_label(d).alias("iso_week"),
        S.month_label(d).alias("month"),
        S.month_end(d).alias("last_day"),
        F.date_sub(d, 7).alias("week_before"),
        F.datediff(F.lit("2001-12-31").cast("date"), d).alias("age_days"),
    )


@query(
    "month_series",
    "o_custkey:i, month:d, orders:i",
    """SELECT o_custkey, CAST(m AS DATE) AS month, count(*) AS orders
       FROM (SELECT o_custkey, unnest(generate_series(date_trunc('month', min(CAST(o_orderdate AS DATE))), max(CAST(o_orderdate AS DATE)), INTERVAL 1 MONTH)) AS m, 1 FROM orders GROUP BY o_custkey)
       GROUP BY 1, 2""",
)
def month_series(f: Frames) -> DataFrame:
    spans = f.table("orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("frm"), F.max(F.to_date("o_orderdate")).alias("to")
    )
    months = spans.select("o_custkey", F.explode(S.months_between_inclusive(F.col("frm"), F.col("to"))).alias("month"))
    return months.groupBy("o_custkey", "month").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "epoch_conversions",
    "event_id:i, iso_text, day:d",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso_text, CAST(ts AS DATE) AS day FROM events",
)
def epoch_conversions(f: Frames) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return f.table("events").select(
        "event_id", S.epoch_ms_text(F.floor(micros / 1000)).alias("iso_text"), S.epoch_us_date(micros).alias("day")
    )


@query(
    "pace_texts",
    "o_orderkey:i, pace, delta, clock, speed_pace, span",
    """SELECT o_orderkey,
         CAST(p // 60 AS STRING) || ':' || lpad(CAST(p % 60 AS STRING), 2, '0') AS pace,
         CASE WHEN dv < 0 AND da <> 0 THEN '-' ELSE '' END || CAST(da // 60 AS STRING) || ':' || lpad(CAST(da % 60 AS STRING), 2, '0') AS delta,
         CASE WHEN t >= 3600 THEN CAST(t // 3600 AS STRING) || ':' || lpad(CAST(t % 3600 // 60 AS STRING), 2, '0') ELSE CAST(t // 60 AS STRING) END
           || ':' || lpad(CAST(t % 60 AS STRING), 2, '0') AS clock,
         CASE WHEN v > 0 THEN CAST(sp // 60 AS STRING) || ':' || lpad(CAST(sp % 60 AS STRING), 2, '0') ELSE '---' END AS speed_pace,
         CASE WHEN t >= 3600 THEN CAST(t // 3600 AS STRING) || 'h' || lpad(CAST(t % 3600 // 60 AS STRING), 2, '0') || 'm'
              WHEN t >= 60 THEN CAST(t // 60 AS STRING) || 'm' || lpad(CAST(t % 60 AS STRING), 2, '0') || 's' ELSE CAST(t AS STRING) || 's' END AS span
       FROM (SELECT o_orderkey, CAST(round(o_totalprice / 1000 + 0.0001) AS BIGINT) AS p, CAST(o_orderkey % 500 - 250 AS DOUBLE) / 100 AS dv,
               CAST(round(abs(CAST(o_orderkey % 500 - 250 AS DOUBLE) / 100 )) AS BIGINT) AS da, o_orderkey % 9000 AS t,
               CAST(o_orderkey % 50 AS DOUBLE) / 10 AS v,
               CASE WHEN o_orderkey % 50 > 0 THEN CAST(round(1000 / (CAST(o_orderkey % 50 AS DOUBLE) / 10)) AS BIGINT) END AS sp FROM orders)""",
)
def pace_texts(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    seconds = k % 9000
    return f.table("orders").select(
        "o_orderkey",
        S.fmt_pace(F.col("o_totalprice") / 1000 + 0.0001).alias("pace"),
        S.fmt_pace((k % 500 - 250).cast("double") / 100).alias("delta"),
        S.fmt_time(seconds).alias("clock"),
        S.fmt_speed_pace((k % 50).cast("double") / 10).alias("speed_pace"),
        S.fmt_secs(seconds).alias("span"),
    )


@query(
    "grade_cost",
    "l_orderkey:i, l_linenumber:i, l_extendedprice:2, cost:6, gap:6, ce:6",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, cost, v * greatest(cost, 1) / 3.6e0 AS gap,
         coalesce(v * greatest(cost, 1) / 3.6e0 / hr + 0.000111e0 * (t - 20), v * greatest(cost, 1) / 3.6e0 / hr) AS ce
       FROM (SELECT *, 155.4e0 * pow(g, 5) - 30.4e0 * pow(g, 4) - 43.3e0 * pow(g, 3) + 46.3e0 * pow(g, 2) + 19.5e0 * g + 3.6e0 AS cost
         FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, greatest(-0.45e0, least(0.45e0, (l_quantity - 25) / 50)) AS g,
                 1 + l_quantity / 20 AS v, 100 + l_quantity AS hr, CASE WHEN l_linenumber <> 3 THEN l_tax * 400 END AS t FROM lineitem))""",
)
def grade_cost(f: Frames) -> DataFrame:
    g = (F.col("l_quantity") - 25) / 50
    v, hr = F.lit(1.0) + F.col("l_quantity") / 20, F.lit(100.0) + F.col("l_quantity")
    t = F.when(F.col("l_linenumber") != 3, F.col("l_tax") * 400)
    gap = S.gap_speed(v, g)
    return f.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        S.minetti_cost(g).alias("cost"),
        gap.alias("gap"),
        S.adjusted_ce(gap, hr, t).alias("ce"),
    )


@query(
    "label_rules",
    "o_orderkey:i, acwr, regime, drift, trend, versus, z:6, status, score:6, ready, advice, bar:i",
    """SELECT o_orderkey,
         CASE WHEN r > 1.5e0 THEN 'injury risk' WHEN r > 1.3e0 THEN 'building aggressively' WHEN r > 1 THEN 'building fitness' WHEN r >= 0.8e0 THEN 'maintaining'
              WHEN r >= 0.6e0 THEN 'losing fitness' ELSE 'detraining rapidly' END AS acwr,
         CASE WHEN r < 0.8e0 THEN 'detraining' WHEN r > 1.3e0 THEN 'overtraining' WHEN r > 1.1e0 THEN 'safe_high' WHEN r < 0.9e0 THEN 'safe_low' ELSE 'safe' END AS regime,
         CASE WHEN d < 5 THEN 'strong' WHEN d <= 10 THEN 'normal' ELSE 'needs work' END AS drift,
         CASE WHEN tr > 0.0001e0 THEN 'improving' WHEN tr < -0.0001e0 THEN 'declining' ELSE 'stable' END AS trend,
         CASE WHEN d - 8 > 0.5e0 THEN 'better' WHEN d - 8 < -0.5e0 THEN 'worse' ELSE 'similar' END AS versus,
         z, CASE WHEN z > 0.5e0 THEN 'above avg' WHEN z < -0.5e0 THEN 'below avg' ELSE 'average' END AS status,
         score, CASE WHEN score >= 7 THEN 'ready to push' WHEN score >= 4 THEN 'normal day' ELSE 'recovery day' END AS ready,
         CASE WHEN score >= 7 AND off >= 2 THEN 'hard_or_long' WHEN score >= 7 THEN 'steady' WHEN score >= 4 AND off >= 1 THEN 'easy_to_moderate'
              WHEN score >= 4 THEN 'easy' WHEN off = 0 THEN 'rest_tomorrow' ELSE 'rest_or_short_easy' END AS advice,
         CASE WHEN o_orderkey % 10 = 0 THEN 10 ELSE CAST(round(20 * d / 16) AS INT) END AS bar
       FROM (SELECT *, greatest(1, least(10, (z + 2) / 4 * 9 + 1)) AS score
         FROM (SELECT o_orderkey, CAST(o_orderkey % 200 AS DOUBLE) / 100 AS r, CAST(o_orderkey % 16 AS DOUBLE) AS d, (o_orderkey % 5 - 2) * 0.00009e0 AS tr,
                 CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE -((o_orderkey % 60) - 30) / CAST(10 * (o_orderkey % 7) AS DOUBLE) END AS z, o_orderkey % 4 AS off FROM orders))""",
)
def label_rules(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    r, d = (k % 200).cast("double") / 100, (k % 16).cast("double")
    z = S.zscore((k % 60).cast("double"), F.lit(30.0), (10 * (k % 7)).cast("double"), -1.0)
    score = S.readiness_score(F.col("z"))
    flat = k % 10 == 0
    return (
        f.table("orders")
        .withColumn("z", z)
        .select(
            "o_orderkey",
            S.acwr_label(r).alias("acwr"),
            S.acwr_regime(r).alias("regime"),
            S.drift_label(d).alias("drift"),
            S.trend_label((k % 5 - 2) * F.lit(0.00009)).alias("trend"),
            S.versus_label(d - 8).alias("versus"),
            "z",
            S.z_status(F.col("z")).alias("status"),
            score.alias("score"),
            S.readiness_label(score).alias("ready"),
            S.recommendation(score, k % 4).alias("advice"),
            S.scale_0_20(d, F.lit(0.0), F.when(flat, F.lit(0.0)).otherwise(F.lit(16.0))).alias("bar"),
        )
    )


@query(
    "recap_notes",
    "activity_id:i, efficiency_above, efficiency_below, efficiency_in_line, low_drift, high_drift, te_high, te_low",
    """SELECT activity_id, p > 2 AS efficiency_above, p < -2 AS efficiency_below, p BETWEEN -2 AND 2 AS efficiency_in_line,
         coalesce(d < 3, false) AS low_drift, coalesce(d > 10, false) AS high_drift,
         coalesce(training_effect >= 4, false) AS te_high, coalesce(training_effect < 2, false) AS te_low
       FROM (SELECT activity_id, training_effect, activity_id % 9 - 4 AS p, CASE WHEN activity_id % 4 > 0 THEN activity_id % 14 END AS d FROM acts)""",
)
def recap_notes(f: Frames) -> DataFrame:
    k = F.col("activity_id")
    flags = S.note_flags(k % 9 - 4, F.when(k % 4 > 0, k % 14), F.col("training_effect"))
    return f.acts.select("activity_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "text_rules",
    "activity_id:i, short_name, stripped, place, malformed, is_race",
    """SELECT activity_id, CASE WHEN length(activity_name) > 50 THEN substring(activity_name, 1, 49) || '…' ELSE activity_name END AS short_name,
         regexp_replace(activity_name, '^Activity ', '') AS stripped,
         CASE activity_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'Place' END AS place,
         NOT json_valid(raw_json) AS malformed, coalesce(CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.eventType.typeKey' END = 'race', false) AS is_race
       FROM acts""",
)
def text_rules(f: Frames) -> DataFrame:
    k = F.col("activity_id") % 4
    place = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("null")).when(k == 2, F.lit('""')).otherwise(F.lit('"Place"'))
    return f.acts.select(
        "activity_id",
        S.ellipsis("activity_name", 50).alias("short_name"),
        S.strip_prefix("activity_name", "Activity ").alias("stripped"),
        S.clean_place(place).alias("place"),
        S.json_malformed("raw_json").alias("malformed"),
        S.json_is("raw_json", "$.eventType.typeKey", "race").alias("is_race"),
    )


@query(
    "json_flag",
    "event_type, k_even, n:i",
    "SELECT event_type, CAST(props ->> '$.k' AS INT) % 2 = 0 AS k_even, count(*) AS n FROM events GROUP BY 1, 2",
)
def json_flag(f: Frames) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return f.table("events").groupBy("event_type", (k % 2 == 0).alias("k_even")).agg(F.count(F.lit(1)).alias("n"))
