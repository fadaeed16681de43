"""Per-sample series, efficiency, drift, week plan, routes, readiness and recap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import geo
from ..operators import steady as ST
from ..operators.joins import place_names
from ..plans import fitness, readiness, recap, routes
from .frames import BY, Frames
from .registry import query

TODAY = "2001-07-01"
RUN_ORDER = "date, start_time_local, activity_id"


def today():
    return F.lit(TODAY).cast("date")


# ------------------------------------------------------------- steady samples
@query("steady_rows", "activity_id:i, row_pos:i, gap_speed:6, heart_rate:i", "SELECT m.* FROM marked m WHERE steady AND activity_id IN (SELECT activity_id FROM ce)")
def steady_rows(f: Frames) -> DataFrame:
    return ST.steady_rows(f.samples)


@query(
    "lag_delta_grade",
    "activity_id:i, steady:i, raw:i, mean_gap:6",
    "SELECT activity_id, count(*) FILTER (steady) AS steady, count(*) AS raw, avg(gap_speed) AS mean_gap FROM marked GROUP BY 1",
)
def lag_delta_grade(f: Frames) -> DataFrame:
    return ST.mark_steady(f.samples).groupBy("activity_id").agg(
        F.count_if("steady").alias("steady"), F.count(F.lit(1)).alias("raw"), F.avg("gap_speed").alias("mean_gap")
    )


@query(
    "run_ce",
    "activity_id:i, raw_rows:i, seconds_used:i, gap_speed:6, avg_hr:6, avg_temp:6, avg_cadence:6, avg_gct:6, avg_stride:6, hr_cv:6, first_elapsed:1, last_elapsed:1, ce_raw:8, ce:8",
    "SELECT * FROM ce",
)
def run_ce(f: Frames) -> DataFrame:
    return ST.run_ce(ST.mark_steady(f.samples))


@query(
    "run_drift",
    "activity_id:i, skip_reason, decoupling_pct:6, hr_drift_pct:6, hr_h1:6, hr_h2:6, n_first:i, n_second:i",
    "SELECT * FROM drift",
)
def run_drift(f: Frames) -> DataFrame:
    return ST.drift_from_details(f.samples)


# -------------------------------------------------------------- fitness report
@query(
    "efficiency_runs",
    "profile_id, activity_id:i, date:d, distance_km:4, duration_min:4, ce:8, hr_cv:6",
    "SELECT * FROM eff",
)
def efficiency_runs(f: Frames) -> DataFrame:
    return fitness.efficiency_runs(f.run_frames)


@query(
    "fitness_state",
    "profile_id, anchor:d, runs:i, current_ce:8, percentile:i, ce_28d:8, ce_prev_28d:8, trend:8, trend_label, peak_ce:8, peak_date:d",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY {RUN_ORDER}) AS i, row_number() OVER (PARTITION BY profile_id ORDER BY date DESC, start_time_local DESC, activity_id DESC) AS back,
             max(date) OVER (PARTITION BY profile_id) AS anchor FROM eff),
         r AS (SELECT *, CASE WHEN i >= 10 THEN avg(ce) OVER (PARTITION BY profile_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS a10 FROM o),
         s AS (SELECT profile_id, max(anchor) AS anchor, count(*) AS runs, avg(ce) FILTER (back <= 10) AS current_ce, avg(ce) FILTER (anchor - date < 28) AS ce_28d,
             avg(ce) FILTER (anchor - date >= 28 AND anchor - date < 56) AS ce_prev_28d, coalesce(max(a10), 0) AS peak_ce,
             coalesce(arg_max(date, (a10, -i)) FILTER (a10 IS NOT NULL), min(date)) AS peak_date FROM r GROUP BY 1)
       SELECT s.*, ce_28d - ce_prev_28d AS trend, CASE WHEN ce_28d - ce_prev_28d > 0.0001e0 THEN 'improving' WHEN ce_28d - ce_prev_28d < -0.0001e0 THEN 'declining'
                WHEN ce_28d - ce_prev_28d IS NOT NULL THEN 'stable' END AS trend_label,
         (SELECT round(100 * avg(CASE WHEN e.ce < s.current_ce THEN 1e0 ELSE 0e0 END)) FROM eff e WHERE e.profile_id = s.profile_id) AS percentile
       FROM s""",
)
def fitness_state(f: Frames) -> DataFrame:
    return fitness.current_state(fitness.efficiency_runs(f.run_frames))


@query(
    "recent_runs",
    "profile_id, activity_id:i, date:d, ce:8, marker, gap_pace",
    """SELECT profile_id, activity_id, date, ce, CASE WHEN ce - m >= -1e-12 THEN 'above' WHEN ce >= m - 0.0015e0 THEN 'slightly below' ELSE 'below' END AS marker,
         CAST(sp // 60 AS STRING) || ':' || lpad(CAST(sp % 60 AS STRING), 2, '0') AS gap_pace
       FROM (SELECT *, avg(ce) OVER (PARTITION BY profile_id) AS m, CAST(round(1000 / gap_speed) AS BIGINT) AS sp,
               row_number() OVER (PARTITION BY profile_id ORDER BY date DESC, start_time_local DESC, activity_id DESC) AS back FROM eff) WHERE back <= 10""",
)
def recent_runs(f: Frames) -> DataFrame:
    return fitness.recent_runs(fitness.efficiency_runs(f.run_frames), BY)


@query(
    "monthly_trend",
    "profile_id, month:d, ce:8, runs:i, bar:i",
    """SELECT *, CASE WHEN hi - lo < 1e-9 THEN 10 ELSE round((ce - lo) / (hi - lo) * 20) END AS bar
       FROM (SELECT *, min(ce) OVER (PARTITION BY profile_id) AS lo, max(ce) OVER (PARTITION BY profile_id) AS hi
         FROM (SELECT profile_id, CAST(date_trunc('month', date) AS DATE) AS month, avg(ce) AS ce, count(*) AS runs
               FROM (SELECT *, max(date) OVER (PARTITION BY profile_id) AS anchor FROM eff) WHERE anchor - date < 365 GROUP BY 1, 2))""",
)
def monthly_trend(f: Frames) -> DataFrame:
    return fitness.monthly_trend(fitness.efficiency_runs(f.run_frames), BY)


@query(
    "ce_drivers",
    "profile_id, driver, n:i, r:6",
    " UNION ALL ".join(
        f"""SELECT profile_id, '{n}' AS driver, count({c}) AS n, CASE WHEN var_pop(ce) FILTER ({c} IS NOT NULL) * var_pop({c}) > 0 THEN coalesce(covar_pop(ce, {c}) / sqrt(var_pop(ce) FILTER ({c} IS NOT NULL) * var_pop({c})), 0) ELSE 0 END AS r
            FROM eff GROUP BY 1 HAVING count({c}) > 20"""
        for n, c in fitness.DRIVERS
    ),
)
def ce_drivers(f: Frames) -> DataFrame:
    return fitness.ce_drivers(fitness.efficiency_runs(f.run_frames), BY)


VOLUMES_SQL = """
  SELECT v.*, CASE WHEN vol_prev_28d > 0 THEN vol_28d / vol_prev_28d END AS load_ratio,
    (SELECT 100 * avg(CASE WHEN km < v.vol_28d * 30 / 28 THEN 1e0 ELSE 0e0 END)
     FROM (SELECT profile_id, date_trunc('month', date), sum(distance_km) AS km FROM {src} GROUP BY 1, 2) m WHERE m.profile_id = v.profile_id) AS vol_pct
  FROM (SELECT profile_id, coalesce(sum(distance_km) FILTER (age < 28), 0) AS vol_28d, count(*) FILTER (age < 28) / 4 AS runs_per_week,
          coalesce(max(distance_km) FILTER (age < 28), 0) AS long_run_28d, coalesce(sum(distance_km) FILTER (age >= 28 AND age < 56), 0) AS vol_prev_28d,
          coalesce(sum(distance_km) FILTER (age < 90), 0) AS vol_90d, count(*) FILTER (age < 28) AS runs_28d
        FROM (SELECT *, max(date) OVER (PARTITION BY profile_id) - date AS age FROM {src}) GROUP BY 1) v"""
_ACWR = """CASE WHEN load_ratio > 1.5e0 THEN 'injury risk' WHEN load_ratio > 1.3e0 THEN 'building aggressively' WHEN load_ratio > 1 THEN 'building fitness'
  WHEN load_ratio >= 0.8e0 THEN 'maintaining' WHEN load_ratio >= 0.6e0 THEN 'losing fitness' WHEN load_ratio IS NOT NULL THEN 'detraining rapidly' END"""
VOLUME_COLUMNS = "profile_id, vol_28d:4, runs_28d:i, runs_per_week:4, long_run_28d:4, vol_prev_28d:4, vol_90d:4, vol_pct:6, load_ratio:6, load_label"


@query("trailing_volumes", VOLUME_COLUMNS, f"SELECT *, {_ACWR} AS load_label FROM ({VOLUMES_SQL.format(src='eff')})")
def trailing_volumes(f: Frames) -> DataFrame:
    return fitness.volumes(fitness.efficiency_runs(f.run_frames), BY)


def dense_runs(f: Frames) -> DataFrame:
    """Orders as runs: many per nation and month, so that plans have volume on both sides."""
    return fitness.running(f.acts).select(
        "profile_id",
        "activity_id",
        "date",
        "start_time_local",
        (F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0).alias("distance_km"),
        (F.col("training_load") / 100 + 1).alias("gap_speed"),
        (F.col("training_load") / 10000 + 0.01).alias("ce"),
        F.col("avg_hr").cast("double").alias("avg_hr"),
    )


DENSE = """(SELECT profile_id, activity_id, date, start_time_local, coalesce(distance_m, 0) / 1000 AS distance_km, training_load / 100 + 1 AS gap_speed,
  training_load / 10000 + 0.01e0 AS ce, avg_hr FROM run_like)"""


@query("acwr", VOLUME_COLUMNS, f"SELECT *, {_ACWR} AS load_label FROM ({VOLUMES_SQL.format(src=DENSE)})")
def acwr(f: Frames) -> DataFrame:
    return fitness.volumes(dense_runs(f), BY)


@query(
    "rolling10_peak",
    "profile_id, peak_ce:8, peak_date:d",
    f"""SELECT profile_id, coalesce(max(a10), 0) AS peak_ce, coalesce(arg_max(date, (a10, -i)) FILTER (a10 IS NOT NULL), min(date)) AS peak_date
        FROM (SELECT *, CASE WHEN i >= 10 THEN round(avg(ce) OVER (PARTITION BY profile_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 12) END AS a10
          FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY {RUN_ORDER}) AS i FROM {DENSE})) GROUP BY 1""",
)
def rolling10_peak(f: Frames) -> DataFrame:
    return fitness.rolling_peak(dense_runs(f), BY)


@query(
    "weekly_history",
    "profile_id, week_back:i, km:4",
    f"""SELECT g.profile_id, g.w AS week_back, coalesce(km, 0) AS km
        FROM (SELECT DISTINCT profile_id, unnest(range(1, 9)) AS w FROM run_like) g
        LEFT JOIN (SELECT profile_id, (date_trunc('week', DATE '{TODAY}')::DATE - date_trunc('week', date)::DATE) // 7 AS w, sum(distance_km) AS km FROM {DENSE} GROUP BY 1, 2) s
          ON g.profile_id = s.profile_id AND g.w = s.w""",
)
def weekly_history(f: Frames) -> DataFrame:
    return A.weekly_history(dense_runs(f), BY, today())


@query(
    "recovery_means",
    "profile_id, recovery_rhr:6, recovery_hrv:6, recovery_sleep_hours:6, recovery_stress:6",
    f"""SELECT profile_id, avg(resting_hr) AS recovery_rhr, avg(hrv_last_night) AS recovery_hrv, avg(sleep_seconds) / 3600 AS recovery_sleep_hours, avg(avg_stress) AS recovery_stress
        FROM daily WHERE date >= DATE '{TODAY}' - 7 AND date <= DATE '{TODAY}' GROUP BY 1""",
)
def recovery_means(f: Frames) -> DataFrame:
    return A.recovery_means(f.daily, BY, today())


PLAN_COLUMNS = (
    "profile_id, regime, load_ratio:6, typical_easy:4, days_left:i, km_this_week:4, runs_this_week:i, avg_weekly_km:6, recent_max_km:4, target_vol:6, vol_gap:6, safe_cap:6, "
    "remaining_budget:6, already_above_avg, recovery_favorable, near_cap, n_easy_a:i, week_km_a:6, ratio_a:6, long_target_b:2, n_easy_b:i, week_km_b:6, ratio_b:6, needs_quality, "
    "multi_week, excess_km:6, reduced_run_km:2, reduced_runs:i, maintain_km:6"
)


@query(
    "week_plan",
    PLAN_COLUMNS,
    f"""WITH d AS (SELECT *, max(date) OVER (PARTITION BY profile_id) - date AS age FROM {DENSE} WHERE date <= DATE '{TODAY}'),
      v AS ({VOLUMES_SQL.format(src=f"(SELECT * FROM {DENSE} WHERE date <= DATE '{TODAY}')")}),
      wk AS (SELECT profile_id, coalesce(sum(distance_km) FILTER (date >= date_trunc('week', DATE '{TODAY}')), 0) AS km_this_week, count(*) FILTER (date >= date_trunc('week', DATE '{TODAY}')) AS runs_this_week FROM d GROUP BY 1),
      easy AS (SELECT profile_id, l[len(l) // 2 + 1] AS typical_easy FROM (SELECT profile_id, list(distance_km ORDER BY distance_km) AS l FROM d WHERE age < 90 GROUP BY 1)),
      hist AS (SELECT profile_id, avg(km) AS avg_weekly_km, max(km) FILTER (w <= 4) AS recent_max_km FROM (
          SELECT g.profile_id, g.w, coalesce(km, 0) AS km FROM (SELECT DISTINCT profile_id, unnest(range(1, 9)) AS w FROM d) g
          LEFT JOIN (SELECT profile_id, (date_trunc('week', DATE '{TODAY}')::DATE - date_trunc('week', date)::DATE) // 7 AS w, sum(distance_km) AS km FROM d GROUP BY 1, 2) s ON g.profile_id = s.profile_id AND g.w = s.w) GROUP BY 1),
      q AS (SELECT profile_id, max(gap_speed) > avg(gap_speed) * 1.08e0 AS has_quality FROM d WHERE age < 28 GROUP BY 1),
      rec AS (SELECT profile_id, avg(hrv_last_night) AS hrv, avg(sleep_seconds) / 3600 AS sleep, avg(avg_stress) AS stress FROM daily WHERE date >= DATE '{TODAY}' - 7 AND date <= DATE '{TODAY}' GROUP BY 1),
      b AS (SELECT v.*, km_this_week, runs_this_week, typical_easy, avg_weekly_km, recent_max_km, has_quality, 7 - isodow(DATE '{TODAY}') AS days_left,
          CASE WHEN load_ratio < 0.8e0 THEN 'detraining' WHEN load_ratio > 1.3e0 THEN 'overtraining' WHEN load_ratio > 1.1e0 THEN 'safe_high' WHEN load_ratio < 0.9e0 THEN 'safe_low' ELSE 'safe' END AS regime,
          0.85e0 * vol_prev_28d AS target_vol, greatest(0.85e0 * vol_prev_28d - vol_28d, 0) AS vol_gap, recent_max_km * 1.1e0 AS safe_cap,
          greatest(recent_max_km * 1.1e0 - km_this_week, 0) AS remaining_budget, km_this_week > avg_weekly_km * 1.05e0 AS already_above_avg,
          coalesce(stress < 35, true) AND coalesce(hrv > 20, true) AND coalesce(sleep > 7, true) AS recovery_favorable
        FROM v JOIN wk USING (profile_id) JOIN easy USING (profile_id) JOIN hist USING (profile_id) LEFT JOIN q USING (profile_id) LEFT JOIN rec USING (profile_id) WHERE vol_prev_28d > 0),
      c AS (SELECT *, regime = 'detraining' AND remaining_budget >= typical_easy * 0.5e0 AS room,
          greatest(least(floor(remaining_budget / typical_easy), (days_left + 1) // 2), 1) AS ea,
          CASE WHEN long_run_28d > typical_easy * 1.2e0 THEN round(long_run_28d * 1.1e0) ELSE round(typical_easy * 1.5e0) END AS lt FROM b),
      e AS (SELECT *, room AND days_left >= 3 AND lt <= remaining_budget AS bb, least(floor((remaining_budget - lt) / typical_easy), greatest(days_left - 1, 0)) AS eb FROM c)
      SELECT *, regime = 'detraining' AND remaining_budget < typical_easy * 0.5e0 AS near_cap,
        CASE WHEN room THEN ea END AS n_easy_a, CASE WHEN room THEN km_this_week + typical_easy * ea END AS week_km_a, CASE WHEN room THEN (vol_28d + typical_easy * ea) / vol_prev_28d END AS ratio_a,
        CASE WHEN bb THEN lt END AS long_target_b, CASE WHEN bb THEN eb END AS n_easy_b, CASE WHEN bb THEN km_this_week + typical_easy * eb + lt END AS week_km_b,
        CASE WHEN bb THEN (vol_28d + typical_easy * eb + lt) / vol_prev_28d END AS ratio_b,
        regime = 'detraining' AND NOT coalesce(has_quality, false) AS needs_quality,
        regime = 'detraining' AND NOT already_above_avg AND (vol_28d + least(remaining_budget, typical_easy * 3)) / vol_prev_28d < 0.8e0 AS multi_week,
        CASE WHEN regime = 'overtraining' THEN greatest(vol_28d - 1.2e0 * vol_prev_28d, 0) END AS excess_km,
        CASE WHEN regime = 'overtraining' THEN greatest(round(typical_easy * 0.7e0), 3) END AS reduced_run_km,
        CASE WHEN regime = 'overtraining' THEN round(greatest(runs_per_week - 1, 2)) END AS reduced_runs,
        CASE WHEN regime LIKE 'safe%' THEN vol_28d / 4 END AS maintain_km
      FROM e""",
)
def week_plan(f: Frames) -> DataFrame:
    return fitness.week_plan(dense_runs(f), BY, today(), A.recovery_means(f.daily, BY, today()))


# ----------------------------------------------------------------------- drift
@query(
    "drift_runs",
    "profile_id, activity_id:i, date:d, distance_km:4, skip_reason, decoupling_pct:6, hr_drift_pct:6, label",
    "SELECT *, CASE WHEN decoupling_pct < 5 THEN 'strong' WHEN decoupling_pct <= 10 THEN 'normal' WHEN decoupling_pct IS NOT NULL THEN 'needs work' END AS label FROM drifted",
)
def drift_runs(f: Frames) -> DataFrame:
    return fitness.drift_runs(f.run_frames)


@query(
    "drift_skipped", "profile_id, skip_reason, n:i", "SELECT profile_id, skip_reason, count(*) AS n FROM drifted WHERE skip_reason IS NOT NULL GROUP BY 1, 2"
)
def drift_skipped(f: Frames) -> DataFrame:
    return fitness.drift_report(f.run_frames)["skipped"]


@query(
    "drift_overall",
    "profile_id, n:i, mean_decoupling:6, median_decoupling:6",
    """SELECT profile_id, len(l) AS n, m AS mean_decoupling, l[len(l) // 2 + 1] AS median_decoupling
       FROM (SELECT profile_id, list(decoupling_pct ORDER BY decoupling_pct) AS l, avg(decoupling_pct) AS m FROM dr GROUP BY 1)""",
)
def drift_overall(f: Frames) -> DataFrame:
    return fitness.drift_report(f.run_frames)["overall"]


def regional(f: Frames) -> dict[str, DataFrame]:
    """The run frames with five coarser entities, each with enough runs for bands."""
    return {**f.run_frames, "activities": f.runs.withColumn("profile_id", F.col("profile_id") % 5)}


@query(
    "drift_bands",
    "profile_id:i, band, n:i, decoupling_pct:6, hr_drift_pct:6",
    """SELECT profile_id % 5 AS profile_id, CASE WHEN distance_km < 8 THEN '5-8' WHEN distance_km < 12 THEN '8-12' WHEN distance_km < 18 THEN '12-18' WHEN distance_km < 30 THEN '18-30' ELSE '30+' END AS band,
         count(*) AS n, avg(decoupling_pct) AS decoupling_pct, avg(hr_drift_pct) AS hr_drift_pct FROM dr WHERE distance_km < 100 GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def drift_bands(f: Frames) -> DataFrame:
    return fitness.drift_report(regional(f))["by_distance"]


@query(
    "drift_temperature",
    "profile_id:i, band, n:i, decoupling_pct:6",
    """SELECT e AS profile_id, CASE WHEN avg_temp < 18 THEN 'cool' WHEN avg_temp < 24 THEN 'mild' WHEN avg_temp < 30 THEN 'warm' ELSE 'hot' END AS band, count(*) AS n, avg(decoupling_pct) AS decoupling_pct
       FROM (SELECT *, profile_id % 5 AS e, count(avg_temp) OVER (PARTITION BY profile_id % 5) AS nt FROM dr) WHERE nt > 20 AND avg_temp >= 0 AND avg_temp < 50 GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def drift_temperature(f: Frames) -> DataFrame:
    return fitness.drift_report(regional(f))["by_temperature"]


@query(
    "drift_yearly",
    "profile_id, year:i, n:i, decoupling_pct:6, bar:i",
    """SELECT profile_id, year(date) AS year, count(*) AS n, avg(decoupling_pct) AS decoupling_pct, round(greatest(0, least(15, avg(decoupling_pct))) / 15 * 20) AS bar FROM dr GROUP BY 1, 2""",
)
def drift_yearly(f: Frames) -> DataFrame:
    return fitness.drift_report(f.run_frames)["yearly"]


@query(
    "drift_recent",
    "profile_id, recent_decoupling:6, level",
    """SELECT profile_id, avg(decoupling_pct) AS recent_decoupling, CASE WHEN avg(decoupling_pct) < 5 THEN 'solid' WHEN avg(decoupling_pct) < 10 THEN 'normal' ELSE 'elevated' END AS level
       FROM (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY date DESC, start_time_local DESC, activity_id DESC) <= 10) GROUP BY 1""",
)
def drift_recent(f: Frames) -> DataFrame:
    return fitness.drift_report(f.run_frames)["recent_level"]


# ---------------------------------------------------------------------- routes
_HAVERSINE = """2 * 6371000e0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
  + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""


@query(
    "haversine_distance",
    "c_custkey:i, o_orderkey:i, metres:2",
    f"""SELECT c_custkey, o_orderkey, {_HAVERSINE.format(a='a', b='b')} AS metres
        FROM (SELECT c_custkey, c_custkey % 160 - 80e0 AS lat, c_acctbal % 170 AS lon FROM customer) a
        JOIN (SELECT o_custkey, o_orderkey, o_orderkey % 170 - 85e0 AS lat, o_totalprice % 180 AS lon FROM orders) b ON c_custkey = o_custkey""",
)
def haversine_distance(f: Frames) -> DataFrame:
    a = f.table("customer").select("c_custkey", (F.col("c_custkey") % 160 - F.lit(80.0)).alias("la"), (F.col("c_acctbal") % 170).alias("lo"))
    b = f.table("orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_orderkey") % 170 - F.lit(85.0)).alias("la2"), (F.col("o_totalprice") % 180).alias("lo2")
    )
    joined = a.join(b, "c_custkey")
    return joined.withColumn("metres", S.haversine(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")))


@query(
    "geo_lookup",
    "activity_id:i, place",
    """SELECT activity_id, coalesce(p.place, CASE WHEN trim(location_name, '"') NOT IN ('', 'null') THEN trim(location_name, '"') END, 'Unknown') AS place
       FROM (SELECT * FROM runs WHERE start_lat IS NOT NULL) r
       LEFT JOIN (SELECT printf('%.3f,%.3f', 40 + n_nationkey / 1000, -75e0) AS k, n_name AS place FROM nation) p ON printf('%.3f,%.3f', start_lat, start_lon) = p.k""",
)
def geo_lookup(f: Frames) -> DataFrame:
    places = f.table("nation").select(
        S.geo_key(F.lit(40.0) + F.col("n_nationkey") / 1000, F.lit(-75.0)).alias("geo_key"), F.col("n_name").alias("place")
    )
    return place_names(f.runs.where(F.col("start_lat").isNotNull()), places)


def route_input(f: Frames) -> DataFrame:
    return f.runs.where(F.col("start_lat").isNotNull()).select(
        "profile_id", "activity_id", "date", "start_time_local", "start_lat", "start_lon", (F.col("distance_m") / 1000.0).alias("distance_km")
    )


# The sequential definition as a recursion over each entity's k-th run; a route
# is (id, lat, lon, km) frozen at its first run.
_MATCH = """(2 * 6371000e0 * asin(sqrt(pow(sin(radians({l}.lat - {r}.start_lat) / 2), 2)
  + cos(radians({r}.start_lat)) * cos(radians({l}.lat)) * pow(sin(radians({l}.lon - {r}.start_lon) / 2), 2))) <= 200 AND abs({r}.distance_km - {l}.km) / {l}.km <= 0.1e0)"""
def _routes_sql(source: str) -> str:
    """Recursive statement ending in CTE ``step`` (profile_id, activity_id, route_id) over a run source."""
    leader = "{'id': activity_id, 'lat': start_lat, 'lon': start_lon, 'km': distance_km}"
    return f"""
  WITH RECURSIVE o AS (SELECT profile_id, activity_id, start_lat, start_lon, distance_km,
      row_number() OVER (PARTITION BY profile_id ORDER BY start_time_local, activity_id) AS i FROM {source}),
  step AS (
    SELECT profile_id, i, activity_id, activity_id AS route_id, [{leader}] AS leaders FROM o WHERE i = 1
    UNION ALL
    SELECT profile_id, i, activity_id, coalesce(hit, activity_id), CASE WHEN hit IS NULL THEN list_append(leaders, {leader}) ELSE leaders END
    FROM (SELECT r.*, s.leaders, list_filter(s.leaders, lambda l: {_MATCH.format(l='l', r='r')})[1].id AS hit FROM step s JOIN o r ON r.profile_id = s.profile_id AND r.i = s.i + 1))"""


ROUTES_SQL = _routes_sql("(SELECT *, distance_m / 1000 AS distance_km FROM runs WHERE start_lat IS NOT NULL)") + " SELECT profile_id, activity_id, route_id FROM step"
STEADY_GPS = "(SELECT * FROM eff WHERE distance_m > 3000 AND start_lat IS NOT NULL AND hr_cv <= 8.5)"


@query("route_cluster", "profile_id, activity_id:i, route_id:i", ROUTES_SQL)
def route_cluster(f: Frames) -> DataFrame:
    return geo.leader_routes(route_input(f), BY, ["start_time_local", "activity_id"])


@query(
    "route_match",
    "profile_id, activity_id:i, route_id:i",
    _routes_sql("(SELECT *, distance_m / 1000 AS distance_km FROM runs WHERE start_lat IS NOT NULL)")
    + f""", lead AS (SELECT o.profile_id, o.activity_id AS route_id, start_lat AS lat, start_lon AS lon, distance_km AS km FROM o WHERE activity_id IN (SELECT route_id FROM step))
      SELECT r.profile_id, r.activity_id, l.route_id FROM o r JOIN lead l ON l.profile_id = r.profile_id AND {_MATCH.format(l='l', r='r')}""",
)
def route_match(f: Frames) -> DataFrame:
    """Every route whose first run a run matches, earlier or later."""
    runs = route_input(f)
    leaders = geo.route_leaders(runs, BY, ["start_time_local", "activity_id"]).withColumnRenamed("activity_id", "route_id")
    return geo.near_reference(runs, leaders, BY)


@query(
    "routes_report",
    "profile_id, route_id:i, runs:i, avg_distance_km:4, first_date:d, last_date:d, mean_ce:8, best_ce:8, recent_ce:8, percentile:i, marker, place",
    _routes_sql(STEADY_GPS)
    + f""", a AS (SELECT step.profile_id, step.activity_id, step.route_id, g.* EXCLUDE (profile_id, activity_id),
        row_number() OVER (PARTITION BY step.profile_id, step.route_id ORDER BY g.start_time_local DESC, step.activity_id DESC) AS back
      FROM step JOIN {STEADY_GPS} g ON step.activity_id = g.activity_id),
    r AS (SELECT profile_id, route_id, count(*) AS runs, avg(distance_km) AS avg_distance_km, min(date) AS first_date, max(date) AS last_date, avg(ce) AS mean_ce, max(ce) AS best_ce,
        avg(ce) FILTER (back <= 5) AS recent_ce,
        coalesce(arg_min(trim(location_name, '"'), (start_time_local, activity_id)) FILTER (trim(location_name, '"') NOT IN ('', 'null')), 'Unknown') AS place
      FROM a GROUP BY 1, 2 HAVING count(*) >= 5)
    SELECT r.*, (SELECT round(100 * avg(CASE WHEN a.ce < r.recent_ce THEN 1e0 ELSE 0e0 END)) FROM a WHERE a.profile_id = r.profile_id AND a.route_id = r.route_id) AS percentile,
      CASE WHEN recent_ce - mean_ce >= -1e-12 THEN 'above' WHEN recent_ce >= mean_ce - 0.0015e0 THEN 'slightly below' ELSE 'below' END AS marker FROM r""",
)
def routes_report(f: Frames) -> DataFrame:
    return routes.routes_report(f.run_frames, None)["routes"]


# ------------------------------------------------------------------- readiness
_FACTORS = [(c, int(s)) for c, s in readiness.FACTORS]


def _score_sql(base: str, day: str) -> str:
    """Scored factors: ``base`` has <c>_mean/_std, ``day`` the values."""
    zs = ", ".join(
        f"CASE WHEN {c} IS NULL OR {c}_std IS NULL THEN NULL WHEN {c}_std < 0.001e0 THEN 0 ELSE ({c} - {c}_mean) / {c}_std * {s} END AS z_{c}" for c, s in _FACTORS
    )
    total = " + ".join(f"coalesce(z_{c}, 0)" for c, _ in _FACTORS)
    count = " + ".join(f"CASE WHEN z_{c} IS NULL THEN 0 ELSE 1 END" for c, _ in _FACTORS)
    return f"""SELECT *, greatest(1, least(10, (mean_z + 2) / 4 * 9 + 1)) AS score
      FROM (SELECT *, ({total}) / ({count}) AS mean_z, {count} AS factors FROM (SELECT *, {zs} FROM {day} JOIN {base} USING (profile_id))) WHERE factors > 0"""


def _base_sql(where: str, src: str = "daily") -> str:
    cols = ", ".join(
        f"CASE WHEN count({c}) >= 10 THEN avg({c}) END AS {c}_mean, CASE WHEN count({c}) >= 10 THEN stddev_pop({c}) END AS {c}_std" for c, _ in _FACTORS
    )
    return f"(SELECT profile_id, {cols} FROM {src} WHERE {where} GROUP BY profile_id)"


ASSESS_SQL = _score_sql(
    _base_sql(f"date >= DATE '{TODAY}' - 90 AND date <= DATE '{TODAY}'"),
    f"""(SELECT profile_id, date AS assessed_on, {', '.join(c for c, _ in _FACTORS)} FROM daily
         WHERE date = DATE '{TODAY}' - 1 OR (date = DATE '{TODAY}' AND resting_hr IS NOT NULL)
         QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY date DESC) = 1)""",
)
_READY = "CASE WHEN score >= 7 THEN 'ready to push' WHEN score >= 4 THEN 'normal day' ELSE 'recovery day' END"


@query(
    "zscore_readiness",
    "profile_id, assessed_on:d, factors:i, z_resting_hr:6, z_sleep_seconds:6, z_hrv_last_night:6, z_avg_stress:6, mean_z:6, score:6, label",
    f"SELECT *, {_READY} AS label FROM ({ASSESS_SQL})",
)
def zscore_readiness(f: Frames) -> DataFrame:
    return readiness.assess(f.daily, today())


@query(
    "readiness_summary",
    "profile_id, score:6, km_7d:4, runs_7d:i, vol_28d:4, days_off:i, recommendation",
    f"""SELECT a.profile_id, score, km_7d, runs_7d, vol_28d, days_off,
          CASE WHEN score >= 7 AND days_off >= 2 THEN 'hard_or_long' WHEN score >= 7 THEN 'steady' WHEN score >= 4 AND days_off >= 1 THEN 'easy_to_moderate' WHEN score >= 4 THEN 'easy'
               WHEN days_off = 0 THEN 'rest_tomorrow' ELSE 'rest_or_short_easy' END AS recommendation
        FROM ({ASSESS_SQL}) a JOIN (
          SELECT profile_id, coalesce(sum(coalesce(distance_m, 0)) FILTER (date > DATE '{TODAY}' - 7 AND date <= DATE '{TODAY}'), 0) / 1000 AS km_7d,
            count(*) FILTER (date > DATE '{TODAY}' - 7 AND date <= DATE '{TODAY}') AS runs_7d,
            coalesce(sum(coalesce(distance_m, 0)) FILTER (date > DATE '{TODAY}' - 28 AND date <= DATE '{TODAY}'), 0) / 1000 AS vol_28d,
            coalesce(DATE '{TODAY}' - max(date) FILTER (date <= DATE '{TODAY}'), 0) AS days_off FROM run_like GROUP BY 1) v USING (profile_id)""",
)
def readiness_summary(f: Frames) -> DataFrame:
    return readiness.readiness_report(f.order_frames, today())["summary"]


def _history_sql(src: str) -> str:
    zs = ", ".join(
        f"CASE WHEN a.z_{c} IS NOT NULL AND a.{c}_std > 0.001e0 THEN (d.{c} - a.{c}_mean) / a.{c}_std * {s} END AS h_{c}" for c, s in _FACTORS
    )
    total = " + ".join(f"coalesce(h_{c}, 0)" for c, _ in _FACTORS)
    count = " + ".join(f"CASE WHEN h_{c} IS NULL THEN 0 ELSE 1 END" for c, _ in _FACTORS)
    return f"""SELECT profile_id, activity_id, date, ce, today_z, ({total}) / ({count}) AS mean_z
      FROM (SELECT e.profile_id, e.activity_id, e.date, e.ce, a.mean_z AS today_z, {zs} FROM {src} e JOIN daily d ON e.profile_id = d.profile_id AND e.date = d.date JOIN ({ASSESS_SQL}) a ON a.profile_id = e.profile_id)
      WHERE {count} >= 2 AND date <= DATE '{TODAY}'"""


def _expected_sql(src: str) -> str:
    return f"""SELECT profile_id, overall_ce, history, n_similar, CASE WHEN n_similar >= 5 THEN m END AS similar_ce, CASE WHEN n_similar >= 5 THEN l[len(l) // 4 + 1] END AS p25,
          CASE WHEN n_similar >= 5 THEN l[3 * len(l) // 4 + 1] END AS p75,
          CASE WHEN n_similar >= 5 THEN CASE WHEN m - overall_ce > 0.0005e0 THEN 'better' WHEN m - overall_ce < -0.0005e0 THEN 'worse' ELSE 'typical' END END AS outlook
        FROM (SELECT profile_id, avg(ce) AS overall_ce, count(*) AS history, count(*) FILTER (abs(mean_z - today_z) < 0.5e0) AS n_similar,
                avg(ce) FILTER (abs(mean_z - today_z) < 0.5e0) AS m, list(ce ORDER BY ce) FILTER (abs(mean_z - today_z) < 0.5e0) AS l FROM ({_history_sql(src)}) GROUP BY 1)"""


EXPECTED_COLUMNS = "profile_id, overall_ce:8, history:i, n_similar:i, similar_ce:8, p25:8, p75:8, outlook"


@query("similar_days", EXPECTED_COLUMNS, _expected_sql(DENSE))
def similar_days(f: Frames) -> DataFrame:
    scored = readiness.assess(f.daily, today())
    history = readiness.historical_days(dense_runs(f).where(F.col("date") <= today()), f.daily, scored)
    return readiness.expected_ce(history, scored)


@query("readiness_expected", EXPECTED_COLUMNS, _expected_sql("eff"))
def readiness_expected(f: Frames) -> DataFrame:
    return readiness.readiness_report(f.run_frames, today())["expected"]


# ----------------------------------------------------------------------- recap
LATEST = "(SELECT *, coalesce(distance_m, 0) / 1000 AS km FROM runs WHERE activity_type IN ('running', 'treadmill_running', 'virtual_run') QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY start_time_local DESC, activity_id DESC) = 1)"


@query(
    "latest_recap",
    "profile_id, activity_id:i, date:d, distance_km:4, duration_text, this_ce:8, avg_28d:8, vs_28d_pct:6, vs_28d, percentile:i, decoupling_pct:6, skip_reason, te_high, te_low",
    f"""SELECT t.profile_id, t.activity_id, t.date, t.km AS distance_km, CAST(CAST(t.duration_sec AS BIGINT) // 60 AS STRING) || ':' || lpad(CAST(CAST(t.duration_sec AS BIGINT) % 60 AS STRING), 2, '0') AS duration_text,
          c.this_ce, c.avg_28d, (c.this_ce - c.avg_28d) / c.avg_28d * 100 AS vs_28d_pct,
          CASE WHEN (c.this_ce - c.avg_28d) / c.avg_28d * 100 > 0.5e0 THEN 'better' WHEN (c.this_ce - c.avg_28d) / c.avg_28d * 100 < -0.5e0 THEN 'worse' WHEN c.avg_28d IS NOT NULL THEN 'similar' END AS vs_28d,
          CASE WHEN c.n > 1 THEN c.pct END AS percentile, dr.decoupling_pct, dr.skip_reason, coalesce(training_effect >= 4, false) AS te_high, coalesce(training_effect < 2, false) AS te_low
        FROM {LATEST} t
        LEFT JOIN (SELECT l.profile_id, max(m.ce) AS this_ce, count(*) AS n, avg(e.ce) FILTER (e.date > l.date - 28 AND e.activity_id <> l.activity_id) AS avg_28d,
                     round(100 * avg(CASE WHEN e.ce < m.ce THEN 1e0 ELSE 0e0 END)) AS pct
                   FROM {LATEST} l JOIN eff m USING (activity_id) JOIN eff e ON e.profile_id = l.profile_id GROUP BY 1) c ON c.profile_id = t.profile_id
        LEFT JOIN drift dr ON dr.activity_id = t.activity_id AND t.distance_m >= 5000""",
)
def latest_recap(f: Frames) -> DataFrame:
    return recap.recap_report(f.run_frames)["summary"]


DENSE_LATEST = f"(SELECT * FROM {DENSE} QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY start_time_local DESC, activity_id DESC) = 1)"


@query(
    "similar_runs",
    "profile_id, activity_id:i, n_similar:i, similar_ce:8, vs_similar_pct:6, vs_similar, best:8, best_label:d, worst:8, worst_label:d",
    f"""SELECT *, (ce - similar_ce) / similar_ce * 100 AS vs_similar_pct,
          CASE WHEN (ce - similar_ce) / similar_ce * 100 > 0.5e0 THEN 'better' WHEN (ce - similar_ce) / similar_ce * 100 < -0.5e0 THEN 'worse' ELSE 'similar' END AS vs_similar
        FROM (SELECT l.profile_id, l.activity_id, max(l.ce) AS ce, count(*) AS n_similar, avg(e.ce) AS similar_ce, max(e.ce) AS best, arg_max(e.date, (e.ce, e.date, e.activity_id)) AS best_label,
                min(e.ce) AS worst, arg_min(e.date, (e.ce, e.date, e.activity_id)) AS worst_label
              FROM {DENSE_LATEST} l JOIN {DENSE} e ON e.profile_id = l.profile_id AND e.date > l.date - 90 AND e.activity_id <> l.activity_id
                AND e.distance_km >= l.distance_km * (1 - 0.2e0) AND e.distance_km <= l.distance_km * (1 + 0.2e0) GROUP BY 1, 2 HAVING count(*) >= 3)""",
)
def similar_runs(f: Frames) -> DataFrame:
    runs = dense_runs(f)
    latest = recap.latest_run(f.acts)
    return recap.similar_comparison(latest, runs)


@query(
    "recap_recovery",
    "profile_id, date:d, factors:i, mean_z:6, score:6, label",
    f"""SELECT *, {_READY} AS label FROM ({_score_sql(
        _base_sql("date >= run_day - 90 AND date < run_day", f"(SELECT d.*, l.date AS run_day FROM daily d JOIN {DENSE_LATEST} l ON d.profile_id = l.profile_id)"),
        f"(SELECT d.* FROM daily d JOIN {DENSE_LATEST} l ON d.profile_id = l.profile_id AND d.date = l.date)")})""",
)
def recap_recovery(f: Frames) -> DataFrame:
    return recap.recovery_context(recap.latest_run(f.acts), f.daily)


@query(
    "recap_splits",
    "activity_id:i, split_number:i, split_type, distance_m:2, pace_text",
    """SELECT activity_id, split_number, split_type, distance_m, CAST(sp // 60 AS STRING) || ':' || lpad(CAST(sp % 60 AS STRING), 2, '0') AS pace_text
       FROM (SELECT *, bool_or(split_type = 'INTERVAL') OVER (PARTITION BY activity_id) AS any_interval, CAST(round(1000 / (distance_m / duration_sec)) AS BIGINT) AS sp
             FROM splits WHERE activity_id IN (SELECT activity_id FROM run_like QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY start_time_local DESC, activity_id DESC) = 1))
       WHERE (NOT any_interval OR split_type = 'INTERVAL') AND distance_m >= 100""",
)
def recap_splits(f: Frames) -> DataFrame:
    return recap.recap_splits(f.splits, recap.latest_run(f.acts))
