"""Joins, rollups, windows and interval features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..operators.ranges import Range, asof_last, range_features
from ..plans import decompose, features, injury
from ..session import durable
from .frames import BY, Frames
from .registry import query

NATION_DAY = """
  SELECT profile_id, date, count(*) AS orders, sum(distance_m) / 1000 AS volume,
    CASE WHEN sum(activity_id) % 5 = 0 THEN NULL ELSE sum(distance_m) / 1000 END AS signal
  FROM acts GROUP BY profile_id, date"""


def nation_day(f: Frames) -> DataFrame:
    """One row per nation and order date: volume, and the same as a signal with gaps."""
    total = F.sum("distance_m") / 1000
    return f.acts.groupBy("profile_id", "date").agg(
        F.count(F.lit(1)).alias("orders"),
        total.alias("volume"),
        F.when(F.sum("activity_id") % 5 != 0, total).alias("signal"),
    )


# ---------------------------------------------------------------------- joins
@query(
    "daily_class_load",
    "profile_id, date:d, distance_today_km:5, cross_train_today_km:5",
    """SELECT profile_id, date,
         coalesce(sum(CASE WHEN activity_type IN ('running', 'treadmill_running', 'virtual_run') THEN distance_m / 1000 ELSE 0 END), 0) AS distance_today_km,
         coalesce(sum(CASE WHEN activity_type IN ('cycling', 'indoor_cycling', 'virtual_ride', 'road_biking', 'mountain_biking', 'lap_swimming', 'open_water_swimming', 'hiking')
                           THEN distance_m / 1000 ELSE 0 END), 0) AS cross_train_today_km
       FROM acts GROUP BY 1, 2""",
)
def daily_class_load(f: Frames) -> DataFrame:
    return A.daily_load(f.acts, BY)


@query(
    "daily_rollup",
    "profile_id, date:d, activity_count:i, activity_duration_sec:3, activity_distance_m:3, activity_calories:3, activity_training_load:3",
    """SELECT profile_id, date, count(activity_id) AS activity_count, coalesce(sum(duration_sec), 0) AS activity_duration_sec,
         coalesce(sum(distance_m), 0) AS activity_distance_m, coalesce(sum(calories), 0) AS activity_calories, max(training_load) AS activity_training_load
       FROM acts GROUP BY 1, 2""",
)
def daily_rollup(f: Frames) -> DataFrame:
    return A.daily_rollup(f.acts, BY)


@query(
    "last_row_per_day",
    "profile_id, date:d, weight_kg:3, body_fat:3",
    """SELECT profile_id, date, weight_kg, body_fat FROM weight
       QUALIFY row_number() OVER (PARTITION BY profile_id, date ORDER BY timestamp_gmt DESC, sample_pk DESC) = 1""",
)
def last_row_per_day(f: Frames) -> DataFrame:
    return A.last_row_per(f.weight, ["profile_id", "date"], ["timestamp_gmt", "sample_pk"], ["weight_kg", "body_fat"])


@query(
    "spine_left_join_fill0",
    "user_id:i, date:d, n:i, total:4",
    """SELECT s.user_id, s.date, coalesce(n, 0) AS n, coalesce(total, 0) AS total
       FROM (SELECT user_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM ev GROUP BY user_id) s
       LEFT JOIN (SELECT user_id, date, count(*) AS n, sum(value) AS total FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2) e
         ON s.user_id = e.user_id AND s.date = e.date""",
)
def spine_left_join_fill0(f: Frames) -> DataFrame:
    ev = f.events
    bounds = ev.groupBy("user_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    spine = J.date_spine(bounds, ["user_id"])
    side = ev.where(S.type_in(["purchase", "signup"], "event_type")).groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return J.spine_join(spine, side, ["user_id", "date"], {"n": 0, "total": 0.0})


@query(
    "weekly_full_outer",
    "profile_id, week:d, rhr_avg:6, stress_avg:6, sleep_avg:6, weekly_km:4, run_count:i, hard_runs:i, te_max:4, tl_sum:4",
    """SELECT coalesce(h.profile_id, i.profile_id) AS profile_id, coalesce(h.week, i.week) AS week, rhr_avg, stress_avg, sleep_avg,
         coalesce(weekly_km, 0) AS weekly_km, coalesce(run_count, 0) AS run_count, coalesce(hard_runs, 0) AS hard_runs, te_max, coalesce(tl_sum, 0) AS tl_sum
       FROM (SELECT profile_id, CAST(date_trunc('week', date) AS DATE) AS week, avg(resting_hr) AS rhr_avg, avg(avg_stress) AS stress_avg, avg(sleep_seconds / 3600) AS sleep_avg
             FROM daily GROUP BY 1, 2) h
       FULL JOIN (SELECT profile_id, CAST(date_trunc('week', date) AS DATE) AS week, coalesce(sum(distance_m / 1000), 0) AS weekly_km, count(*) AS run_count,
               count(*) FILTER (training_effect >= 3) AS hard_runs, max(training_effect) AS te_max, sum(training_load) AS tl_sum FROM run_like GROUP BY 1, 2) i
         ON h.profile_id = i.profile_id AND h.week = i.week""",
)
def weekly_full_outer(f: Frames) -> DataFrame:
    health = A.weekly_health(f.daily, BY)
    return J.full_join([health, A.weekly_intensity(f.acts, BY)], ["profile_id", "week"], injury.ZERO_FILLED)


WEEKLY_SQL = """
  SELECT *, CASE WHEN weekly_km > 5 AND stress_delta > 3 AND (coalesce(rhr_delta > 1, false) OR hard_runs >= 3) THEN 'RED'
              WHEN weekly_km > 5 AND stress_delta > 3 THEN 'YEL' WHEN vol_acwr > 1.5e0 THEN 'VOL' ELSE '' END AS level
  FROM (SELECT *, rhr_avg - rhr_8wk AS rhr_delta, stress_avg - stress_8wk AS stress_delta, sleep_avg - sleep_8wk AS sleep_delta,
          CASE WHEN km_8wk > 0 THEN km_4wk / km_8wk END AS vol_acwr
    FROM (SELECT *, CASE WHEN count(rhr_avg) OVER w8 >= 4 THEN avg(rhr_avg) OVER w8 END AS rhr_8wk,
            CASE WHEN count(stress_avg) OVER w8 >= 4 THEN avg(stress_avg) OVER w8 END AS stress_8wk,
            CASE WHEN count(sleep_avg) OVER w8 >= 4 THEN avg(sleep_avg) OVER w8 END AS sleep_8wk,
            CASE WHEN count(weekly_km) OVER w4 >= 2 THEN avg(weekly_km) OVER w4 END AS km_4wk,
            CASE WHEN count(weekly_km) OVER w8 >= 4 THEN avg(weekly_km) OVER w8 END AS km_8wk
      FROM (SELECT coalesce(h.profile_id, i.profile_id) AS profile_id, coalesce(h.week, i.week) AS week, rhr_avg, stress_avg, bb_start_avg, sleep_avg, hrv_avg,
              coalesce(weekly_km, 0) AS weekly_km, coalesce(run_count, 0) AS run_count, coalesce(hard_runs, 0) AS hard_runs, avg_hr_mean, te_mean, te_max, coalesce(tl_sum, 0) AS tl_sum
            FROM (SELECT profile_id, CAST(date_trunc('week', date) AS DATE) AS week, avg(resting_hr) AS rhr_avg, avg(avg_stress) AS stress_avg,
                    avg(body_battery_start) AS bb_start_avg, avg(sleep_seconds / 3600) AS sleep_avg, avg(hrv_last_night) AS hrv_avg FROM daily GROUP BY 1, 2) h
            FULL JOIN (SELECT profile_id, CAST(date_trunc('week', date) AS DATE) AS week, coalesce(sum(distance_m / 1000), 0) AS weekly_km, count(*) AS run_count,
                    avg(avg_hr) AS avg_hr_mean, avg(training_effect) AS te_mean, max(training_effect) AS te_max,
                    count(*) FILTER (training_effect >= 3) AS hard_runs, sum(training_load) AS tl_sum FROM run_like GROUP BY 1, 2) i
              ON h.profile_id = i.profile_id AND h.week = i.week)
      WINDOW w8 AS (PARTITION BY profile_id ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
             w4 AS (PARTITION BY profile_id ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)))"""
WEEKLY_COLUMNS = (
    "profile_id, week:d, weekly_km:4, run_count:i, hard_runs:i, te_mean:6, te_max:4, rhr_avg:6, stress_avg:6, bb_start_avg:6, "
    "sleep_avg:6, hrv_avg:6, rhr_8wk:7, stress_8wk:7, km_4wk:6, km_8wk:6, rhr_delta:7, stress_delta:7, sleep_delta:7, vol_acwr:6, level"
)


@query("injury_weekly", WEEKLY_COLUMNS, WEEKLY_SQL)
def injury_weekly(f: Frames) -> DataFrame:
    return injury.injury_report(f.order_frames)["weekly"]


@query(
    "injury_current",
    WEEKLY_COLUMNS,
    f"SELECT * FROM ({WEEKLY_SQL}) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY week DESC) <= 12",
)
def injury_current(f: Frames) -> DataFrame:
    return injury.injury_report(f.order_frames)["shown"]


@query(
    "health_on_day",
    "profile_id, activity_id:i, date:d, resting_hr:i, avg_stress:i",
    "SELECT r.profile_id, r.activity_id, r.date, resting_hr, avg_stress FROM runs r JOIN daily d ON r.profile_id = d.profile_id AND r.date = d.date",
)
def health_on_day(f: Frames) -> DataFrame:
    return J.health_on_day(f.runs, f.daily.drop("ingest_seq"), BY)


@query(
    "existence_joins",
    "o_orderkey:i, has_lines, has_returns",
    """SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines,
         o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_returns FROM orders""",
)
def existence_joins(f: Frames) -> DataFrame:
    orders = f.table("orders").select("o_orderkey")
    lines = f.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    returned = lines.where(F.col("l_returnflag") == "R")
    with_returns = J.semi(orders, returned, ["o_orderkey"]).select("o_orderkey", F.lit(True).alias("has_lines"), F.lit(True).alias("has_returns"))
    lines_only = J.anti(J.semi(orders, lines, ["o_orderkey"]), returned, ["o_orderkey"]).select("o_orderkey", F.lit(True).alias("has_lines"), F.lit(False).alias("has_returns"))
    bare = J.anti(orders, lines, ["o_orderkey"]).select("o_orderkey", F.lit(False).alias("has_lines"), F.lit(False).alias("has_returns"))
    return with_returns.unionByName(lines_only).unionByName(bare)


# ------------------------------------------------------------- trailing windows
@query(
    "rolling_7_min5",
    "profile_id, date:d, mean7:6, std7:6",
    f"""SELECT profile_id, date, CASE WHEN count(signal) OVER w >= 5 THEN avg(signal) OVER w END AS mean7,
          CASE WHEN count(signal) OVER w >= 5 THEN stddev_samp(signal) OVER w END AS std7
        FROM ({NATION_DAY}) WINDOW w AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_7_min5(f: Frames) -> DataFrame:
    return nation_day(f).withColumns(
        {
            "mean7": W.trailing("signal", BY, "date", 7, "avg", 5),
            "std7": W.trailing("signal", BY, "date", 7, "std", 5),
        }
    )


@query(
    "rolling_7_days",
    "profile_id, date:d, mean7:6, n7:i",
    f"""SELECT profile_id, date, CASE WHEN count(signal) OVER w >= 2 THEN avg(signal) OVER w END AS mean7, count(signal) OVER w AS n7
        FROM ({NATION_DAY}) WINDOW w AS (PARTITION BY profile_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
)
def rolling_7_days(f: Frames) -> DataFrame:
    return nation_day(f).withColumns(
        {
            "mean7": W.trailing("signal", BY, "date", 7, "avg", 2, frame="days"),
            "n7": W.trailing("signal", BY, "date", 7, "count", 0, frame="days"),
        }
    )


def _strict(n: int) -> str:
    w = f"(PARTITION BY profile_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(volume) OVER {w} >= {n} THEN sum(volume) OVER {w} END AS sum{n}"


@query(
    "shifted_sums",
    "profile_id, date:d, sum7:6, sum28:6, sum90:6",
    f"SELECT profile_id, date, {_strict(7)}, {_strict(28)}, {_strict(90)} FROM ({NATION_DAY})",
)
def shifted_sums(f: Frames) -> DataFrame:
    return nation_day(f).withColumns(
        {f"sum{n}": W.trailing("volume", BY, "date", n, "sum", n, shift=1) for n in (7, 28, 90)}
    )


@query(
    "shifted_mean",
    "profile_id, date:d, prior7:6",
    f"""SELECT profile_id, date, CASE WHEN count(signal) OVER w >= 5 THEN avg(signal) OVER w END AS prior7
        FROM ({NATION_DAY}) WINDOW w AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def shifted_mean(f: Frames) -> DataFrame:
    return nation_day(f).withColumn("prior7", W.trailing("signal", BY, "date", 7, "avg", 5, shift=1))


@query(
    "ffill_limit",
    "profile_id, date:d, filled2:6",
    f"""SELECT profile_id, date, last_value(signal IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled2
        FROM (SELECT profile_id, date, CASE WHEN orders % 2 = 0 THEN signal END AS signal FROM ({NATION_DAY}))""",
)
def ffill_limit(f: Frames) -> DataFrame:
    sparse = nation_day(f).withColumn("signal", F.when(F.col("orders") % 2 == 0, F.col("signal")))
    return sparse.withColumn("filled2", W.ffill("signal", BY, "date", 2))


@query(
    "next_row_target",
    "user_id:i, date:d, today:4, tomorrow:4",
    """SELECT user_id, date, total AS today, lead(total) OVER (PARTITION BY user_id ORDER BY date) AS tomorrow
       FROM (SELECT user_id, date, sum(value) AS total FROM ev GROUP BY 1, 2)""",
)
def next_row_target(f: Frames) -> DataFrame:
    daily = f.events.groupBy("user_id", "date").agg(F.sum("value").alias("today"))
    return daily.withColumn("tomorrow", W.next_row("today", ["user_id"]))


# ----------------------------------------------------------- positional windows
PLACED_LINES = """
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos FROM lineitem"""
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def placed_lines(f: Frames) -> DataFrame:
    return W.row_positions(f.table("lineitem"), ["l_returnflag"], F.to_date("l_shipdate"), LINE_ORDER, "pos")


@query("row_positions", "l_returnflag, pos:i, l_orderkey:i, l_linenumber:i, l_extendedprice:2", PLACED_LINES)
def row_positions(f: Frames) -> DataFrame:
    """Positions inside three huge groups, numbered without a task per group."""
    return placed_lines(f)


@query(
    "smooth_centered",
    "l_returnflag, pos:i, smooth:6, delta:6",
    f"""SELECT l_returnflag, pos, smooth, smooth - lag(smooth) OVER (PARTITION BY l_returnflag ORDER BY pos) AS delta
        FROM (SELECT *, coalesce(avg(v) OVER (PARTITION BY l_returnflag ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 0) AS smooth
              FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS v FROM ({PLACED_LINES})))""",
)
def smooth_centered(f: Frames) -> DataFrame:
    by = ["l_returnflag"]
    lines = placed_lines(f).withColumn("v", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).select(*by, "pos", "v")
    framed = W.with_halo(lines, "pos", 1024, before=8, after=7)
    smooth = framed.withColumn("smooth", W.centred_mean("v", by, "pos", 7))
    return smooth.withColumn("delta", F.col("smooth") - W.lag_in_block("smooth", by, "pos")).where(W.CORE)


@query(
    "rolling_10_rows",
    "l_returnflag, pos:i, mean10:6",
    f"""SELECT l_returnflag, pos, CASE WHEN pos >= 9 THEN avg(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS mean10
        FROM ({PLACED_LINES})""",
)
def rolling_10_rows(f: Frames) -> DataFrame:
    lines = placed_lines(f).select("l_returnflag", "pos", "l_quantity")
    return W.rolling_mean_rows(lines, ["l_returnflag"], "pos", "l_quantity", 10, "mean10", size=2048)


@query(
    "latest_per_entity",
    "c_custkey:i, o_orderkey:i, rank:i",
    """SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders
       QUALIFY rank <= 3""",
)
def latest_per_entity(f: Frames) -> DataFrame:
    orders = f.table("orders").withColumnRenamed("o_custkey", "c_custkey")
    return W.top_k(orders, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, rank="rank")


@query(
    "tail_fraction",
    "profile_id, date:d, volume:6",
    f"""SELECT profile_id, date, volume FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY profile_id) AS n FROM ({NATION_DAY}))
        WHERE i >= floor(n * 0.8e0)""",
)
def tail_fraction(f: Frames) -> DataFrame:
    return W.tail_fraction(nation_day(f), BY, "date", 0.2)


@query(
    "expanding_folds",
    "profile_id, date:d, row_idx:i, fold:i",
    f"""SELECT profile_id, date, i AS row_idx, CASE WHEN i >= 30 AND 30 + 7 * ((i - 30) // 7 + 1) <= n THEN (i - 30) // 7 END AS fold
        FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY profile_id) AS n FROM ({NATION_DAY}))""",
)
def expanding_folds(f: Frames) -> DataFrame:
    return W.expanding_folds(nation_day(f), BY, "date")


# ------------------------------------------------------------ interval features
@query(
    "range_window_features",
    "event_id:i, user_id:i, sum7:4, mean7:6, max14:2, n7:i, early:4, taper:9",
    """SELECT event_id, user_id, sum7, mean7, max14, n7, early, CASE WHEN early > 0 THEN 1 - sum7 / (early / 3) END AS taper
       FROM (SELECT a.event_id, a.user_id,
           coalesce(sum(e.value) FILTER (a.date - e.date <= 7), 0) AS sum7, avg(e.value) FILTER (a.date - e.date <= 7) AS mean7,
           max(e.value) AS max14, count(e.event_id) FILTER (a.date - e.date <= 7) AS n7,
           coalesce(sum(e.value) FILTER (a.date - e.date >= 8), 0) AS early
         FROM (SELECT * FROM ev WHERE event_type = 'purchase') a
         LEFT JOIN (SELECT * FROM ev WHERE event_type <> 'purchase') e ON a.user_id = e.user_id AND e.date BETWEEN a.date - 14 AND a.date - 1
         GROUP BY a.event_id, a.user_id)""",
)
def range_window_features(f: Frames) -> DataFrame:
    ev = f.events
    anchors = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "date")
    out = range_features(
        anchors,
        ev.where(F.col("event_type") != "purchase"),
        ["user_id"],
        [
            Range("sum7", "sum", "value", 7),
            Range("mean7", "mean", "value", 7),
            Range("max14", "max", "value", 14),
            Range("n7", "count", None, 7),
            Range("early", "sum", "value", 14, 8),
        ],
    )
    return out.withColumn("taper", S.taper(F.col("sum7"), F.col("early")))


@query(
    "fraction_windows",
    "event_id:i, above:6, in_set:6",
    """SELECT a.event_id, avg(CASE WHEN e.value > 50 THEN 1e0 ELSE 0e0 END) FILTER (e.event_id IS NOT NULL) AS above,
         avg(CASE WHEN e.event_type IN ('error', 'signup') THEN 1e0 ELSE 0e0 END) FILTER (e.event_id IS NOT NULL) AS in_set
       FROM (SELECT * FROM ev WHERE event_type = 'purchase') a
       LEFT JOIN ev e ON a.user_id = e.user_id AND e.date BETWEEN a.date - 10 AND a.date - 1 GROUP BY a.event_id""",
)
def fraction_windows(f: Frames) -> DataFrame:
    ev = f.events
    anchors = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "date")
    return range_features(
        anchors,
        ev,
        ["user_id"],
        [
            Range("above", "share_above", "value", 10, arg=50.0),
            Range("in_set", "share_in", "event_type", 10, arg=["error", "signup"]),
        ],
    )


@query(
    "asof_last_30d",
    "activity_id:i, profile_id, weight_kg:3",
    """SELECT a.activity_id, a.profile_id, arg_max(w.weight_kg, (w.date, w.timestamp_gmt, w.sample_pk)) FILTER (w.weight_kg IS NOT NULL) AS weight_kg
       FROM run_like a LEFT JOIN weight w ON a.profile_id = w.profile_id AND w.date BETWEEN a.date - 30 AND a.date - 1 GROUP BY 1, 2""",
)
def asof_last_30d(f: Frames) -> DataFrame:
    anchors = f.acts.where(S.type_in(S.RUNNING_TYPES)).select("activity_id", "profile_id", "date")
    return asof_last(anchors, f.weight, BY, "weight_kg", 30, order=["timestamp_gmt", "sample_pk"])


# --------------------------------------------------------------- feature matrix
_SIDE = """
  SELECT profile_id, date, {cols} FROM (
    SELECT profile_id, date, {fills}
    FROM (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY profile_id, date ORDER BY {order}) = 1))"""


def _side(table: str, cols: list[str], limit: int, order: str) -> str:
    fills = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY date ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS {c}" for c in cols
    )
    return _SIDE.format(table=table, cols=", ".join(cols), fills=fills, order=order)


_ROLL = "(PARTITION BY profile_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def _roll(c: str, fn: str, name: str) -> str:
    return f"CASE WHEN count({c}) OVER {_ROLL} >= 5 THEN {fn}({c}) OVER {_ROLL} END AS {name}"


FEATURES_SQL = f"""
  SELECT *, {_roll('resting_hr', 'avg', 'resting_hr_7d_mean')}, {_roll('resting_hr', 'stddev_samp', 'resting_hr_7d_std')},
    {_roll('sleep_hours', 'avg', 'sleep_hours_7d_mean')}, {_roll('steps', 'avg', 'steps_7d_mean')},
    {_roll('active_calories', 'avg', 'active_calories_7d_mean')}, {_roll('hrv_last_night', 'avg', 'hrv_last_night_7d_mean')}
  FROM (SELECT d.profile_id, d.date, resting_hr, sleep_seconds / 3600 AS sleep_hours, steps, active_calories, avg_stress,
          body_battery_end - body_battery_start AS body_battery_delta, hrv_last_night, avg_spo2, sleep_score,
          sin(isodow(d.date) * 2 * pi() / 7) AS day_sin, cos(isodow(d.date) * 2 * pi() / 7) AS day_cos,
          vo2max, training_readiness, endurance_score,
          coalesce(activity_count, 0) AS activity_count, coalesce(activity_duration_sec, 0) AS activity_duration_sec,
          coalesce(activity_distance_m, 0) AS activity_distance_m, coalesce(activity_calories, 0) AS activity_calories,
          coalesce(activity_training_load, 0) AS activity_training_load, weight_kg, body_fat, systolic, diastolic
        FROM daily d
        LEFT JOIN ({_side('performance', ['vo2max', 'training_readiness', 'endurance_score'], 14, 'ingest_seq DESC')}) p ON d.profile_id = p.profile_id AND d.date = p.date
        LEFT JOIN (SELECT profile_id, date, count(activity_id) AS activity_count, sum(duration_sec) AS activity_duration_sec, sum(distance_m) AS activity_distance_m,
                     sum(calories) AS activity_calories, max(training_load) AS activity_training_load FROM acts GROUP BY 1, 2) a ON d.profile_id = a.profile_id AND d.date = a.date
        LEFT JOIN ({_side('weight', ['weight_kg', 'body_fat'], 30, 'timestamp_gmt DESC, sample_pk DESC')}) w ON d.profile_id = w.profile_id AND d.date = w.date
        LEFT JOIN ({_side('pressure', ['systolic', 'diastolic'], 30, 'timestamp_gmt DESC')}) b ON d.profile_id = b.profile_id AND d.date = b.date)"""
FEATURE_NAMES = [
    *features.DAILY_FEATURES,
    *features.CALENDAR_FEATURES,
    *features.PERFORMANCE_FEATURES,
    *features.ACTIVITY_FEATURES,
    *features.WEIGHT_FEATURES,
    *features.PRESSURE_FEATURES,
    *[n for _, _, n in features.ROLLING_FEATURES],
]


@query("feature_frame", "profile_id, date:d, " + ", ".join(f"{c}:4" for c in FEATURE_NAMES), FEATURES_SQL)
def feature_frame(f: Frames) -> DataFrame:
    return features.feature_frame(f.order_frames)[0]




@query(
    "feature_matrix",
    "profile_id, date:d, resting_hr:2, sleep_hours:6, resting_hr_7d_mean:6, steps_7d_mean:4, next_day_resting_hr:2",
    f"""WITH m AS (SELECT *, lead(resting_hr) OVER (PARTITION BY profile_id ORDER BY date) AS next_day_resting_hr FROM ({FEATURES_SQL})),
          s AS (SELECT {', '.join(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_{c}' for c in FEATURE_NAMES)} FROM m)
        SELECT m.* FROM m, s WHERE next_day_resting_hr IS NOT NULL AND {' AND '.join(f'(null_{c} > 0.3e0 OR {c} IS NOT NULL)' for c in FEATURE_NAMES)}""",
)
def feature_matrix(f: Frames) -> DataFrame:
    return features.feature_matrix(f.order_frames, "next_day_resting_hr")[0]


@query(
    "load_features",
    "profile_id, date:d, distance_today_km:4, distance_7d_km:4, distance_28d_km:4, distance_90d_km:4, distance_7d_km_sq:2, cross_train_7d_km:4, "
    "sleep_hours_last_night:6, sleep_hours_prior_7d:6",
    """SELECT *, distance_7d_km * distance_7d_km AS distance_7d_km_sq FROM (
         SELECT *, CASE WHEN count(*) OVER w7 >= 7 THEN sum(distance_today_km) OVER w7 END AS distance_7d_km,
           CASE WHEN count(*) OVER w28 >= 28 THEN sum(distance_today_km) OVER w28 END AS distance_28d_km,
           CASE WHEN count(*) OVER w90 >= 90 THEN sum(distance_today_km) OVER w90 END AS distance_90d_km,
           CASE WHEN count(*) OVER w7 >= 7 THEN sum(cross_train_today_km) OVER w7 END AS cross_train_7d_km,
           CASE WHEN count(sleep_hours_last_night) OVER w7 >= 5 THEN avg(sleep_hours_last_night) OVER w7 END AS sleep_hours_prior_7d
         FROM load_spine
         WINDOW w7 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
                w28 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
                w90 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))""",
)
def load_features(f: Frames) -> DataFrame:
    return decompose.load_features(f.order_frames)


# ------------------------------------------------------------ order statistics
@query(
    "floor_rank_quantile",
    "event_type, p25:2, p50:2, p75:2",
    """SELECT event_type, v[len(v) // 4 + 1] AS p25, v[len(v) // 2 + 1] AS p50, v[3 * len(v) // 4 + 1] AS p75
       FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)""",
)
def floor_rank_quantile(f: Frames) -> DataFrame:
    return A.floor_rank_quantile(f.table("events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query(
    "percentile_of",
    "user_id:i, last_value:2, percentile:i",
    """SELECT e.user_id, max(l.value) AS last_value, CAST(round(100 * avg(CASE WHEN e.value < l.value THEN 1e0 ELSE 0e0 END)) AS INT) AS percentile
       FROM events e JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1) l ON e.user_id = l.user_id GROUP BY 1""",
)
def percentile_of(f: Frames) -> DataFrame:
    ev = f.table("events").select("user_id", "event_id", "value")
    last = durable(ev.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value")))
    return ev.join(last, "user_id").groupBy("user_id").agg(
        F.max("last_value").alias("last_value"), stats.percentile_of(F.col("value"), F.col("last_value")).alias("percentile")
    )


@query(
    "extremes",
    "user_id:i, best:2, best_label:i, worst:2, worst_label:i",
    """SELECT user_id, max(value) AS best, arg_max(event_id, (value, event_id)) AS best_label, min(value) AS worst, arg_min(event_id, (value, event_id)) AS worst_label
       FROM events GROUP BY 1""",
)
def extremes(f: Frames) -> DataFrame:
    return A.extremes(f.table("events"), ["user_id"], "value", "event_id", ["event_id"])


@query(
    "band_means",
    "l_returnflag, band, n:i, l_discount:6, l_tax:6",
    """SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax
       FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 45 GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def band_means(f: Frames) -> DataFrame:
    edges = [(5.0, 10.0, "low"), (10.0, 30.0, "mid"), (30.0, 45.0, "high")]
    return A.band_means(f.table("lineitem"), ["l_returnflag"], "l_quantity", edges, ["l_discount", "l_tax"])


@query(
    "baseline_90d",
    "profile_id, resting_hr_mean:6, resting_hr_std:6, hrv_last_night_mean:6, hrv_last_night_std:6",
    """SELECT profile_id, CASE WHEN count(resting_hr) >= 10 THEN avg(resting_hr) END AS resting_hr_mean, CASE WHEN count(resting_hr) >= 10 THEN stddev_pop(resting_hr) END AS resting_hr_std,
         CASE WHEN count(hrv_last_night) >= 10 THEN avg(hrv_last_night) END AS hrv_last_night_mean, CASE WHEN count(hrv_last_night) >= 10 THEN stddev_pop(hrv_last_night) END AS hrv_last_night_std
       FROM daily WHERE date >= DATE '2000-06-30' - 90 AND date < DATE '2000-06-30' GROUP BY 1""",
)
def baseline_90d(f: Frames) -> DataFrame:
    return A.baseline(f.daily, BY, ["resting_hr", "hrv_last_night"], F.lit("2000-06-30").cast("date"), include_day=False)
