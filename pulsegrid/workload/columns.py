"""Telemetry-shaped views of the benchmark tables, as SQL expressions.

The benchmark tables hold orders, order lines, customers, suppliers and events.
The expressions below derive daily readings, activities, samples and side tables
from them, with gaps, sentinels and duplicates where the operators care. They are
plain SQL that reads the same in Spark and in an ANSI engine, so a query and its
check start from the same rows.
"""

from __future__ import annotations

K = "o_orderkey"

# One reading per order; several per (nation, day), the highest order key being
# the last write.
DAILY_RAW = [
    ("profile_id", "c_nationkey"),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("ingest_seq", K),
    (
        "resting_hr",
        f"CAST(CASE WHEN {K} % 61 = 0 THEN NULL WHEN {K} % 29 = 0 THEN 10 WHEN {K} % 31 = 0 THEN 230 "
        f"WHEN {K} % 23 = 0 THEN NULL ELSE 45 + ({K} * 7) % 40 END AS INT)",
    ),
    (
        "sleep_seconds",
        f"CAST(CASE WHEN {K} % 61 = 0 THEN NULL WHEN {K} % 19 = 0 THEN 0 WHEN {K} % 37 = 0 THEN 60000 "
        f"ELSE 18000 + 36 * (({K} * 131) % 500) END AS INT)",
    ),
    ("sleep_score", f"CAST(CASE WHEN {K} % 7 = 0 THEN NULL ELSE ({K} * 13) % 100 END AS INT)"),
    (
        "steps",
        f"CAST(CASE WHEN {K} % 61 = 0 THEN 0 WHEN {K} % 43 = 0 THEN -100 WHEN {K} % 89 = 0 THEN 500000 "
        "ELSE floor(o_totalprice / 20) END AS INT)",
    ),
    ("total_calories", f"CAST(CASE WHEN {K} % 53 = 0 THEN 100 ELSE 1500 + ({K} * 17) % 2500 END AS INT)"),
    ("active_calories", f"CAST(CASE WHEN {K} % 59 = 0 THEN 9000 ELSE ({K} * 17) % 900 END AS INT)"),
    ("avg_stress", f"CAST(CASE WHEN {K} % 11 = 0 THEN -1 ELSE 10 + ({K} * 3) % 70 END AS INT)"),
    ("max_stress", f"CAST(CASE WHEN {K} % 13 = 0 THEN -2 ELSE 30 + ({K} * 3) % 70 END AS INT)"),
    ("body_battery_start", f"CAST(({K} * 5) % 104 AS INT)"),
    ("body_battery_end", f"CAST(({K} * 11) % 103 - 1 AS INT)"),
    ("hrv_last_night", f"CAST(CASE WHEN {K} % 5 = 0 THEN NULL ELSE 20 + ({K} * 3) % 60 END AS INT)"),
    (
        "hrv_status",
        f"CASE {K} % 6 WHEN 1 THEN 'UNBALANCED' WHEN 2 THEN 'LOW' WHEN 3 THEN 'NONE' WHEN 4 THEN NULL ELSE 'BALANCED' END",
    ),
    ("avg_spo2", f"CAST(90 + {K} % 10 AS INT)"),
]

# Every order is an activity of the customer's nation.
ACTS = [
    ("profile_id", "c_nationkey"),
    ("activity_id", K),
    ("activity_name", f"concat('Activity number ', CAST({K} AS STRING), ' of customer ', c_name, ' with a rather long title')"),
    (
        "activity_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'treadmill_running' "
        "WHEN '3-MEDIUM' THEN 'cycling' WHEN '4-NOT SPECIFIED' THEN 'running' ELSE 'strength_training' END",
    ),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("start_time_local", "o_orderdate"),
    ("distance_m", f"CASE WHEN {K} % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS DOUBLE) END"),
    ("duration_sec", f"CAST(floor(o_totalprice / 10000 * (240 + {K} % 181)) AS DOUBLE)"),
    ("calories", f"CAST({K} % 900 AS INT)"),
    ("avg_hr", f"CAST(110 + {K} % 70 AS INT)"),
    ("training_effect", f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE CAST({K} % 50 AS DOUBLE) / 10 END"),
    ("training_load", f"CAST({K} % 300 AS DOUBLE)"),
    (
        "raw_json",
        f"CASE WHEN {K} % 41 = 0 THEN '{{bad' WHEN {K} % 3 < 2 THEN '{{\"eventType\":{{\"typeKey\":\"race\"}}}}' "
        "ELSE '{\"eventType\":{\"typeKey\":\"training\"}}' END",
    ),
]

PERFORMANCE = [
    ("profile_id", "c_nationkey"),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("ingest_seq", K),
    ("vo2max", f"CASE WHEN {K} % 3 = 0 THEN CASE WHEN {K} % 4 = 0 THEN NULL ELSE 35 + CAST({K} % 200 AS DOUBLE) / 10 END END"),
    ("training_readiness", f"CASE WHEN {K} % 3 = 0 THEN CAST(CASE WHEN {K} % 8 = 0 THEN NULL ELSE {K} % 100 END AS INT) END"),
    ("endurance_score", f"CASE WHEN {K} % 3 = 0 THEN CAST(5000 + {K} % 3000 AS INT) END"),
    ("race_5k_sec", f"CASE WHEN {K} % 3 = 0 THEN CAST(1100 + {K} % 400 AS INT) END"),
    ("race_10k_sec", f"CASE WHEN {K} % 3 = 0 THEN CAST(2400 + {K} % 800 AS INT) END"),
    ("race_half_sec", f"CASE WHEN {K} % 3 = 0 THEN CAST(CASE WHEN {K} % 2 = 0 THEN NULL ELSE 5400 + {K} % 1800 END AS INT) END"),
    ("race_marathon_sec", f"CASE WHEN {K} % 3 = 0 THEN CAST(11000 + {K} % 4000 AS INT) END"),
]

WEIGHT = [
    ("profile_id", "c_nationkey"),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("sample_pk", K),
    ("timestamp_gmt", f"concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T0', CAST({K} % 10 AS STRING), ':00:00')"),
    ("weight_kg", f"CASE WHEN {K} % 4 = 1 THEN CASE WHEN {K} % 9 = 0 THEN NULL ELSE 60 + CAST({K} % 300 AS DOUBLE) / 10 END END"),
    ("body_fat", f"CASE WHEN {K} % 4 = 1 THEN CASE WHEN {K} % 3 = 0 THEN NULL ELSE 10 + CAST({K} % 150 AS DOUBLE) / 10 END END"),
]

PRESSURE = [
    ("profile_id", "c_nationkey"),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("timestamp_gmt", f"concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T', CAST(100000 + {K} AS STRING))"),
    ("systolic", f"CASE WHEN {K} % 5 = 2 THEN CAST(105 + {K} % 40 AS INT) END"),
    ("diastolic", f"CASE WHEN {K} % 5 = 2 THEN CAST(60 + {K} % 30 AS INT) END"),
]

# A supplier's order lines of one year are the samples of one run.
RUN_ID = "l_suppkey * 10 + (year(l_shipdate) - 1995)"
SAMPLE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
SAMPLES = [
    ("activity_id", "activity_id"),
    ("row_pos", "row_pos"),
    ("elapsed_sec", "CAST(row_pos * 60 AS DOUBLE)"),
    (
        "heart_rate",
        "CAST(CASE WHEN l_linenumber = 3 AND l_quantity < 8 THEN 60 WHEN l_linenumber = 5 AND l_quantity > 48 THEN NULL "
        "ELSE floor(130 + (l_quantity - 25) * ((l_suppkey % 5) * 2 + 1) / 10) END AS INT)",
    ),
    ("speed", "CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN NULL ELSE 1.2e0 + l_quantity / 25 END"),
    ("altitude", "CASE WHEN l_linenumber = 6 THEN NULL ELSE 50 + l_extendedprice / 5000 END"),
    ("distance", "row_pos * 10 + l_discount * 100"),
    ("temperature", "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 5 + l_tax * 300 END"),
    ("cadence", "CAST(80 + l_linenumber AS INT)"),
    ("ground_contact_time", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 200 + l_quantity END"),
    ("stride_length", "90 + l_tax * 100"),
]
RUNS = [
    ("profile_id", "s_nationkey"),
    ("activity_id", "l_suppkey * 10 + (y - 1995)"),
    ("activity_name", "concat('Run of ', s_name)"),
    ("activity_type", "CASE l_suppkey % 6 WHEN 5 THEN 'cycling' WHEN 4 THEN 'treadmill_running' ELSE 'running' END"),
    ("distance_m", "qty * (2 + l_suppkey % 4)"),
    ("duration_sec", "CAST(n * 30 AS DOUBLE)"),
    ("training_effect", "CAST(l_suppkey % 50 AS DOUBLE) / 10"),
    ("start_lat", "CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE 40 + CAST(l_suppkey % 3 AS DOUBLE) / 1000 + CAST(y % 2 AS DOUBLE) / 5000 END"),
    ("start_lon", "CAST(l_suppkey % 2 AS DOUBLE) / 1000 - 75"),
    (
        "location_name",
        "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '\"null\"' ELSE concat('Place ', CAST(l_suppkey % 10 AS STRING)) END",
    ),
]
RUN_DAY_OFFSET = "CAST((l_suppkey * 37) % 365 AS INT)"

SPLITS = [
    ("activity_id", "l_orderkey"),
    ("split_number", "l_linenumber"),
    ("split_type", "CASE WHEN l_returnflag = 'A' THEN 'INTERVAL' ELSE 'REST' END"),
    ("distance_m", "l_quantity * 40"),
    ("duration_sec", "l_quantity * (10 + l_linenumber)"),
]


def select_list(cols: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in cols]
