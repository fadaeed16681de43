"""The derived views as SQL text, for the equivalents that check the Spark plans."""

from __future__ import annotations

import re

from . import columns as C


def _cols(cols: list[tuple[str, str]]) -> str:
    return ",\n  ".join(C.select_list(cols))


VIEWS: dict[str, str] = {
    "customer_orders": "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey",
    "daily_raw": f"SELECT {_cols(C.DAILY_RAW)} FROM customer_orders",
    "ranged": """
        SELECT profile_id, date, ingest_seq,
          CASE WHEN resting_hr < 25 OR resting_hr > 200 THEN NULL ELSE resting_hr END AS resting_hr,
          CASE WHEN sleep_seconds <= 0 OR sleep_seconds > 57600 THEN NULL ELSE sleep_seconds END AS sleep_seconds,
          sleep_score,
          CASE WHEN steps < 0 OR steps > 200000 THEN NULL ELSE steps END AS steps,
          CASE WHEN total_calories < 500 OR total_calories > 10000 THEN NULL ELSE total_calories END AS total_calories,
          CASE WHEN active_calories < 0 OR active_calories > 8000 THEN NULL ELSE active_calories END AS active_calories,
          CASE WHEN avg_stress < 0 THEN NULL ELSE avg_stress END AS avg_stress,
          CASE WHEN max_stress < 0 THEN NULL ELSE max_stress END AS max_stress,
          CASE WHEN body_battery_start < 0 OR body_battery_start > 100 OR body_battery_end < 0 OR body_battery_end > 100
               THEN NULL ELSE body_battery_start END AS body_battery_start,
          CASE WHEN body_battery_start < 0 OR body_battery_start > 100 OR body_battery_end < 0 OR body_battery_end > 100
               THEN NULL ELSE body_battery_end END AS body_battery_end,
          hrv_last_night, hrv_status, avg_spo2
        FROM daily_raw""",
    "worn": "SELECT * FROM ranged WHERE resting_hr IS NOT NULL OR sleep_seconds IS NOT NULL OR steps > 0",
    "daily": """
        SELECT * FROM worn
        QUALIFY row_number() OVER (PARTITION BY profile_id, date ORDER BY ingest_seq DESC) = 1""",
    "acts": f"SELECT {_cols(C.ACTS)} FROM customer_orders",
    "run_like": "SELECT * FROM acts WHERE activity_type IN ('running', 'treadmill_running', 'virtual_run')",
    "performance": f"SELECT {_cols(C.PERFORMANCE)} FROM customer_orders",
    "weight": f"SELECT {_cols(C.WEIGHT)} FROM customer_orders",
    "pressure": f"SELECT {_cols(C.PRESSURE)} FROM customer_orders",
    "load_spine": """
        SELECT d.profile_id, d.date, resting_hr, avg_stress, sleep_seconds / 3600 AS sleep_hours_last_night,
          coalesce(r, 0) AS distance_today_km, coalesce(x, 0) AS cross_train_today_km
        FROM daily d LEFT JOIN (
          SELECT profile_id, date,
            sum(CASE WHEN activity_type IN ('running', 'treadmill_running', 'virtual_run') THEN distance_m / 1000 ELSE 0 END) AS r,
            sum(CASE WHEN activity_type = 'cycling' THEN distance_m / 1000 ELSE 0 END) AS x
          FROM acts GROUP BY 1, 2) a ON d.profile_id = a.profile_id AND d.date = a.date""",
    "ev": "SELECT *, CAST(ts AS DATE) AS date FROM events",
    "placed": f"""
        SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY {', '.join(C.SAMPLE_ORDER)}) - 1 AS row_pos
        FROM (SELECT *, {C.RUN_ID} AS activity_id FROM lineitem)""",
    "samples": f"SELECT {_cols(C.SAMPLES)} FROM placed",
    "runs": f"""
        SELECT {_cols(C.RUNS)},
          make_date(y, 1, 1) + {C.RUN_DAY_OFFSET} AS date,
          CAST(make_date(y, 1, 1) + {C.RUN_DAY_OFFSET} AS TIMESTAMP) AS start_time_local
        FROM (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ALL)
        JOIN supplier ON l_suppkey = s_suppkey""",
    "splits": f"SELECT {_cols(C.SPLITS)} FROM lineitem",
    # per-sample pipeline
    "smoothed": """
        SELECT *, coalesce(avg(altitude) OVER (PARTITION BY activity_id ORDER BY row_pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 0) AS alt
        FROM samples""",
    "deltas": """
        SELECT *, alt - lag(alt) OVER w AS dalt, distance - lag(distance) OVER w AS ddist
        FROM smoothed WINDOW w AS (PARTITION BY activity_id ORDER BY row_pos)""",
    "marked": """
        SELECT *, CASE WHEN steady THEN speed * greatest(155.4e0 * pow(g, 5) - 30.4e0 * pow(g, 4) - 43.3e0 * pow(g, 3) + 46.3e0 * pow(g, 2) + 19.5e0 * g + 3.6e0, 1) / 3.6e0 END AS gap_speed
        FROM (SELECT *, CASE WHEN steady THEN greatest(-0.45e0, least(0.45e0, dalt / ddist)) END AS g
              FROM (SELECT *, coalesce(elapsed_sec >= 300 AND speed >= 1.5 AND heart_rate >= 100 AND ddist >= 1, false) AS steady FROM deltas))""",
    "ce": """
        SELECT *, gap_speed / avg_hr AS ce_raw,
          coalesce(gap_speed / avg_hr + 0.000111e0 * (avg_temp - 20), gap_speed / avg_hr) AS ce
        FROM (
          SELECT activity_id, count(*) AS raw_rows, count(*) FILTER (steady) AS seconds_used,
            avg(gap_speed) FILTER (steady) AS gap_speed, avg(heart_rate) FILTER (steady) AS avg_hr,
            avg(temperature) FILTER (steady) AS avg_temp, avg(cadence) FILTER (steady) AS avg_cadence,
            avg(ground_contact_time) FILTER (steady) AS avg_gct, avg(stride_length) FILTER (steady) AS avg_stride,
            stddev_pop(heart_rate) FILTER (steady) / avg(heart_rate) FILTER (steady) * 100 AS hr_cv,
            arg_min(elapsed_sec, row_pos) FILTER (steady) AS first_elapsed,
            arg_max(elapsed_sec, row_pos) FILTER (steady) AS last_elapsed
          FROM marked GROUP BY activity_id)
        WHERE raw_rows >= 60 AND seconds_used >= 30""",
    "halves": """
        SELECT m.activity_id,
          count(*) FILTER (elapsed_sec < mid) AS n_first, count(*) FILTER (elapsed_sec >= mid) AS n_second,
          avg(m.gap_speed) FILTER (elapsed_sec < mid) AS g1, avg(m.gap_speed) FILTER (elapsed_sec >= mid) AS g2,
          avg(heart_rate) FILTER (elapsed_sec < mid) AS hr_h1, avg(heart_rate) FILTER (elapsed_sec >= mid) AS hr_h2
        FROM marked m JOIN (SELECT activity_id, (first_elapsed + last_elapsed) / 2 AS mid FROM ce WHERE seconds_used >= 60 AND hr_cv <= 8.5) USING (activity_id)
        WHERE steady GROUP BY m.activity_id""",
    "drift": """
        SELECT *,
          CASE WHEN skip_reason IS NULL THEN (g1 / hr_h1 - g2 / hr_h2) / (g1 / hr_h1) * 100 END AS decoupling_pct,
          CASE WHEN skip_reason IS NULL THEN (hr_h2 - hr_h1) / hr_h1 * 100 END AS hr_drift_pct
        FROM (SELECT ce.activity_id, seconds_used, hr_cv, avg_temp, n_first, n_second, g1, g2, hr_h1, hr_h2,
                CASE WHEN seconds_used < 60 THEN 'TooShort' WHEN hr_cv > 8.5 THEN 'IntervalWorkout'
                     WHEN n_first < 20 OR n_second < 20 THEN 'UnevenHalves' END AS skip_reason
              FROM ce LEFT JOIN halves USING (activity_id))""",
    "foot": "SELECT *, coalesce(distance_m, 0) / 1000 AS distance_km, coalesce(duration_sec, 0) / 60 AS duration_min FROM runs WHERE activity_type IN ('running', 'treadmill_running', 'virtual_run')",
    "eff": "SELECT * FROM foot JOIN ce USING (activity_id)",
    "drifted": """
        SELECT profile_id, activity_id, date, start_time_local, distance_m / 1000 AS distance_km, seconds_used, hr_cv, avg_temp,
          n_first, n_second, hr_h1, hr_h2, decoupling_pct, hr_drift_pct,
          CASE WHEN seconds_used IS NULL THEN 'TooShort' ELSE skip_reason END AS skip_reason
        FROM (SELECT * FROM foot WHERE distance_m > 5000) f LEFT JOIN drift USING (activity_id)
        WHERE activity_id IN (SELECT activity_id FROM samples)""",
    "dr": "SELECT * FROM drifted WHERE skip_reason IS NULL",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needs(text: str, found: list[str], open_: tuple[str, ...] = ()) -> None:
    for word in dict.fromkeys(_WORD.findall(text)):
        if word in VIEWS and word not in found and word not in open_:
            _needs(VIEWS[word], found, (*open_, word))
            if word not in found:
                found.append(word)


def with_views(sql: str) -> str:
    """Prefix a statement with the views it refers to, in dependency order."""
    found: list[str] = []
    _needs(sql, found)
    if not found:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in found)
    return f"WITH {head}\n{sql}"
