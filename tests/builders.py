"""Small hand-made frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


DAILY_DDL = (
    "profile_id INT, date DATE, ingest_seq BIGINT, resting_hr INT, sleep_seconds INT, steps INT, avg_stress INT, max_stress INT, "
    "total_calories INT, active_calories INT, body_battery_start INT, body_battery_end INT"
)
HEALTHY = dict(
    profile_id=1,
    date=day("2024-01-01"),
    ingest_seq=1,
    resting_hr=60,
    sleep_seconds=28800,
    steps=8000,
    avg_stress=35,
    max_stress=55,
    total_calories=2000,
    active_calories=500,
    body_battery_start=50,
    body_battery_end=50,
)


def daily(spark: SparkSession, *rows: dict) -> DataFrame:
    """daily_health rows; each dict overrides a healthy day, dates count up from 2024-01-01."""
    full = []
    for i, r in enumerate(rows):
        base = dict(HEALTHY, date=HEALTHY["date"] + dt.timedelta(days=i), ingest_seq=i)
        full.append(tuple({**base, **r}.values()))
    return spark.createDataFrame(full, DAILY_DDL)
