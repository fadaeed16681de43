"""Weekly overload risk: volume, intensity and physiological response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, warning_level
from ..operators.aggregates import weekly_health, weekly_intensity
from ..operators.clean import clean_daily
from ..operators.joins import full_join
from ..operators.windows import last_n, trailing
from .features import order_of

ZERO_FILLED = {"weekly_km": 0.0, "run_count": 0, "hard_runs": 0, "tl_sum": 0.0}
# column, weeks, minimum weeks, result
BASELINES = [
    ("rhr_avg", 8, 4, "rhr_8wk"),
    ("stress_avg", 8, 4, "stress_8wk"),
    ("sleep_avg", 8, 4, "sleep_8wk"),
    ("weekly_km", 4, 2, "km_4wk"),
    ("weekly_km", 8, 4, "km_8wk"),
]
DISPLAY_WEEKS = 12


def weekly_risk(health: DataFrame, intensity: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Health and running weeks side by side with baselines, deltas, load ratio and level.

    Baselines run over the weeks that are present.
    """
    by = list(by)
    weeks = full_join([health, intensity], [*by, "week"], ZERO_FILLED)
    with_base = weeks.withColumns({out: trailing(c, by, "week", n, "avg", need) for c, n, need, out in BASELINES})
    return with_base.withColumns(
        {
            "rhr_delta": F.col("rhr_avg") - F.col("rhr_8wk"),
            "stress_delta": F.col("stress_avg") - F.col("stress_8wk"),
            "sleep_delta": F.col("sleep_avg") - F.col("sleep_8wk"),
            "vol_acwr": safe_div(F.col("km_4wk"), F.col("km_8wk")),
        }
    ).withColumn(
        "level",
        warning_level(F.col("weekly_km"), F.col("hard_runs"), F.col("stress_delta"), F.col("rhr_delta"), F.col("vol_acwr")),
    )


def injury_report(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> dict[str, DataFrame]:
    raw = frames["daily_health"]
    daily = clean_daily(raw, by, order_of(raw, ["ingest_seq"]))
    weekly = weekly_risk(weekly_health(daily, by), weekly_intensity(frames["activities"], by), by)
    shown = last_n(weekly, by, ["week"], DISPLAY_WEEKS)
    return {
        "weekly": weekly,
        "shown": shown,
        "current": last_n(weekly, by, ["week"], 1),
        "any_warning": shown.groupBy(*by).agg(F.bool_or(F.col("level") != "").alias("any_warning")),
    }
