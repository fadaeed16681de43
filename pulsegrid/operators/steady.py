"""Per-second series: steady rows, cardiac efficiency and drift.

Input is one row per sample with ``row_pos`` (0-based, gap-free per activity).
Samples are framed in position blocks, so a single endless recording is spread
over many tasks; the per-activity results are ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import adjusted_ce, gap_speed
from ..functions.stats import cv_pct
from ..session import durable
from .windows import CORE, centred_mean, lag_in_block, with_halo

# Fixed values
WARMUP_S = 300.0
MIN_SPEED = 1.5
MIN_HR = 100.0
MIN_STEP_M = 1.0
MIN_RAW_ROWS = 60
MIN_STEADY_ROWS = 30
MIN_DRIFT_ROWS = 60
MIN_HALF_ROWS = 20
MAX_HR_CV_PCT = 8.5
SMOOTH_HALF = 7

KEY = ["activity_id"]


def mark_steady(details: DataFrame, key: Sequence[str] = KEY, pos: str = "row_pos", block: int = 4096) -> DataFrame:
    """All samples with ``steady`` (bool) and ``gap_speed``.

    Altitude is smoothed over ±7 samples; distance and smoothed altitude are
    compared with the previous raw sample before any filtering.
    """
    key = list(key)
    framed = with_halo(details, pos, block, before=SMOOTH_HALF + 1, after=SMOOTH_HALF)
    smooth = framed.withColumn("_alt", centred_mean("altitude", key, pos, SMOOTH_HALF)).withColumns(
        {
            "_dalt": F.col("_alt") - lag_in_block("_alt", key, pos),
            "_ddist": F.col("distance") - lag_in_block("distance", key, pos),
        }
    )
    steady = (
        (F.col("elapsed_sec") >= WARMUP_S)
        & (F.col("speed") >= MIN_SPEED)
        & (F.col("heart_rate") >= MIN_HR)
        & (F.col("_ddist") >= MIN_STEP_M)
    )
    return (
        smooth.where(F.col(CORE))
        .withColumn("steady", F.coalesce(steady, F.lit(False)))
        .withColumn(
            "gap_speed",
            F.when(F.col("steady"), gap_speed(F.col("speed"), F.try_divide(F.col("_dalt"), F.col("_ddist")))),
        )
        .drop("_alt", "_dalt", "_ddist", "_blk", CORE)
    )


def run_ce(marked: DataFrame, key: Sequence[str] = KEY, pos: str = "row_pos") -> DataFrame:
    """One row per activity with at least 60 samples and 30 steady ones.

    Dynamics columns the samples do not carry come out as null.
    """
    ok = F.col("steady")

    def mean(c: str) -> Column:
        if c not in marked.columns:
            return F.first(F.lit(None).cast("double"))
        return F.avg(F.when(ok, F.col(c).cast("double")))

    when_steady = F.when(ok, F.col(pos))
    hr = F.when(ok, F.col("heart_rate").cast("double"))
    return (
        marked.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("raw_rows"),
            F.count_if(ok).alias("seconds_used"),
            F.avg("gap_speed").alias("gap_speed"),
            F.avg(hr).alias("avg_hr"),
            mean("temperature").alias("avg_temp"),
            mean("cadence").alias("avg_cadence"),
            mean("ground_contact_time").alias("avg_gct"),
            mean("stride_length").alias("avg_stride"),
            cv_pct(hr).alias("hr_cv"),
            F.min_by("elapsed_sec", when_steady).alias("first_elapsed"),
            F.max_by("elapsed_sec", when_steady).alias("last_elapsed"),
        )
        .where((F.col("raw_rows") >= MIN_RAW_ROWS) & (F.col("seconds_used") >= MIN_STEADY_ROWS))
        .withColumn("ce_raw", F.col("gap_speed") / F.col("avg_hr"))
        .withColumn("ce", adjusted_ce(F.col("gap_speed"), F.col("avg_hr"), F.col("avg_temp")))
    )


def steady_rows(details: DataFrame, key: Sequence[str] = KEY, pos: str = "row_pos") -> DataFrame:
    """Steady samples of the activities that pass the row guards."""
    marked = mark_steady(details, key, pos)
    return marked.where("steady").join(run_ce(marked, key, pos).select(*key), list(key), "left_semi")


def drift_skip_reason(steady_n: Column, hr_cv: Column, n_first: Column, n_second: Column) -> Column:
    """Why an activity has no drift figure; null when it has one. Checked in this order."""
    return (
        F.when(F.coalesce(steady_n, F.lit(0)) < MIN_DRIFT_ROWS, F.lit("TooShort"))
        .when(hr_cv > MAX_HR_CV_PCT, F.lit("IntervalWorkout"))
        .when(
            (F.coalesce(n_first, F.lit(0)) < MIN_HALF_ROWS) | (F.coalesce(n_second, F.lit(0)) < MIN_HALF_ROWS),
            F.lit("UnevenHalves"),
        )
    )


DRIFT_COLUMNS = ["elapsed_sec", "heart_rate", "temperature", "gap_speed", "steady"]


def drift_samples(details: DataFrame, key: Sequence[str] = KEY, pos: str = "row_pos") -> DataFrame:
    """Marked samples with the columns that drift needs, as a written table: samples are numbered, smoothed and marked once."""
    return durable(mark_steady(details, key, pos).select(*key, pos, *DRIFT_COLUMNS))


def drift_from_details(details: DataFrame, key: Sequence[str] = KEY, pos: str = "row_pos") -> DataFrame:
    """Drift per activity straight from its samples.

    Two passes are needed (the middle of a run is known only after the first); both read the written samples.
    """
    marked = drift_samples(details, key, pos)
    return run_drift(marked, run_ce(marked, key, pos), key)


def run_drift(marked: DataFrame, runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Drift between the halves of each run, with ``skip_reason`` where there is none.

    ``runs`` is the output of :func:`run_ce`. The second pass reads only steady
    samples of eligible runs; a very long run is split by adaptive skew handling
    (``forceOptimizeSkewedJoin``), as the other join side has one row per activity.
    """
    key = list(key)
    eligible = runs.where((F.col("seconds_used") >= MIN_DRIFT_ROWS) & (F.col("hr_cv") <= MAX_HR_CV_PCT))
    middle = eligible.select(*key, ((F.col("first_elapsed") + F.col("last_elapsed")) / 2.0).alias("_mid"))
    h1 = F.col("elapsed_sec") < F.col("_mid")
    h2 = F.col("elapsed_sec") >= F.col("_mid")
    hr = F.col("heart_rate").cast("double")
    halves = (
        marked.where("steady")
        .select(*key, "elapsed_sec", "gap_speed", "heart_rate")
        .join(middle, key)
        .groupBy(*key)
        .agg(
            F.count_if(h1).alias("n_first"),
            F.count_if(h2).alias("n_second"),
            F.avg(F.when(h1, F.col("gap_speed"))).alias("gap_h1"),
            F.avg(F.when(h2, F.col("gap_speed"))).alias("gap_h2"),
            F.avg(F.when(h1, hr)).alias("hr_h1"),
            F.avg(F.when(h2, hr)).alias("hr_h2"),
        )
    )
    ce1, ce2 = F.col("gap_h1") / F.col("hr_h1"), F.col("gap_h2") / F.col("hr_h2")
    scored = (
        runs.select(*key, "seconds_used", "hr_cv", "avg_temp")
        .join(halves, key, "left")
        .withColumn(
            "skip_reason",
            drift_skip_reason(F.col("seconds_used"), F.col("hr_cv"), F.col("n_first"), F.col("n_second")),
        )
    )
    kept = F.col("skip_reason").isNull()
    return scored.withColumns(
        {
            "decoupling_pct": F.when(kept, (ce1 - ce2) / ce1 * 100.0),
            "hr_drift_pct": F.when(kept, (F.col("hr_h2") - F.col("hr_h1")) / F.col("hr_h1") * 100.0),
        }
    ).drop("gap_h1", "gap_h2")


def runs_with_ce(activities: DataFrame, ce: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Run-level frame: activity columns, kilometres, minutes and cardiac efficiency."""
    return (
        activities.withColumns(
            {
                "distance_km": F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0,
                "duration_min": F.coalesce(F.col("duration_sec"), F.lit(0.0)) / 60.0,
            }
        )
        .join(ce, list(key))
    )
