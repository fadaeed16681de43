"""Rollups, profiles, baselines and order statistics.

Everything here is a plain ``groupBy`` (partial aggregation before the exchange)
so a dominant entity costs one pre-aggregated record per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    CROSS_TRAIN_TYPES,
    RUNNING_TYPES,
    is_finite,
    type_in,
    week_start,
)
from .clean import class_contribution

# Columns of the profile
PROFILE_METRICS = [
    "resting_hr",
    "steps",
    "sleep_seconds",
    "sleep_score",
    "avg_stress",
    "avg_respiration",
    "avg_spo2",
    "lowest_spo2",
    "hrv_last_night",
    "hrv_weekly_avg",
    "body_battery_start",
    "body_battery_end",
    "vo2max",
    "fitness_age",
    "training_readiness",
    "endurance_score",
    "weight_kg",
    "bmi",
    "body_fat",
    "systolic",
    "diastolic",
    "pulse",
]


def sum0(c: Column) -> Column:
    """Sum that is 0.0 over nothing."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


# ------------------------------------------------------------------- rollups
def daily_load(acts: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Running and cross-training kilometres per entity and day."""
    km = F.col("distance_m").cast("double") / 1000.0
    return acts.groupBy(*by, d).agg(
        sum0(class_contribution(km, RUNNING_TYPES)).alias("distance_today_km"),
        sum0(class_contribution(km, CROSS_TRAIN_TYPES)).alias("cross_train_today_km"),
    )


def daily_rollup(acts: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Activity count, duration, distance, calories and peak load per day."""
    return acts.groupBy(*by, d).agg(
        F.count("activity_id").alias("activity_count"),
        sum0(F.col("duration_sec")).alias("activity_duration_sec"),
        sum0(F.col("distance_m")).alias("activity_distance_m"),
        sum0(F.col("calories")).alias("activity_calories"),
        F.max(F.col("training_load").cast("double")).alias("activity_training_load"),
    )


def last_row_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of each key's last row in ``order``, nulls included."""
    last = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def weekly_health(daily: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    return daily.groupBy(*by, week_start(d).alias("week")).agg(
        F.avg("resting_hr").alias("rhr_avg"),
        F.avg("avg_stress").alias("stress_avg"),
        F.avg("body_battery_start").alias("bb_start_avg"),
        F.avg(F.col("sleep_seconds") / 3600.0).alias("sleep_avg"),
        F.avg("hrv_last_night").alias("hrv_avg"),
    )


def weekly_intensity(acts: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Weekly running volume and intensity; ``run_count`` counts rows without a distance too."""
    te = F.col("training_effect").cast("double")
    return (
        acts.where(type_in(RUNNING_TYPES))
        .groupBy(*by, week_start(d).alias("week"))
        .agg(
            sum0(F.col("distance_m") / 1000.0).alias("weekly_km"),
            F.count(F.lit(1)).alias("run_count"),
            F.avg("avg_hr").alias("avg_hr_mean"),
            F.avg(te).alias("te_mean"),
            F.max(te).alias("te_max"),
            F.count_if(te >= 3.0).alias("hard_runs"),
            sum0(F.col("training_load")).alias("tl_sum"),
        )
    )


# ------------------------------------------------------------------- profiles
def summarize(df: DataFrame, d: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a date, first and last date."""
    aggs = [F.count(d).alias("row_count"), F.min(d).alias("min_date"), F.max(d).alias("max_date")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def profile(df: DataFrame, cols: Sequence[str] | None = None, metrics: Sequence[str] = PROFILE_METRICS) -> DataFrame:
    """One row per column: nulls, null share, and mean, min, max, non-null of the metric columns.

    A single aggregation over the table, turned on its side afterwards.
    """
    cols = list(cols or df.columns)
    rows = F.count(F.lit(1))
    aggs: list[Column] = [rows.alias("_rows")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"nn_{c}"))
        if c in metrics:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"mean_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    wide = df.agg(*aggs)
    none = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col(f"nn_{c}")).alias("null_count"),
            (F.try_divide(F.col("_rows") - F.col(f"nn_{c}"), F.col("_rows")) * 100.0).alias("null_pct"),
            F.col(f"nn_{c}").alias("non_null"),
            (F.col(f"mean_{c}") if c in metrics else none).alias("mean"),
            (F.col(f"min_{c}") if c in metrics else none).alias("min"),
            (F.col(f"max_{c}") if c in metrics else none).alias("max"),
        )
        for c in cols
    ]
    return wide.select(F.inline(F.array(*entries)))


def date_profile(df: DataFrame, d: str = "date", approximate: bool = False) -> DataFrame:
    """Date range and number of distinct dates, null counting as one value."""
    distinct = F.approx_count_distinct(d) if approximate else F.count_distinct(F.col(d))
    return df.agg(
        F.min(d).alias("min_date"),
        F.max(d).alias("max_date"),
        (distinct + F.coalesce(F.max(F.col(d).isNull().cast("int")), F.lit(0))).alias("unique_dates"),
    )


# ------------------------------------------------------------------ baselines
def baseline(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    as_of: Column,
    days: int = 90,
    min_n: int = 10,
    include_day: bool = True,
    d: str = "date",
) -> DataFrame:
    """Mean and population deviation per column over the ``days`` up to ``as_of``.

    ``as_of`` may be a literal or a column of ``df``. Both are null below
    ``min_n`` values.
    """
    window = baseline_window(as_of, days, include_day, d)
    return df.where(window).groupBy(*by).agg(*baseline_aggregates(cols, F.lit(True), min_n))


def baseline_window(as_of: Column, days: int = 90, include_day: bool = True, d: str = "date") -> Column:
    """Whether a row belongs to the baseline of ``as_of``."""
    age = F.datediff(as_of, F.col(d))
    return (age <= days) & (age >= 0 if include_day else age > 0)


def baseline_aggregates(cols: Sequence[str], window: Column, min_n: int = 10) -> list[Column]:
    """``<c>_mean`` and ``<c>_std`` over the rows inside ``window``, null below ``min_n`` values."""
    aggs = []
    for c in cols:
        x = F.when(window, F.col(c).cast("double"))
        enough = F.count(x) >= min_n
        aggs += [
            F.when(enough, F.avg(x)).alias(f"{c}_mean"),
            F.when(enough, F.stddev_pop(x)).alias(f"{c}_std"),
        ]
    return aggs


def band(c: Column, edges: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the half-open band [lo, hi) a value falls in."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in edges:
        out = out.when((c >= lo) & (c < hi), F.lit(label))
    return out


def band_means(
    df: DataFrame,
    by: Sequence[str],
    c: str,
    edges: Sequence[tuple[float, float, str]],
    values: Sequence[str],
    min_n: int = 5,
) -> DataFrame:
    """Means per band, only for bands with at least ``min_n`` rows."""
    return (
        df.withColumn("band", band(F.col(c), edges))
        .where(F.col("band").isNotNull())
        .groupBy(*by, "band")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
        .where(F.col("n") >= min_n)
    )


def monthly_volume(runs: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    return runs.groupBy(*by, F.trunc(d, "month").alias("month")).agg(
        sum0(F.col("distance_km")).alias("km"), F.count(F.lit(1)).alias("runs")
    )


def volume_percentile(months: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of months strictly below the entity's 30-day equivalent of ``vol_28d``."""
    return (
        months.join(current.select(*by, "vol_28d"), list(by))
        .groupBy(*by)
        .agg((100.0 * F.avg((F.col("km") < F.col("vol_28d") * 30.0 / 28.0).cast("double"))).alias("vol_pct"))
    )


def trailing_volumes(runs: DataFrame, by: Sequence[str], as_of: Column, d: str = "date", upper: bool = True) -> DataFrame:
    """Runs and kilometres in (as_of − k, as_of] for k = 7, 28, 56, 90, and days since the last run.

    ``upper=False`` leaves the window open to the right of ``as_of``.
    """
    age = F.datediff(as_of, F.col(d))
    past = (age >= 0) if upper else F.lit(True)
    km = F.coalesce(F.col("distance_km"), F.lit(0.0))

    def vol(k: int, skip: int = 0) -> Column:
        return sum0(F.when(past & (age < k) & (age >= skip) if skip else past & (age < k), km))

    last = F.max(F.when(age >= 0, F.col(d)))
    return runs.groupBy(*by).agg(
        vol(7).alias("km_7d"),
        F.count_if(past & (age < 7)).alias("runs_7d"),
        vol(28).alias("vol_28d"),
        F.count_if(past & (age < 28)).alias("runs_28d"),
        (F.count_if(past & (age < 28)) / 4.0).alias("runs_per_week"),
        F.coalesce(F.max(F.when(past & (age < 28), km)), F.lit(0.0)).alias("long_run_28d"),
        vol(56, 28).alias("vol_prev_28d"),
        vol(90).alias("vol_90d"),
        last.alias("last_run"),
        F.coalesce(F.datediff(F.max(as_of), last), F.lit(0)).alias("days_off"),
    )


def recovery_means(daily: DataFrame, by: Sequence[str], as_of: Column, days: int = 7, d: str = "date") -> DataFrame:
    return (
        daily.where((F.col(d) >= F.date_sub(as_of, days)) & (F.col(d) <= as_of))
        .groupBy(*by)
        .agg(
            F.avg("resting_hr").alias("recovery_rhr"),
            F.avg("hrv_last_night").alias("recovery_hrv"),
            (F.avg("sleep_seconds") / 3600.0).alias("recovery_sleep_hours"),
            F.avg("avg_stress").alias("recovery_stress"),
        )
    )


def weekly_history(runs: DataFrame, by: Sequence[str], as_of: Column, weeks: int = 8, d: str = "date") -> DataFrame:
    """Zero-filled kilometres of the Monday weeks before the current one (``week_back`` 1 = last week)."""
    back = F.floor(F.datediff(F.date_trunc("week", as_of).cast("date"), week_start(d)) / 7).cast("int")
    sums = (
        runs.withColumn("week_back", back)
        .where(F.col("week_back").between(1, weeks))
        .groupBy(*by, "week_back")
        .agg(sum0(F.col("distance_km")).alias("km"))
    )
    grid = runs.select(*by).distinct().withColumn("week_back", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return grid.join(sums, [*by, "week_back"], "left").fillna(0.0, ["km"])


def weekly_history_stats(history: DataFrame, by: Sequence[str], recent: int = 4) -> DataFrame:
    return history.groupBy(*by).agg(
        F.avg("km").alias("avg_weekly_km"),
        F.max(F.when(F.col("week_back") <= recent, F.col("km"))).alias("recent_max_km"),
    )


# ----------------------------------------------------------- records, contrast
def best_per(df: DataFrame, keys: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest metric per key; ``ties`` decide between equals."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(metric, *ties)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def extremes(df: DataFrame, by: Sequence[str], metric: str, label: str, ties: Sequence[str]) -> DataFrame:
    """Highest (last on ties) and lowest (first on ties) metric and their label."""
    return df.groupBy(*by).agg(
        F.max(metric).alias("best"),
        F.max_by(label, F.struct(metric, *ties)).alias("best_label"),
        F.min(metric).alias("worst"),
        F.min_by(label, F.struct(metric, *ties)).alias("worst_label"),
    )


def melt(df: DataFrame, keep: Sequence[str | Column], features: Sequence[str]) -> DataFrame:
    """Long form (…, feature, value) of double-typed feature columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(pairs))


def contrast(df: DataFrame, by: Sequence[str], features: Sequence[str], cls: str = "quality") -> DataFrame:
    """Mean of every feature over good and over bad rows, and their difference.

    Only groups that have both classes appear; missing values are left out.
    """
    both = (
        df.groupBy(*by)
        .agg(F.count_if(F.col(cls) == "good").alias("n_good"), F.count_if(F.col(cls) == "bad").alias("n_bad"))
        .where((F.col("n_good") > 0) & (F.col("n_bad") > 0))
    )
    means = (
        melt(df, [*by, cls], features)
        .groupBy(*by, "feature")
        .agg(
            F.avg(F.when(F.col(cls) == "good", F.col("value"))).alias("good_mean"),
            F.avg(F.when(F.col(cls) == "bad", F.col("value"))).alias("bad_mean"),
        )
        .withColumn("delta", F.col("good_mean") - F.col("bad_mean"))
    )
    return means.join(both, list(by))


def reject_counts(df: DataFrame, by: Sequence[str], reason: str = "reject_reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ order statistics
SLOTS_PER_OCTAVE = 128
SUB_SLOTS = 65_536


def _slots(c: Column) -> tuple[Column, Column]:
    """Two nested monotone slots of a double.

    The outer one is logarithmic (about 0.5 % wide, at most ~290 000 in all); the
    inner one divides it into 65 536 parts. Both follow the order of the values.
    """
    scaled = F.log2(F.abs(c)) * SLOTS_PER_OCTAVE
    outer = F.floor(scaled)
    inner = F.floor((scaled - outer) * SUB_SLOTS)
    magnitude = outer + 150_000
    zero = F.lit(0).cast("bigint")
    return (
        F.when(c > 0, magnitude).when(c < 0, -magnitude).otherwise(zero),
        F.when(c > 0, inner).when(c < 0, -inner).otherwise(zero),
    )


def _covering(counts: DataFrame, group: Sequence[str], slot: str) -> DataFrame:
    """Per group, the slot whose counts cover ``_rank``, and the rank inside it."""
    below = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(below), F.lit(0))
    return (
        counts.withColumn("_start", start)
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n")))
        .withColumn("_rank", F.col("_rank") - F.col("_start"))
        .drop("_start", "_n")
    )


def floor_rank_quantile(df: DataFrame, by: Sequence[str], c: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact ``sorted[⌊p·n⌋]`` of the finite values per entity.

    A radix-style selection: counts per monotone slot
    find the slot that holds the wanted rank, counts per sub-slot narrow it down,
    and only the values inside that sub-slot are told apart. Rows are counted, combined before
    the exchange, before anything is joined; no group is ever gathered or sorted whole, so
    one dominant entity, or one dominant value, is no hot spot. Persist ``df`` when
    it is expensive to compute.
    """
    by = list(by)
    outer, inner = _slots(F.col("_v"))
    values = df.select(*by, F.col(c).cast("double").alias("_v")).where(is_finite(F.col("_v")))
    values = values.withColumns({"_slot": outer, "_sub": inner})
    n = F.count(F.lit(1)).alias("_n")

    fine = values.groupBy(*by, "_slot", "_sub").agg(n)
    slots = fine.groupBy(*by, "_slot").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    wanted = F.array(*[F.struct(F.lit(q).alias("_q"), F.floor(F.col("_all") * F.lit(p)).alias("_rank")) for q, p in quantiles.items()])
    asked = slots.withColumn("_all", total).select(*by, "_slot", "_n", F.inline(wanted))
    hit = _covering(asked, [*by, "_q"], "_slot")
    hit = _covering(fine.join(hit, [*by, "_slot"]).select(*by, "_q", "_slot", "_sub", "_rank", "_n"), [*by, "_q"], "_sub")
    exact = values.groupBy(*by, "_slot", "_sub", "_v").agg(n)
    last = exact.join(hit, [*by, "_slot", "_sub"]).select(*by, "_q", "_v", "_rank", "_n")
    picked = _covering(last, [*by, "_q"], "_v")
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == q, F.col("_v"))).alias(q) for q in quantiles])
