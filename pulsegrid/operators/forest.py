"""Random-forest forecasting: fit, expanding-window validation, importance, forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import durable
from .trees import ForestModel, Settings, cross_validate
from .windows import day_order, last_n, tail_fraction

# Per-target source column and rows ahead.
TARGETS = {
    "next_day_resting_hr": ("resting_hr", 1),
    "next_day_sleep_hours": ("sleep_hours", 1),
    "next_day_steps": ("steps", 1),
    "next_day_hrv": ("hrv_last_night", 1),
}


def target_source(target: str) -> tuple[str, int]:
    if target not in TARGETS:
        raise KeyError(f"unknown target {target!r}; choose from {', '.join(TARGETS)}")
    return TARGETS[target]


def metrics_frame(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² of predictions, pooled or per entity."""
    yc, pc = F.col(y), F.col(p)
    aggs = [
        F.count(pc).alias("n"),
        stats.mae(yc, pc).alias("mae"),
        stats.rmse(yc, pc).alias("rmse"),
        stats.r_squared(yc, pc).alias("r_squared"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def calendar_folds(df: DataFrame, d: str = "date", start: int = 30, step: int = 7) -> DataFrame:
    """(d, fold, first, trained_until) of every day that occurs: expanding-window test folds on the calendar of all entities.

    Fold f tests ``step`` days and trains on every entity's rows before its ``first`` day (the newest are of
    ``trained_until``), so nothing later than a test day is ever learnt from. All three are null
    for the first ``start`` days and an incomplete tail.
    """
    # one row per day: bounded by the calendar
    days = df.select(d).distinct().withColumns({"_i": F.row_number().over(Window.orderBy(d)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    fold = F.floor((F.col("_i") - start) / step).cast("int")
    days = days.select(d, F.lag(d).over(Window.orderBy(d)).alias("_before"), F.when((F.col("_i") >= start) & (start + step * (fold + 1) <= F.col("_n")), fold).alias("fold"))
    at = Window.partitionBy("fold")
    tested = F.col("fold").isNotNull()
    return days.select(d, "fold", F.when(tested, F.min(d).over(at)).alias("first"), F.when(tested, F.min("_before").over(at)).alias("trained_until"))


def cv_baselines(
    df: DataFrame, target: str, source: str | None, by: Sequence[str], d: str = "date", start: int = 30, step: int = 7
) -> DataFrame:
    """Persistence and mean predictions of the rows that ``time_series_cv`` predicts, on the same folds (day grain).

    The mean baseline is the mean target of the entity's rows before the fold's first day, or of all
    entities' rows before it where the entity has none.
    """
    folds = calendar_folds(df, d, start, step)
    # one row per day and per fold: bounded by the calendar
    before = Window.orderBy(d).rowsBetween(Window.unboundedPreceding, -1)
    per_day = df.groupBy(d).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
    overall = per_day.select(F.col(d).alias("first"), (F.sum("_s").over(before) / F.sum("_c").over(before)).alias("_all"))
    w = day_order(by, d).rowsBetween(Window.unboundedPreceding, -1)
    running = df.withColumns({"_sum": F.sum(target).over(w), "_cnt": F.count(target).over(w)})
    folded = running.join(folds.where("fold IS NOT NULL").join(overall, "first"), d)
    at_start = Window.partitionBy(*by, "fold").orderBy(d)
    own = F.try_divide(F.first("_sum").over(at_start), F.first("_cnt").over(at_start))
    persistence = F.col(source).cast("double") if source and source in df.columns else F.lit(None).cast("double")
    out = folded.withColumns({"mean_pred": F.coalesce(own, "_all"), "persistence_pred": persistence})
    return out.drop("_sum", "_cnt", "_all", "first", "trained_until")


def baseline_metrics(predicted: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of both baselines in long form; persistence only where it was predicted."""
    pairs = F.array(
        F.struct(F.lit("mean").alias("model"), F.col("mean_pred").alias("p")),
        F.struct(F.lit("persistence").alias("model"), F.col("persistence_pred").alias("p")),
    )
    long = predicted.select(*by, F.col(target).alias("_y"), F.inline(pairs)).where(F.col("p").isNotNull())
    return metrics_frame(long, "_y", "p", [*by, "model"])


def time_series_cv(
    df: DataFrame,
    feats: Sequence[str],
    target: str,
    by: Sequence[str],
    d: str = "date",
    start: int = 30,
    step: int = 7,
    settings: Settings = Settings(),
    row: Column | None = None,
) -> DataFrame:
    """Out-of-fold forest predictions for every complete fold, with the last day each was trained on.

    All folds' forests are grown together (see ``trees``). ``row`` is a number that names a row; by
    default a hash of entity and day. Raises when no fold is complete.
    """
    df = df.select(*by, d, *feats, target)
    folds = durable(calendar_folds(df, d, start, step))
    spans = folds.where("fold IS NOT NULL").groupBy("fold").agg(F.datediff(F.min("first"), F.lit("1970-01-01")).alias("first")).collect()
    if not spans:
        raise ValueError("not enough rows for cross-validation")
    first = {r["fold"]: r["first"] for r in spans}
    day = F.datediff(F.col(d), F.lit("1970-01-01"))
    found = cross_validate(df.join(folds.select(d, "fold"), d), feats, target, [*by, d, target], day, F.col("fold"), first, settings, F.xxhash64(*by, d) if row is None else row)
    return found.join(F.broadcast(folds.where("fold IS NOT NULL").select("fold", "trained_until").distinct()), "fold")


def permutation_importance(
    model: ForestModel,
    df: DataFrame,
    target: str,
    by: Sequence[str],
    d: str = "date",
    seed: int = 12_648_430,
    order: Column | None = None,
) -> DataFrame:
    """Rise of the MAE when a feature is shuffled within its entity, largest first.

    Every evaluation row is paired with another row of its entity by hash order (``order`` if given);
    all features are scored in one pass over rows x features.
    """
    feats = model.features
    shuffle = F.xxhash64(F.lit(seed), F.col(d)) if order is None else order
    natural = F.row_number().over(Window.partitionBy(*by).orderBy(d))
    shuffled = F.row_number().over(Window.partitionBy(*by).orderBy(shuffle, d))
    vector = F.array(*[F.col(f).cast("double") for f in feats])
    base = df.select(*by, d, F.col(target).alias("_y"), vector.alias("_x"), shuffled.alias("_sn"))
    left = base.withColumn("_rn", natural).drop("_sn")
    right = base.select(*by, F.col("_x").alias("_other"), F.col("_sn").alias("_rn"))
    paired = left.join(right, [*by, "_rn"])

    def swapped(i: int):
        return F.transform(F.col("_x"), lambda v, k: F.when(k == i, F.get(F.col("_other"), k)).otherwise(v))

    variants = [F.struct(F.lit("").alias("feature"), F.col("_x").alias("_v"))]
    variants += [F.struct(F.lit(f).alias("feature"), swapped(i).alias("_v")) for i, f in enumerate(feats)]
    long = paired.select("_y", F.inline(F.array(*variants)))
    long = long.select(F.col("feature").alias("_feature"), "_y", *[F.get("_v", F.lit(i)).alias(f) for i, f in enumerate(feats)])
    scored = model.predict(long)
    errors = scored.groupBy(F.col("_feature").alias("feature")).agg(F.avg(F.abs(F.col("_y") - F.col("prediction"))).alias("mae"))
    # one record per feature: gathered into a single row to subtract the unshuffled error
    per_feature = F.collect_list(F.struct("feature", "mae"))
    base_mae = F.max(F.when(F.col("feature") == "", F.col("mae")))
    return (
        errors.agg(per_feature.alias("_all"), base_mae.alias("_base"))
        .select("_base", F.inline("_all"))
        .where(F.col("feature") != "")
        .select("feature", (F.col("mae") - F.col("_base")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def importance_tail(df: DataFrame, by: Sequence[str], d: str = "date", fraction: float = 0.2) -> DataFrame:
    """The slice importance is measured on: each entity's last 20 % of rows."""
    return tail_fraction(df, by, d, fraction)


def latest_rows(df: DataFrame, feats: Sequence[str], by: Sequence[str], d: str = "date") -> DataFrame:
    """Each entity's newest row with all features present."""
    return last_n(df.dropna(subset=list(feats)), by, [d], 1).select(*by, d, *feats)


def forecast(model: ForestModel, rows: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Prediction for the day after each row's date."""
    return model.predict(rows).select(
        *by, F.col(d).alias("feature_date"), F.date_add(d, 1).alias("forecast_date"), "prediction"
    )
