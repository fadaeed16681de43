"""Recurring routes and the form shown on each of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import ce_marker, clean_place
from ..operators.clean import plausible_runs
from ..operators.geo import leader_routes
from ..operators.joins import place_names
from ..operators.steady import MAX_HR_CV_PCT, mark_steady, run_ce, runs_with_ce
from ..operators.windows import last_n
from ..session import keep
from .fitness import running

# Fixed values
MIN_ROUTE_RUNS = 5
RECENT_DAYS = 90
RECENT_ON_ROUTE = 5
ORDER = ["start_time_local", "activity_id"]


def steady_gps_runs(frames: Mapping[str, DataFrame], by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Steady running activities above 3 km with a GPS start and efficiency figures."""
    acts = plausible_runs(running(frames["activities"]), above_distance_m=3000.0, need_start=True)
    acts = acts.select(*by, "activity_id", "date", "start_time_local", "distance_m", "duration_sec", "start_lat", "start_lon", "location_name")
    details = frames["activity_details"].join(acts.select("activity_id"), "activity_id", "left_semi")
    return keep(runs_with_ce(acts, run_ce(mark_steady(details))).where(F.col("hr_cv") <= MAX_HR_CV_PCT))


def route_stats(
    assigned: DataFrame, as_of: Column | None, by: Sequence[str] = ("profile_id",), places: DataFrame | None = None
) -> DataFrame:
    """One row per route with at least five runs; ``as_of=None`` keeps routes without recent runs."""
    key = [*by, "route_id"]
    lead = F.col("activity_id") == F.col("route_id")
    named = F.when(clean_place("location_name").isNotNull(), F.struct(*ORDER))
    per_route = assigned.groupBy(*key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("ce").alias("mean_ce"),
        F.max("ce").alias("best_ce"),
        F.max(F.when(lead, F.col("start_lat"))).alias("start_lat"),
        F.max(F.when(lead, F.col("start_lon"))).alias("start_lon"),
        F.min_by(clean_place("location_name"), named).alias("location_name"),
    )
    kept = per_route.where(F.col("runs") >= MIN_ROUTE_RUNS)
    if as_of is not None:
        kept = kept.where(F.col("last_date") >= F.date_sub(as_of, RECENT_DAYS))
    recent = last_n(assigned, key, ORDER, RECENT_ON_ROUTE).groupBy(*key).agg(F.avg("ce").alias("recent_ce"))
    scored = assigned.select(*key, "ce").join(recent, key).groupBy(*key).agg(
        F.max("recent_ce").alias("recent_ce"), stats.percentile_of(F.col("ce"), F.col("recent_ce")).alias("percentile")
    )
    out = kept.join(scored, key).withColumn("marker", ce_marker(F.col("recent_ce"), F.col("mean_ce")))
    if places is not None:
        return place_names(out, places)
    return out.withColumn("place", F.coalesce("location_name", F.lit("Unknown")))


def route_years(assigned: DataFrame, by: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Yearly mean efficiency of each route."""
    return assigned.groupBy(*by, "route_id", F.year("date").alias("year")).agg(
        F.avg("ce").alias("ce"), F.count(F.lit(1)).alias("runs")
    )


def routes_report(
    frames: Mapping[str, DataFrame],
    as_of: Column | None,
    by: Sequence[str] = ("profile_id",),
    places: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Routes of the runs up to ``as_of``; without it, of all runs."""
    by = list(by)
    if as_of is not None:
        frames = {**frames, "activities": frames["activities"].where(F.col("date") <= as_of)}
    runs = steady_gps_runs(frames, by)
    assigned = keep(leader_routes(runs, by, ORDER))
    routes = keep(route_stats(assigned, as_of, by, places))
    shown = assigned.join(routes.select(*by, "route_id"), [*by, "route_id"], "left_semi")
    return {
        "assigned": assigned,
        "routes": routes.orderBy(F.desc("runs"), *by, "route_id"),
        "years": route_years(shown, by),
        "recent": last_n(shown, [*by, "route_id"], ORDER, RECENT_ON_ROUTE),
    }
