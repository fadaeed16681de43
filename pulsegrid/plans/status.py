"""Coverage and profile of whatever entity tables are present."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import date_profile, profile, summarize
from ..sources.sinks import union_all

DATE_COLUMNS = {"activities": "start_time_local"}


def status(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, first and last date per dataset."""
    parts = []
    for name, df in frames.items():
        d = DATE_COLUMNS.get(name, "date")
        if d not in df.columns:
            continue
        s = summarize(df, d)
        parts.append(
            s.select(
                F.lit(name).alias("dataset"),
                "row_count",
                F.col("min_date").cast("date").alias("min_date"),
                F.col("max_date").cast("date").alias("max_date"),
            )
        )
    return union_all(parts)


def profile_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Column profile per dataset (one aggregation each) and the date range where there is one."""
    columns = union_all([profile(df).select(F.lit(n).alias("dataset"), "*") for n, df in frames.items()])
    dated = [date_profile(df).select(F.lit(n).alias("dataset"), "*") for n, df in frames.items() if "date" in df.columns]
    out = {"columns": columns}
    if dated:
        out["dates"] = union_all(dated)
    return out
