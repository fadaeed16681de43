"""The derived views as Spark frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_daily
from ..operators.windows import row_positions
from ..session import tune
from . import columns as C

BY = ["profile_id"]


class Frames:
    """Lazily built views over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = tune(spark)
        self.base = base.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    @cached_property
    def customer_orders(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey", "c_name")
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def daily_raw(self) -> DataFrame:
        return self.customer_orders.selectExpr(*C.select_list(C.DAILY_RAW))

    @cached_property
    def daily(self) -> DataFrame:
        return clean_daily(self.daily_raw, BY, ["ingest_seq"])

    @cached_property
    def acts(self) -> DataFrame:
        return self.customer_orders.selectExpr(*C.select_list(C.ACTS))

    @cached_property
    def performance(self) -> DataFrame:
        return self.customer_orders.selectExpr(*C.select_list(C.PERFORMANCE))

    @cached_property
    def weight(self) -> DataFrame:
        return self.customer_orders.selectExpr(*C.select_list(C.WEIGHT))

    @cached_property
    def pressure(self) -> DataFrame:
        return self.customer_orders.selectExpr(*C.select_list(C.PRESSURE))

    @cached_property
    def order_frames(self) -> dict[str, DataFrame]:
        """Entity tables derived from orders, as the report plans take them."""
        return {
            "daily_health": self.daily_raw,
            "activities": self.acts,
            "performance_metrics": self.performance,
            "weight": self.weight,
            "blood_pressure": self.pressure,
        }

    @cached_property
    def samples(self) -> DataFrame:
        lines = self.table("lineitem").withColumn("activity_id", F.expr(C.RUN_ID))
        placed = row_positions(lines, ["activity_id"], F.to_date("l_shipdate"), C.SAMPLE_ORDER)
        return placed.selectExpr(*C.select_list(C.SAMPLES))

    @cached_property
    def runs(self) -> DataFrame:
        per_year = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("y"))
            .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
        )
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey", "s_name")
        joined = per_year.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        day = F.date_add(F.make_date(F.col("y"), F.lit(1), F.lit(1)), F.expr(C.RUN_DAY_OFFSET))
        return joined.select(
            *[F.expr(e).alias(n) for n, e in C.RUNS], day.alias("date"), day.cast("timestamp_ntz").alias("start_time_local")
        )

    @cached_property
    def run_frames(self) -> dict[str, DataFrame]:
        """Entity tables of the per-sample reports."""
        return {"activities": self.runs, "activity_details": self.samples, "daily_health": self.daily_raw}

    @cached_property
    def splits(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*C.select_list(C.SPLITS))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("date", F.to_date("ts"))
