"""Reports kept up to date on append.

What the per-order and per-car reports need of the history can be merged:
counts, sums, least and largest values per order, and the pair table of
(order, client, car) spans for what is counted distinct. Every batch of
history rows is reduced to such rows and stored as a partition of its own; a
repeated batch overwrites itself. A report merges the stored rows, a few for
each order, and never reads the history again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carledger.functions.timefn import micros_between
from carledger.operators import reports as R

PER_ORDER = {"n": F.sum, "returned_lo": F.min, "returned_hi": F.max, "max_status": F.max, "closed_n": F.sum, "closed_sum": F.sum,
             "closed_min": F.min, "closed_max": F.max}


def order_state(history: DataFrame) -> DataFrame:
    closed = F.col("status") == R.STATUS_CLOSED
    price = F.when(closed, F.col("total_price"))
    return history.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("returned_at").alias("returned_lo"), F.max("returned_at").alias("returned_hi"),
        F.max("status").alias("max_status"), F.count(F.when(closed, 1)).alias("closed_n"), F.sum(price).alias("closed_sum"),
        F.min(price).alias("closed_min"), F.max(price).alias("closed_max"))


class RollingReports:
    """The merged state of all batches under a folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._schemas: dict = {}

    def append(self, batch: int, history: DataFrame) -> None:
        """Add a batch of history rows under its number."""
        for name, rows in (("orders", order_state(history)), ("spans", R.car_spans(history))):
            (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch").parquet(f"{self.root}/{name}"))
            self._schemas[name] = rows.schema

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop("batch")

    def orders(self) -> DataFrame:
        """One row per order over all batches, with its distinct cars."""
        merged = self._read("orders").groupBy("order_id").agg(*[f(c).alias(c) for c, f in PER_ORDER.items()])
        cars = self._read("spans").groupBy("order_id").agg(F.count_distinct("car_reg_num").alias("cars"))
        return merged.join(cars, "order_id")

    def spans(self) -> DataFrame:
        return self._read("spans").groupBy("order_id", "client_pass", "car_reg_num").agg(
            F.min("rented_at").alias("rented_at"), F.max("returned_at").alias("returned_at"))

    def compact(self, root: str) -> "RollingReports":
        """The same state in one batch, in another folder."""
        out = RollingReports(self.spark, root)
        merged = self._read("orders").groupBy("order_id").agg(*[f(c).alias(c) for c, f in PER_ORDER.items()])
        for name, rows in (("orders", merged), ("spans", self.spans())):
            rows.withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(f"{root}/{name}")
        return out

    def orders_changes(self) -> DataFrame:
        """R3."""
        o = self.orders()
        return R.changes_of(o.select("order_id", F.col("n").alias("changed_times"), F.col("cars").alias("used_cars"),
                                     "returned_lo", "returned_hi", "max_status"))

    def orders_changes_report(self, open_orders: DataFrame) -> DataFrame:
        """R4."""
        o = self.orders().withColumn("renew", micros_between("returned_hi", "returned_lo"))
        return R.changes_report_of(o, open_orders)

    def cars_report(self, cars: DataFrame, as_of) -> DataFrame:
        """R6."""
        return R.cars_report_of(self.spans(), cars, as_of)
