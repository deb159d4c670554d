"""Q1 key and rule checks, Q2 free keys, D1 the state dimension.

Spark does not enforce keys, so the table constraints become a report:
one row per (table, rule) with the number of violations.

* primary/unique key: number of non-NULL key values held by more than
  one row; all key rules of all tables share one groupBy (tagged keys,
  partial aggregation); never a self-join;
* NOT NULL and CHECK: rows failing, all rules of a table in one pass;
* foreign key: non-NULL child keys missing from the parent (left_anti).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carledger.functions.fixed import CAR_STATES, STATUS_CLOSED, STATUS_OPEN
from carledger.schema import CAR_STATES as CAR_STATES_SCHEMA


def car_states(spark: SparkSession) -> DataFrame:
    """The fixed 3-row state dimension."""
    return spark.createDataFrame(CAR_STATES, CAR_STATES_SCHEMA)


def _one(df: DataFrame, table: str, rule: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     F.col("violations").cast("long").alias("violations"))


def key_checks(spark: SparkSession, checks: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Duplicate-key counts for many (table, rule, key column) checks at
    once: every table's keys are tagged with their rule and unioned, so one
    shuffle (with map-side partial counts) serves all rules. Result: number
    of non-NULL key values held by more than one row, 0 rows included."""
    tagged = None
    for df, table, rule, key in checks:
        t = df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                      F.col(key).cast("string").alias("k")).filter(F.col("k").isNotNull())
        tagged = t if tagged is None else tagged.unionByName(t)
    per_key = tagged.groupBy("table_name", "rule", "k").agg(F.count(F.lit(1)).alias("n"))
    dup = per_key.groupBy("table_name", "rule").agg(
        F.count(F.when(F.col("n") > 1, 1)).cast("long").alias("violations"))
    zeros = spark.createDataFrame([(t, r, 0) for _, t, r, _ in checks],
                                  "table_name string, rule string, violations long")
    return (dup.unionByName(zeros).groupBy("table_name", "rule")
            .agg(F.max("violations").alias("violations")))


def row_rules(df: DataFrame, table: str, rules: dict[str, F.Column]) -> DataFrame:
    """Rows failing each rule (a Column that is true when the row is bad),
    all counted in one aggregate, then unpivoted to one row per rule."""
    agg = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()])
    long = agg.unpivot([], list(rules), "rule", "violations")
    return long.select(F.lit(table).alias("table_name"), "rule",
                       F.col("violations").cast("long").alias("violations"))


def fk_missing(df: DataFrame, table: str, rule: str, key: str, parent: DataFrame, pkey: str) -> DataFrame:
    p = parent.select(F.col(pkey).alias(key))
    miss = df.select(key).filter(F.col(key).isNotNull()).join(p, key, "left_anti")
    return _one(miss.agg(F.count(F.lit(1)).alias("violations")), table, rule)


def any_null(*cols: str) -> F.Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def any_longer(**widths: int) -> F.Column:
    """A text wider than its column was declared."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in widths.items()])


def order_rules(orders: DataFrame) -> dict[str, F.Column]:
    return {"not_null": any_null(*orders.columns)}


def history_rules(history: DataFrame) -> dict[str, F.Column]:
    return {"not_null": any_null(*[c for c in history.columns if c != "note"]),
            "check_status": ~F.col("status").isin(STATUS_OPEN, STATUS_CLOSED),
            "widths": any_longer(note=100, v_user=10)}


def constraint_violations(states: DataFrame, cars: DataFrame, clients: DataFrame,
                          orders: DataFrame, history: DataFrame) -> DataFrame:
    spark = cars.sparkSession
    keys = key_checks(spark, [
        (states, "carstates", "pk_id", "id"),
        (states, "carstates", "unique_state", "state"),
        (cars, "cars", "pk_reg_num", "reg_num"),
        (clients, "clients", "pk_pass", "pass"),
        (orders, "orders", "pk_id", "id"),
        (orders, "orders", "unique_client_pass", "client_pass"),
        (orders, "orders", "unique_car_reg_num", "car_reg_num"),
        (history, "orders_history", "pk_id", "id"),
    ])
    parts = [
        keys,
        row_rules(states, "carstates", {"not_null": any_null("id", "state")}),
        row_rules(cars, "cars", {"not_null": any_null(*cars.columns),
                                 "widths": any_longer(reg_num=10, color=20, mark=20, type=20)}),
        fk_missing(cars, "cars", "fk_state_id", "state_id", states, "id"),
        row_rules(clients, "clients", {"not_null": any_null("pass", "name"), "widths": any_longer(**{"pass": 10, "name": 40})}),
        row_rules(orders, "orders", order_rules(orders)),
        fk_missing(orders, "orders", "fk_client_pass", "client_pass", clients, "pass"),
        fk_missing(orders, "orders", "fk_car_reg_num", "car_reg_num", cars, "reg_num"),
        row_rules(history, "orders_history", history_rules(history)),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def new_duplicates(table: DataFrame, batch: DataFrame, name: str, rule: str, key: str) -> DataFrame:
    """Key values that one row or none holds and more do with the batch.
    The table is first reduced to the batch's keys (its key column is all
    that is read); only what is left is counted."""
    new = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    held = table.select(key).join(new.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("held"))
    bad = (F.coalesce("held", F.lit(0)) <= 1) & (F.coalesce("held", F.lit(0)) + F.col("n") > 1)
    return _one(new.join(held, key, "left").agg(F.count(F.when(bad, 1)).alias("violations")), name, rule)


def batch_violations(cars: DataFrame, clients: DataFrame, orders: DataFrame, history: DataFrame,
                     new_orders: DataFrame, new_history: DataFrame) -> DataFrame:
    """What appending rows to orders and history adds to
    ``constraint_violations``, without a scan of whole tables: row rules see
    the batch alone, keys are counted where the batch has them."""
    parts = [new_duplicates(orders, new_orders, "orders", rule, key) for rule, key in
             (("pk_id", "id"), ("unique_client_pass", "client_pass"), ("unique_car_reg_num", "car_reg_num"))]
    parts += [
        new_duplicates(history, new_history, "orders_history", "pk_id", "id"),
        row_rules(new_orders, "orders", order_rules(new_orders)),
        row_rules(new_history, "orders_history", history_rules(new_history)),
        fk_missing(new_orders, "orders", "fk_client_pass", "client_pass", clients, "pass"),
        fk_missing(new_orders, "orders", "fk_car_reg_num", "car_reg_num", cars, "reg_num"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def free_keys(candidates: DataFrame, existing: DataFrame, key: str, existing_key: str) -> DataFrame:
    """Q2: distinct candidate keys that no existing row uses."""
    e = existing.select(F.col(existing_key).alias(key))
    return candidates.select(key).filter(F.col(key).isNotNull()).distinct().join(e, key, "left_anti")
