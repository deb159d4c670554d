"""Reports over the fleet tables.

Plan choices made by hand (Catalyst does not make them):

* DISTINCT over whole-partition windows becomes one ``groupBy`` with
  partial aggregation (cars_rents, cars_history_export).
* The N:M self-join of the client report becomes per-side aggregates:
  revenue = (history rows of the client) x (sum of its closed prices).
* ``cars`` is joined once, after the history is aggregated, and carries
  price and service date; whether the join broadcasts is AQE's runtime
  decision (size-checked), otherwise it is a shuffle join.
* State names come from a broadcast join with the 3-row state table.

Money is exact: durations are integer microseconds, prices integer cents,
products are summed and divided once, then rounded half away from zero.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carledger.functions.exact import (
    as_int, cents, exact_days_money, money_of_price_days, ratio_decimal,
)
from carledger.functions.fixed import CHANGE_STATUS, EXPORT_STATUS, STATUS_CLOSED
from carledger.functions.timefn import MICROS_PER_DAY, fmt17, micros_between, ts_diff
from carledger.plans.joins import materialize, with_state_name
from carledger.session import shuffle_parts


def _ts(v) -> F.Column:
    if isinstance(v, datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(v).cast("timestamp_ntz")


def _label(col: str, labels: dict) -> F.Column:
    out = None
    for code, text in labels.items():
        out = (F.when if out is None else out.when)(F.col(col) == code, F.lit(text))
    return out


# R1 ---------------------------------------------------------------------

def orders_history_export(history: DataFrame) -> DataFrame:
    """History rows with export names and 17-character times, by rented_at."""
    return history.orderBy("rented_at", "id").select(
        "id",
        F.col("order_id").alias("order id"),
        fmt17("changed_at").alias("changed at"),
        F.col("client_pass").alias("client"),
        F.col("car_reg_num").alias("reg number of car"),
        fmt17("rented_at").alias("rented at"),
        fmt17("returned_at").alias("returned at"),
        _label("status", {"1": EXPORT_STATUS["1"], "0": EXPORT_STATUS["0"]}).alias("status"),
        F.col("total_price").alias("total"),
        "note",
        "v_user",
    )


# R5 / R2 ------------------------------------------------------------------

def car_spans(history: DataFrame) -> DataFrame:
    """One row per (order, client, car): first rented_at, last returned_at."""
    return history.groupBy("order_id", "client_pass", "car_reg_num").agg(
        F.min("rented_at").alias("rented_at"), F.max("returned_at").alias("returned_at"))


def _spans_priced(history: DataFrame, cars: DataFrame, extra=()) -> DataFrame:
    c = cars.select(F.col("reg_num").alias("car_reg_num"), "price", *extra)
    return car_spans(history).join(c, "car_reg_num").withColumn(
        "span_micros", micros_between("returned_at", "rented_at"))


def cars_rents(history: DataFrame, cars: DataFrame) -> DataFrame:
    """Per (car, order, client): span, days rented and revenue at the
    car's current price. History of cars no longer in ``cars`` is dropped."""
    s = _spans_priced(history, cars)
    return s.select(
        "car_reg_num", "order_id", "client_pass", "rented_at", "returned_at",
        (F.col("span_micros") / F.lit(float(MICROS_PER_DAY))).alias("rented_time"),
        exact_days_money("span_micros", "price", 6).alias("revenue"),
    )


def cars_history_export(history: DataFrame, cars: DataFrame) -> DataFrame:
    """R2: R5 for export: 17-character times, ordered by order id."""
    s = _spans_priced(history, cars)
    return s.orderBy("order_id", "client_pass", "car_reg_num").select(
        "car_reg_num", "order_id", "client_pass",
        fmt17("rented_at").alias("rented_at"), fmt17("returned_at").alias("returned_at"),
        exact_days_money("span_micros", "price", 6).alias("revenue"),
    )


# R6 ---------------------------------------------------------------------

def cars_report(history: DataFrame, cars: DataFrame, as_of) -> DataFrame:
    """Per rented car: orders, clients, revenue, days in rent, and days
    since the last service at ``as_of`` (all rounded to 2 places)."""
    return cars_report_of(car_spans(history), cars, as_of)


def cars_report_of(spans: DataFrame, cars: DataFrame, as_of) -> DataFrame:
    """``cars_report`` from the spans of (order, client, car)."""
    s = spans.withColumn("span_micros", micros_between("returned_at", "rented_at"))
    # Price and service date belong to the car, so spans are summed per car
    # first and cars join one row each.
    per_car = s.groupBy("car_reg_num").agg(
        F.count_distinct("order_id").alias("orders_num"),
        F.count_distinct("client_pass").alias("clients_num"),
        F.sum(as_int("span_micros")).alias("micros"))
    c = cars.select(F.col("reg_num").alias("car_reg_num"), "price", "tech_serv_date")
    g = per_car.join(c, "car_reg_num").withColumn("cents_micros", F.col("micros") * cents("price"))
    return g.select(
        F.col("car_reg_num").alias("reg_num"), "orders_num", "clients_num",
        money_of_price_days(F.col("cents_micros"), 2).alias("total_revenue"),
        ratio_decimal(F.col("micros"), F.lit(MICROS_PER_DAY), 2).alias("total_rented_time"),
        ratio_decimal(micros_between(_ts(as_of), "tech_serv_date"), F.lit(MICROS_PER_DAY), 2)
        .alias("days_since_service"),
    )


# R3 / R4 ----------------------------------------------------------------

def orders_changes(history: DataFrame) -> DataFrame:
    """Per order: number of changes, distinct cars, renewed days
    (last minus first returned_at) and open/closed."""
    g = history.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("changed_times"),
        F.count_distinct("car_reg_num").alias("used_cars"),
        F.min("returned_at").alias("returned_lo"), F.max("returned_at").alias("returned_hi"),
        F.max("status").alias("max_status"),
    )
    return changes_of(g)


def changes_of(g: DataFrame) -> DataFrame:
    """``orders_changes`` from one row per order."""
    return g.select("order_id", "changed_times", "used_cars", ts_diff("returned_hi", "returned_lo").alias("renews_on"),
                    _label("max_status", {"1": CHANGE_STATUS["1"], "0": CHANGE_STATUS["0"]})
                    .alias("status"))


def orders_changes_report(history: DataFrame, orders: DataFrame) -> DataFrame:
    """One row. ``total_orders`` counts every order in the history plus
    every open order again (open orders are in both), as the reference's
    report does; ``distinct_orders`` is the plain number.

    One shuffle of the history (per order, with map-side partial
    aggregation) feeds every figure; the open-order count is a separate
    global count. The two one-row results are combined by a union and a
    global max, not by a join.
    """
    closed = F.col("status") == STATUS_CLOSED
    per_order = history.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("car_reg_num").alias("cars"),
        micros_between(F.max("returned_at"), F.min("returned_at")).alias("renew"),
        F.count(F.when(closed, 1)).alias("closed_n"),
        F.sum(F.when(closed, F.col("total_price"))).alias("closed_sum"),
        F.min(F.when(closed, F.col("total_price"))).alias("closed_min"),
        F.max(F.when(closed, F.col("total_price"))).alias("closed_max"),
    )
    return changes_report_of(per_order, orders)


def changes_report_of(per_order: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders_changes_report`` from one row per order."""
    a = per_order.agg(
        F.count(F.lit(1)).alias("distinct_orders"),
        F.sum("n").alias("sum_changes"),
        F.sum("cars").alias("sum_cars"),
        F.sum(F.when(F.col("renew") > 0, as_int("renew"))).alias("sum_renew"),
        F.count(F.when(F.col("renew") > 0, 1)).alias("n_renew"),
        F.sum("closed_n").alias("n_closed"),
        F.sum("closed_sum").alias("closed_sum"),
        F.min("closed_min").alias("min_price"),
        F.max("closed_max").alias("max_price"),
    )
    b = orders.agg(F.count(F.lit(1)).alias("open_orders"))
    cols = a.columns + b.columns
    one = a.unionByName(b, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in cols])
    return one.select(
        (F.col("distinct_orders") + F.col("open_orders")).alias("total_orders"),
        "distinct_orders", "open_orders",
        ratio_decimal("sum_changes", "distinct_orders").alias("avg_changes"),
        ratio_decimal("sum_cars", "distinct_orders").alias("avg_cars"),
        ratio_decimal("sum_renew", as_int("n_renew") * F.lit(MICROS_PER_DAY)).alias("avg_renew"),
        "min_price",
        ratio_decimal(cents("closed_sum"), as_int("n_closed") * F.lit(100)).alias("avg_price"),
        "max_price",
    )


# R7 ---------------------------------------------------------------------

def fin_report(history: DataFrame, start_ts, end_ts) -> DataFrame:
    """Revenue of closed rows returned in [start_ts, end_ts]; NULL if none."""
    s, e = _ts(start_ts), _ts(end_ts)
    return (history.filter((F.col("status") == STATUS_CLOSED) & F.col("returned_at").between(s, e))
            .agg(F.sum("total_price").cast("decimal(38,2)").alias("revenue"))
            .select(s.alias("start_ts"), e.alias("end_ts"), "revenue"))


# R8 ---------------------------------------------------------------------

def client_report(history: DataFrame) -> DataFrame:
    """Per client with a closed row: sorted distinct cars, revenue as the
    reference computes it (history rows x closed total: its join fans out)
    and ``closed_revenue`` (closed total alone).

    (client, car) pairs are aggregated first, so the car list is built
    from distinct pairs only: its size is bounded by the number of cars.
    """
    closed = F.col("status") == STATUS_CLOSED
    pairs = history.groupBy("client_pass", "car_reg_num").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(closed, 1)).alias("closed_n"),
        F.sum(F.when(closed, F.col("total_price"))).alias("closed_sum"),
    )
    per = pairs.groupBy("client_pass").agg(
        F.sum("n").alias("n"),
        F.sum("closed_n").alias("closed_n"),
        F.sum("closed_sum").alias("closed_sum"),
        F.array_join(F.array_sort(F.collect_list("car_reg_num")), ", ").alias("car_list"),
    )
    return per.filter(F.col("closed_n") > 0).select(
        "client_pass", "car_list",
        (F.col("n").cast("decimal(20,0)") * F.col("closed_sum")).cast("decimal(38,2)").alias("revenue"),
        F.col("closed_sum").cast("decimal(38,2)").alias("closed_revenue"),
    )


#: Cars in a piece of a client's car list.
PART_CARS = 50


def client_report_parts(history: DataFrame, size: int = PART_CARS) -> DataFrame:
    """R8 with the car list in pieces of ``size`` cars, one row each, in
    order: no row grows with a client's cars, however many. ``part_no``
    counts from 0; joined by ", " the pieces are the list of R8.

    A client's cars are numbered in two levels: distinct (client, car)
    pairs are range-sorted, so that a client with very many lies in several
    partitions; its rows count within each, and the counts of the earlier
    partitions are added."""
    closed = F.col("status") == STATUS_CLOSED
    pairs = history.groupBy("client_pass", "car_reg_num").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(closed, 1)).alias("closed_n"),
        F.sum(F.when(closed, F.col("total_price"))).alias("closed_sum"))
    parts = shuffle_parts(history.sparkSession)
    key = ["client_pass", "car_reg_num"]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1))
    dealt = materialize(pairs.repartitionByRange(parts, *key).sortWithinPartitions(*key)
                        .withColumn("_at", row).withColumn("_part", F.spark_partition_id()))
    within = dealt.groupBy("client_pass", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("client_pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = within.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    pieces = (dealt.join(starts, ["client_pass", "_part"]).withColumn("part_no", F.floor(rank / size).cast("long"))
              .groupBy("client_pass", "part_no").agg(F.array_join(F.array_sort(F.collect_list("car_reg_num")), ", ").alias("car_list")))
    per = dealt.groupBy("client_pass").agg(
        F.sum("n").alias("n"), F.sum("closed_n").alias("closed_n"), F.sum("closed_sum").alias("closed_sum"),
        F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts")).filter(F.col("closed_n") > 0)
    return pieces.join(per, "client_pass").select(
        "client_pass", "part_no", "parts", "car_list",
        (F.col("n").cast("decimal(20,0)") * F.col("closed_sum")).cast("decimal(38,2)").alias("revenue"),
        F.col("closed_sum").cast("decimal(38,2)").alias("closed_revenue"))


# R9 - R13 ---------------------------------------------------------------

def autopark_status(cars: DataFrame, car_states: DataFrame) -> DataFrame:
    """Number of cars per state with the state name; empty states absent."""
    g = cars.groupBy("state_id").agg(F.count(F.lit(1)).alias("num"))
    return with_state_name(g, car_states).select("state_id", "state", "num")


def _set(v) -> bool:
    return v is not None and v != ""


def find_car(cars: DataFrame, car_states: DataFrame, color=None, type=None, mark=None,
             state_id=1) -> DataFrame:
    """Cars matching every given criterion; ``state_id`` defaults to 1
    (waiting) and ``None`` means any state. Only given criteria become
    filters, so each one reaches the scan as a pushed predicate."""
    df = cars
    for name, v in (("state_id", state_id), ("color", color), ("type", type), ("mark", mark)):
        if _set(v):
            df = df.filter(F.col(name) == F.lit(v))
    return with_state_name(df, car_states).select(
        "reg_num", "state_id", "state", "color", "type", "mark", "price")


def list_cars(cars: DataFrame, car_states: DataFrame) -> DataFrame:
    return with_state_name(cars, car_states).select(
        "reg_num", "state_id", "state", "color", "mark", "type", "price", "tech_serv_date")


def list_clients(clients: DataFrame) -> DataFrame:
    return clients.select("pass", "name")


def list_orders(orders: DataFrame) -> DataFrame:
    return orders.orderBy("id").select(
        "id", "client_pass", "car_reg_num", "rented_at", "returned_at", "total_price")
