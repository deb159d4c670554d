"""Fleet rules (F1-F6): the data rules of the rental simulation, set-based.

* F1 ``expired_orders``: open orders whose returned_at <= t leave the
  open set and get a closed ('1') history row.
* F2 ``fleet_tick``: one projection over ``cars``: cars of expired orders
  become waiting; waiting cars whose last service is >= 20 days old go to
  service (service date t); cars in service for more than a day return.
* F3 ``pick_free_car``: one waiting car by a seeded hash order (top-1).
* F4 ``swap_quote``: new total if an order's car is swapped at time ts.
* F5 ``renew_quote``: one more day at the current price.
* F6 ``close_early``: clients return cars before the end; price unchanged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.functions.exact import as_int, cents, money_of_price_days
from carledger.functions.fixed import (
    NOTE_RETURNED, ONSERVING, SERVICE_AFTER_DAYS, SERVICE_LENGTH_DAYS, STATUS_CLOSED, WAITING,
)
from carledger.functions.timefn import MICROS_PER_DAY, add_days, micros_between, plus_one_day, \
    trunc_seconds
from carledger.operators.history import history_rows


def _ts(v) -> F.Column:
    return v if isinstance(v, F.Column) else F.lit(str(v)).cast("timestamp_ntz")


def _flag_cars(cars: DataFrame, car_keys: DataFrame, flag: str) -> DataFrame:
    """cars + boolean ``flag``: reg_num is among ``car_keys.car_reg_num``.
    The keys are de-duplicated (partial aggregation) before the join."""
    k = car_keys.select(F.col("car_reg_num").alias("reg_num")).distinct() \
        .withColumn(flag, F.lit(True))
    return cars.join(k, "reg_num", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


class Split(NamedTuple):
    orders: DataFrame
    history: DataFrame


def expired_orders(orders: DataFrame, t, v_user: str, id_offset: int = 0) -> Split:
    """(open orders left, closing history rows). History ids are
    ``id_offset + order id`` so a rerun writes the same rows."""
    tt = _ts(t)
    exp = F.col("returned_at") <= tt
    closing = history_rows(orders.filter(exp), STATUS_CLOSED, NOTE_RETURNED, tt, v_user,
                           F.lit(id_offset) + F.col("id"))
    return Split(orders.filter(~exp), closing)


def fleet_tick(cars: DataFrame, orders: DataFrame, t) -> DataFrame:
    """new ``cars`` after one tick at time t."""
    tt = _ts(t)
    c = _flag_cars(cars, orders.filter(F.col("returned_at") <= tt), "_expired")
    s1 = F.when(F.col("_expired"), F.lit(WAITING)).otherwise(F.col("state_id"))
    due = (s1 == WAITING) & (micros_between(tt, "tech_serv_date") >= SERVICE_AFTER_DAYS * MICROS_PER_DAY)
    back = (s1 == ONSERVING) & (tt > add_days(F.col("tech_serv_date"), SERVICE_LENGTH_DAYS))
    return c.select(
        "reg_num",
        F.when(due, F.lit(ONSERVING)).when(back, F.lit(WAITING)).otherwise(s1).cast("int").alias("state_id"),
        "color", "mark", "type", "price",
        F.when(due, trunc_seconds(tt)).otherwise(F.col("tech_serv_date")).alias("tech_serv_date"),
    )


def pick_free_car(cars: DataFrame, seed: str) -> DataFrame:
    """one waiting car, chosen by md5(reg_num || seed); top-1 without a
    global sort (TakeOrderedAndProject keeps one row per task)."""
    return (cars.filter(F.col("state_id") == WAITING)
            .orderBy(F.md5(F.concat(F.col("reg_num"), F.lit(seed))), "reg_num")
            .limit(1)
            .select("reg_num", "state_id", "color", "mark", "type", "price", "tech_serv_date"))


def _price(cars: DataFrame, key: str, name: str) -> DataFrame:
    return cars.select(F.col("reg_num").alias(key), F.col("price").alias(name))


def swap_quote(orders: DataFrame, cars: DataFrame, swaps: DataFrame) -> DataFrame:
    """``swaps(id, car_reg_num, ts)``: total - d*old + d*new with
    d = days from ts to the order's end, rounded once to cents."""
    o = orders.select("id", F.col("car_reg_num").alias("old_car"), "returned_at", "total_price")
    s = swaps.select("id", F.col("car_reg_num").alias("new_car"), "ts")
    j = (s.join(o, "id")
         .join(_price(cars, "old_car", "old_price"), "old_car")
         .join(_price(cars, "new_car", "new_price"), "new_car"))
    num = (cents("total_price") * F.lit(MICROS_PER_DAY).cast("decimal(38,0)")
           + as_int(micros_between("returned_at", "ts")) * (cents("new_price") - cents("old_price")))
    return j.select("id", "old_car", "new_car", "ts",
                    money_of_price_days(num, 2).alias("total_price"))


def renew_quote(orders: DataFrame, cars: DataFrame) -> DataFrame:
    """each order renewed by one day at its car's current price."""
    j = orders.join(_price(cars, "car_reg_num", "price"), "car_reg_num")
    return j.select("id", "car_reg_num", plus_one_day("returned_at").alias("returned_at"),
                    (F.col("total_price") + F.col("price")).alias("total_price"))


class Closed(NamedTuple):
    orders: DataFrame
    cars: DataFrame
    history: DataFrame


def close_early(orders: DataFrame, cars: DataFrame, closes: DataFrame, v_user: str) -> Closed:
    """``closes(seq, ts, id)``: the orders leave, their cars wait again,
    and each close writes a '1' history row (id = seq); the price stays. A
    repeated call for an order finds nothing: the first in seq order counts."""
    c = closes.groupBy("id").agg(F.min_by(F.struct("seq", "ts"), F.col("seq")).alias("c")).select("c.seq", "c.ts", "id")
    gone = orders.join(c, "id")
    hist = history_rows(gone, STATUS_CLOSED, NOTE_RETURNED, F.col("ts"), v_user, F.col("seq"))
    new_cars = _flag_cars(cars, gone.select("car_reg_num"), "_freed")
    new_cars = new_cars.select(
        "reg_num",
        F.when(F.col("_freed"), F.lit(WAITING)).otherwise(F.col("state_id")).cast("int").alias("state_id"),
        "color", "mark", "type", "price", "tech_serv_date")
    return Closed(orders.join(c, "id", "left_anti"), new_cars, hist)
