"""Command tables derived from the driver tables (one command per part,
customer or open order, so a batch grows with the data). Each batch mixes
calls that succeed with calls that must be rejected (existing or repeated
keys, missing values, unknown keys, busy cars and clients, returns in the
past), so both outputs of every verb are exercised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carledger import params as P
from carledger.functions.timefn import add_days
from carledger.schema import JOURNAL
from carledger.sources.driver_tables import car_key, client_key, fixed_key, read_table

# The first call of a key has seq 2 k, the repeated one 2 k + 1.


def _at(hours) -> F.Column:
    return add_days(F.lit(P.AS_OF).cast("timestamp_ntz"), 0, hours)


def _new_key(prefix: str, k) -> F.Column:
    return fixed_key(prefix, k)


def car_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    k = F.col("p_partkey")
    reg = (F.when(k % 5 == 0, car_key(k))
           .when(k % 7 == 0, _new_key("N", k - 1))
           .otherwise(_new_key("N", k)))
    price = F.when(k % 11 != 0, (F.col("p_retailprice").cast("decimal(10,2)") + 100).cast("decimal(10,2)"))
    # An empty text is no value, so every 17th call lacks its color.
    color = F.when(k % 17 == 0, F.lit("")).otherwise(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    return p.select(k.cast("long").alias("seq"), _at(k % 24).alias("ts"), reg.alias("reg_num"),
                    color.alias("color"),
                    F.col("p_brand").alias("mark"), F.col("p_type").alias("type"), price.alias("price"))


def car_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    k = F.col("p_partkey")
    first = p.select(
        (k * 2).cast("long").alias("seq"), _at(k % 24).alias("ts"),
        F.when(k % 13 == 0, _new_key("X", k)).otherwise(car_key(k)).alias("reg_num"),
        F.when(k % 8 == 3, 9).when(k % 4 == 0, None).when(k % 4 == 1, 1).when(k % 4 == 2, 3)
         .otherwise(2).cast("int").alias("state_id"),
        F.when(k % 3 == 0, F.lit("mixed")).when(k % 3 == 1, F.lit("")).alias("color"),
        F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("type"),
        F.when(k % 2 == 0, (F.col("p_retailprice").cast("decimal(10,2)") - 50).cast("decimal(10,2)"))
         .alias("price"),
        F.when(k % 5 == 0, F.lit(P.AS_OF).cast("timestamp_ntz")).alias("tech_serv_date"))
    six = F.col("seq") % 12 == 0
    again = first.select(
        (F.col("seq") + 1).alias("seq"), add_days("ts", 1).alias("ts"), "reg_num",
        F.lit(None).cast("int").alias("state_id"), F.when(six, F.lit("repainted")).alias("color"), "mark",
        F.when(six, F.lit("rebuilt")).alias("type"), F.lit(None).cast("decimal(10,2)").alias("price"),
        F.lit(None).cast("timestamp_ntz").alias("tech_serv_date"))
    return first.unionByName(again)


def car_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    k = F.col("p_partkey")
    first = p.select((k * 2).cast("long").alias("seq"), _at(k % 24).alias("ts"),
                     F.when(k % 13 == 0, _new_key("X", k)).otherwise(car_key(k)).alias("reg_num"))
    again = first.select((F.col("seq") + 1).alias("seq"), "ts", "reg_num")
    return first.unionByName(again)


def client_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    k = F.col("c_custkey")
    key = (F.when(k % 5 == 0, client_key(k)).when(k % 7 == 0, _new_key("N", k - 1))
           .otherwise(_new_key("N", k)))
    return c.select(k.cast("long").alias("seq"), _at(k % 24).alias("ts"), key.alias("pass"),
                    F.when(k % 9 == 1, F.lit("")).when(k % 9 != 0, F.col("c_name")).alias("name"))


def client_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    k = F.col("c_custkey")
    first = c.select((k * 2).cast("long").alias("seq"), _at(k % 24).alias("ts"),
                     F.when(k % 11 == 0, _new_key("X", k)).otherwise(client_key(k)).alias("pass"),
                     F.when(k % 2 == 0, F.upper("c_name")).when(k % 3 == 0, F.lit("")).alias("name"), "c_name")
    again = first.select(
        (F.col("seq") + 1).alias("seq"), "ts", "pass",
        F.when(F.col("seq") % 12 == 0, F.concat(F.col("c_name"), F.lit(" jr"))).alias("name"))
    return first.drop("c_name").unionByName(again)


def client_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    return c.select(k.cast("long").alias("seq"), _at(k % 24).alias("ts"), client_key(k).alias("pass"))


FREE_BLOCK = 1000   # keys of a block: free clients and cars meet by rank inside it


def order_adds(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """One call per customer, nearly all for busy clients or cars, and two
    calls for each client without an open order that a free car is found
    for: the first can succeed, the second, for the next free car, comes
    when the client has one."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    ts = _at(k % 24)
    ret = (F.when(k % 10 == 0, add_days(ts, -1))
           .when(k % 17 == 0, F.lit(None).cast("timestamp_ntz"))
           .otherwise(add_days(ts, k % 7 + 1, (k % 4) * 6)))
    plain = c.select((k * 3).cast("long").alias("seq"), ts.alias("ts"), client_key(k).alias("client_pass"),
                     car_key(F.when(k % 6 == 0, F.greatest(k - 1, F.lit(0))).otherwise(k)).alias("car_reg_num"),
                     ret.alias("returned_at"))

    def free(name: str, key: str, text, busy: str) -> DataFrame:
        rows = read_table(spark, sf_dir, name, [key]).select(F.col(key).alias("k"), text(F.col(key)).alias(busy))
        rows = rows.join(orders.select(busy).distinct(), busy, "left_anti")
        block = F.floor(F.col("k") / FREE_BLOCK).cast("long").alias("block")
        w = Window.partitionBy("block").orderBy("k")
        return rows.select("*", block).withColumn("rank", F.row_number().over(w))
    clients = free("customer", "c_custkey", client_key, "client_pass")
    cars = free("part", "p_partkey", car_key, "car_reg_num").drop("k")
    pairs = [clients.join(cars.withColumn("rank", F.col("rank") - i), ["block", "rank"]).select(
        (F.col("k") * 3 + 1 + i).cast("long").alias("seq"), _at(F.col("k") % 24).alias("ts"), "client_pass", "car_reg_num",
        add_days(_at(F.col("k") % 24), F.col("k") % 5 + 1).alias("returned_at")) for i in (0, 1)]
    return plain.unionByName(pairs[0]).unionByName(pairs[1])


def order_updates(orders: DataFrame) -> DataFrame:
    """Per open order (with the car it started with, ``first_car``): two calls (extend or cut the end, swap back to the
    order's first car, fix the start) and one call for an unknown order."""
    i = F.col("id")
    none = F.lit(None).cast("timestamp_ntz")
    a = F.struct(
        (i * 10).alias("seq"), add_days("rented_at", 1).alias("ts"), i.alias("id"),
        F.when(i % 2 == 0, F.col("first_car")).alias("car_reg_num"),
        none.alias("rented_at"),
        F.when(i % 5 == 0, add_days("returned_at", -9))
         .when(i % 5 < 3, add_days("returned_at", 2)).alias("returned_at"))
    b = F.struct(
        (i * 10 + 5).alias("seq"), add_days("rented_at", 0, 36).alias("ts"), i.alias("id"),
        F.when(i % 3 == 0, F.col("first_car")).alias("car_reg_num"),
        F.when(i % 7 == 0, add_days("rented_at", 0, -1)).alias("rented_at"),
        F.when(i % 2 == 1, add_days("returned_at", 4)).alias("returned_at"))
    unknown = F.struct(
        (i * 10 + 9).alias("seq"), add_days("rented_at", 1).alias("ts"), (-i).alias("id"),
        F.lit(None).cast("string").alias("car_reg_num"),
        none.alias("rented_at"),
        add_days("returned_at", 1).alias("returned_at"))
    return orders.select(F.inline(F.array(a, b, unknown)))      # one read of the orders


def order_deletes(orders: DataFrame) -> DataFrame:
    i = F.col("id")
    # Calls for every fourth order name an unknown id, so it stays open.
    named = F.when(i % 4 != 0, i).otherwise(-i)
    calls = [F.struct((i * 10 + n).alias("seq"), F.col("ts"), key.alias("id")) for n, key in ((3, named), (4, named), (5, -i))]
    return orders.select("id", add_days("rented_at", 1).alias("ts")).select(F.inline(F.array(*calls)))


# Place of an entity's calls in the journal: entities take turns by key.
def _turn(k, kind: int, i: int) -> F.Column:
    return ((k.cast("long") * 3 + kind) * 16 + i).alias("seq")


def journal(spark: SparkSession, sf_dir: str, orders: DataFrame, id_offset: int) -> DataFrame:
    """One sequence of all verbs: per part a car that comes, one that
    changes, one that goes; per customer a client that comes, rents, swaps,
    closes and goes, and an old one that rents; per open order (with the car
    it started with, ``first_car``) a swap, a new end and a close."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    k, b, o = F.col("p_partkey"), F.col("c_custkey"), F.col("id")
    price = F.col("p_retailprice").cast("decimal(10,2)")

    def calls(df, key, kind, i, verb, ts, **args):
        fields = [f for f in JOURNAL.fields if f.name not in ("seq", "ts", "verb")]
        return df.select(_turn(key, kind, i), ts.alias("ts"), F.lit(verb).alias("verb"),
                         *[(args[f.name] if f.name in args else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    at, bt, ot = _at(k % 24), _at(b % 24), add_days("rented_at", 1)
    near = lambda d: b - b % 8 + (b + d) % 8
    mine = F.lit(id_offset) + (b.cast("long") * 3 + 1) * 16 + 2     # the order that call 2 of a customer makes
    parts = [
        calls(p, k, 0, 0, "add_car", at, reg_num=_new_key("N", k), color=F.split_part("p_name", F.lit(" "), F.lit(2)), mark=F.col("p_brand"),
              type=F.col("p_type"), price=F.when(k % 11 != 0, price + 100)),
        calls(p, k, 0, 1, "update_car", at, reg_num=car_key(k), price=F.when(k % 2 == 0, price - 50),
              state_id=F.when(k % 8 == 3, 9).when(k % 4 == 1, 1).when(k % 4 == 2, 3), color=F.when(k % 3 == 0, F.lit("mixed"))),
        calls(p, k, 0, 8, "del_car", at, reg_num=F.when(k % 3 == 0, car_key(k)).otherwise(_new_key("N", k))),
        calls(c, b, 1, 0, "add_client", bt, **{"pass": _new_key("N", b)}, name=F.when(b % 9 != 0, F.col("c_name"))),
        calls(c, b, 1, 1, "update_client", bt, **{"pass": client_key(b)}, name=F.when(b % 2 == 0, F.upper("c_name"))),
        calls(c, b, 1, 2, "add_order", bt, **{"pass": _new_key("N", b)}, reg_num=_new_key("N", b - b % 2),
              returned_at=F.when(b % 13 != 0, add_days(bt, b % 7 + 1, (b % 4) * 6))),
        calls(c, b, 1, 3, "add_order", bt, **{"pass": client_key(b)}, reg_num=_new_key("N", near(3)), returned_at=add_days(bt, 2)),
        calls(c, b, 1, 4, "update_order", bt, id=mine, reg_num=_new_key("N", near(5)), returned_at=add_days(bt, b % 5 + 1)),
        calls(c, b, 1, 5, "del_order", bt, id=F.when(b % 3 != 0, mine).otherwise(-b)),
        calls(c, b, 1, 6, "del_client", bt, **{"pass": F.when(b % 4 == 0, client_key(b)).otherwise(_new_key("N", b))}),
        calls(orders, o, 2, 0, "update_order", ot, id=o, reg_num=F.when(o % 2 == 0, F.col("first_car")), returned_at=add_days("returned_at", 2)),
        calls(orders, o, 2, 1, "update_order", ot, id=o, returned_at=add_days("returned_at", F.when(o % 5 == 0, -9).otherwise(-1))),
        calls(orders, o, 2, 2, "del_order", ot, id=F.when(o % 3 != 0, o).otherwise(-o)),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)
