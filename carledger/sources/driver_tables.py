"""Fleet tables derived from the driver's TPC-H-like parquet tables.

The mapping is deterministic, so the same rows can be rebuilt in any SQL
engine (the DuckDB form lives in ``carledger.oracle_sql``):

* ``cars``     <- part      (one car per part)
* ``clients``  <- customer  (one client per customer)
* ``rent_history`` <- lineitem JOIN orders: every line of an order is one
  change of that order; the last line closes it unless the order is 'O'.
* ``rent_orders``  <- the last history row of each order without a
  closed row (the open orders).

Only the needed columns are read, so the parquet scans prune columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carledger.functions.fixed import NOTE_CREATED, NOTE_RETURNED, STATUS_CLOSED, STATUS_OPEN
from carledger.functions.timefn import add_days
from carledger.operators.history import change_note

LOADER_USER = "LOADER"
SERVICE_EPOCH = "1995-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


KEY_WIDTH = 10      # characters of a car's or a client's key


def fixed_key(prefix: str, k) -> F.Column:
    """``prefix`` and the number in hexadecimal digits, KEY_WIDTH characters
    in all: different numbers give different keys, and a number that does
    not fit is an error, never cut."""
    digits = KEY_WIDTH - len(prefix)
    text = F.concat(F.lit(prefix), F.lpad(F.hex(k.cast("long")), digits, "0"))
    fits = (k >= 0) & (k < F.lit(16 ** digits).cast("long"))
    return F.when(k.isNull(), F.lit(None).cast("string")).when(fits, text).otherwise(
        F.raise_error(F.concat(F.lit(f"a key of {KEY_WIDTH} characters cannot hold "), k.cast("string"))).cast("string"))


def car_key(partkey) -> F.Column:
    return fixed_key("C", partkey)


def client_key(custkey) -> F.Column:
    return fixed_key("", custkey)


LINES = 1_000_000   # lines of an order: ids are order * LINES + line


def line_id(order, line) -> F.Column:
    """A history id of an order's line; more lines than LINES are an error."""
    return F.when(line < LINES, order.cast("long") * F.lit(LINES).cast("long") + line).otherwise(
        F.raise_error(F.lit("an order has too many lines")).cast("long"))


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    k = F.col("p_partkey")
    return p.select(
        car_key(k).alias("reg_num"),
        (k % 3 + 1).cast("int").alias("state_id"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("color"),
        F.col("p_brand").alias("mark"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        add_days(F.lit(SERVICE_EPOCH).cast("timestamp_ntz"), k % 60).alias("tech_serv_date"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return c.select(client_key(F.col("c_custkey")).alias("pass"), F.col("c_name").alias("name"))


# Line order inside a driver order; (l_orderkey, l_linenumber) is not
# unique in the driver data, so every remaining column breaks ties.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
              "l_shipdate", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]


def rent_history(spark: SparkSession, sf_dir: str, parts: int | None = None, maybe_open: bool = False) -> DataFrame:
    """orders_history rows (with the trigger note) from lineitem x orders.

    One hash shuffle on the order key (into ``parts`` partitions if given)
    serves the join and one window, whose sort gives a line's number and what
    the lines before it hold; the rows stay dealt by ``order_id``.
    ``maybe_open``: all rows of the orders whose last line may leave them open.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey"] + LINE_ORDER).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))
    if parts:
        li = li.repartition(parts, "l_orderkey")
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    if maybe_open:
        # A key may come twice, with another status.
        left = od.filter(F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") == "O"))
        od = od.join(left.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    # The last line has none after it: the same scan tells it.
    base = j.select(
        "l_orderkey", "l_partkey", "o_custkey", "o_orderstatus", "o_orderdate", "l_extendedprice",
        F.row_number().over(w).alias("seq"),
        F.lead(F.lit(1)).over(w).isNull().alias("is_last"),
        F.lag("l_partkey").over(w).alias("_part1"), F.lag("l_partkey", 2).over(w).alias("_part2"),
        F.lag("o_custkey").over(w).alias("_cust1"), F.lag("o_orderdate").over(w).alias("_date1"),
    )
    key, s = F.col("l_orderkey"), F.col("seq")

    def values(s, cust, date, part, before) -> tuple:
        """(client, car, end) of the line with number ``s``."""
        client = F.when((key % 50 == 0) & (s >= 4), F.greatest(F.col(cust) - 1, F.lit(0))).otherwise(F.col(cust))
        car = F.when(s % 2 == 0, F.col(before)).otherwise(F.col(part))
        return (client, car,
                add_days(F.col(date), F.when(s % 4 == 0, s - 1).otherwise(s), (key % 8) * 3))
    # What the line before holds is compared as numbers, which its keys are made of.
    client, car, returned = values(s, "o_custkey", "o_orderdate", "l_partkey", "_part1")
    was = values(s - 1, "_cust1", "_date1", "_part1", "_part2")
    rows = base.select(
        line_id(key, s).alias("id"),
        key.alias("order_id"),
        s.alias("seq"),
        add_days("o_orderdate", 0, s - 1).alias("changed_at"),
        client_key(client).alias("client_pass"),
        car_key(car).alias("car_reg_num"),
        add_days("o_orderdate", F.when(s % 5 == 0, -1).otherwise(0)).alias("rented_at"),
        returned.alias("returned_at"),
        F.when(F.col("is_last") & (F.col("o_orderstatus") != "O"), F.lit(STATUS_CLOSED))
         .otherwise(F.lit(STATUS_OPEN)).alias("status"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("total_price"),
        *[v.cast("long").alias(n) for v, n in zip((client, car, *was), ("_client", "_car", "_client0", "_car0"))],
        was[2].alias("_returned0"),
    )
    note = F.when(F.col("seq") == 1, F.lit(NOTE_CREATED)) \
        .when(F.col("status") == STATUS_CLOSED, F.lit(NOTE_RETURNED)) \
        .otherwise(change_note(F.col("_client0"), F.col("_car0"), F.col("_returned0"), F.col("_client"),
                               F.col("_car"), F.col("returned_at")))
    return rows.select(
        "id", "order_id", "changed_at", "client_pass", "car_reg_num", "rented_at", "returned_at",
        "status", "total_price", note.alias("note"), F.lit(LOADER_USER).alias("v_user"),
    )


ORDER_COLS = ["id", "client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"]
CAR_COLS = ["reg_num", "state_id", "color", "mark", "type", "price", "tech_serv_date"]


def open_orders_with_first_car(history: DataFrame) -> DataFrame:
    """Open orders (last row of orders with no closed row) plus the car the
    order started with. One aggregation per order, partial on the map side."""
    last = F.max_by(F.struct("client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"),
                    F.col("id"))
    agg = history.groupBy("order_id").agg(
        F.max("status").alias("max_status"),
        last.alias("last"),
        F.min_by("car_reg_num", F.col("id")).alias("first_car"),
    )
    return agg.filter(F.col("max_status") == STATUS_OPEN).select(
        F.col("order_id").alias("id"), "last.*", "first_car")


def first_cars(history: DataFrame) -> DataFrame:
    """(id, first_car) of every order: the car of its first history row."""
    first = history.groupBy("order_id").agg(F.min_by("car_reg_num", F.col("id")).alias("first_car"))
    return first.withColumnRenamed("order_id", "id")


def rent_orders(history: DataFrame) -> DataFrame:
    return open_orders_with_first_car(history).select(*ORDER_COLS)


class FleetTables:
    """Lazily built fleet tables over one driver data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def cars(self) -> DataFrame:
        return self._get("cars", lambda: cars(self.spark, self.sf_dir))

    @property
    def clients(self) -> DataFrame:
        return self._get("clients", lambda: clients(self.spark, self.sf_dir))

    @property
    def history(self) -> DataFrame:
        return self._get("history", lambda: rent_history(self.spark, self.sf_dir))

    @property
    def orders(self) -> DataFrame:
        return self._get("orders", lambda: rent_orders(self.history))

    @property
    def orders_first_car(self) -> DataFrame:
        return self._get("orders_fc", lambda: open_orders_with_first_car(self.history))

    @property
    def car_states(self) -> DataFrame:
        from carledger.operators.quality import car_states
        return self._get("car_states", lambda: car_states(self.spark))
