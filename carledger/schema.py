"""Fixed schemas of the fleet tables and of the command tables.

Keys of cars and clients are fixed-width 10-character strings; money is
``decimal(10,2)``; every time is a zone-less timestamp.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
WIDE_MONEY = T.DecimalType(38, 2)
TS = T.TimestampNTZType()

CAR_STATES = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("state", T.StringType(), False),
])

CARS = T.StructType([
    T.StructField("reg_num", T.StringType(), False),
    T.StructField("state_id", T.IntegerType(), False),
    T.StructField("color", T.StringType(), False),
    T.StructField("mark", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("tech_serv_date", TS, False),
])

CLIENTS = T.StructType([
    T.StructField("pass", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
])

ORDERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("client_pass", T.StringType(), False),
    T.StructField("car_reg_num", T.StringType(), False),
    T.StructField("rented_at", TS, False),
    T.StructField("returned_at", TS, False),
    T.StructField("total_price", MONEY, False),
])

ORDERS_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("changed_at", TS, False),
    T.StructField("client_pass", T.StringType(), False),
    T.StructField("car_reg_num", T.StringType(), False),
    T.StructField("rented_at", TS, False),
    T.StructField("returned_at", TS, False),
    T.StructField("status", T.StringType(), False),
    T.StructField("total_price", MONEY, False),
    T.StructField("note", T.StringType(), True),
    T.StructField("v_user", T.StringType(), False),
])

# One row per order change: op is I (insert), U (update) or D (delete).
# A D row needs only seq, ts, op, order_id and v_user.
ORDER_EVENTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", TS, False),
    T.StructField("op", T.StringType(), False),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("client_pass", T.StringType(), True),
    T.StructField("car_reg_num", T.StringType(), True),
    T.StructField("rented_at", TS, True),
    T.StructField("returned_at", TS, True),
    T.StructField("total_price", MONEY, True),
    T.StructField("v_user", T.StringType(), False),
])


def _cmd(*fields):
    return T.StructType([
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", TS, False),
        *fields,
    ])


def _s(name, nullable=True):
    return T.StructField(name, T.StringType(), nullable)


CAR_ADDS = _cmd(_s("reg_num", False), _s("color"), _s("mark"), _s("type"),
                T.StructField("price", MONEY, True))
CAR_UPDATES = _cmd(_s("reg_num", False), T.StructField("state_id", T.IntegerType(), True),
                   _s("color"), _s("mark"), _s("type"), T.StructField("price", MONEY, True),
                   T.StructField("tech_serv_date", TS, True))
CAR_DELETES = _cmd(_s("reg_num", False))
CLIENT_ADDS = _cmd(_s("pass", False), _s("name"))
CLIENT_UPDATES = _cmd(_s("pass", False), _s("name"))
CLIENT_DELETES = _cmd(_s("pass", False))
ORDER_ADDS = _cmd(_s("client_pass", False), _s("car_reg_num", False),
                  T.StructField("returned_at", TS, True))
ORDER_UPDATES = _cmd(T.StructField("id", T.LongType(), False), _s("car_reg_num"),
                     T.StructField("rented_at", TS, True), T.StructField("returned_at", TS, True))
ORDER_DELETES = _cmd(T.StructField("id", T.LongType(), False))

# Calls of all verbs in one sequence; a verb reads the arguments it has.
JOURNAL = _cmd(_s("verb", False), _s("reg_num"), _s("color"), _s("mark"), _s("type"), T.StructField("price", MONEY, True),
               T.StructField("state_id", T.IntegerType(), True), T.StructField("tech_serv_date", TS, True), _s("pass"),
               _s("name"), T.StructField("id", T.LongType(), True), T.StructField("rented_at", TS, True),
               T.StructField("returned_at", TS, True))

REJECTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("key", T.StringType(), True),
    T.StructField("err", T.StringType(), False),
])
