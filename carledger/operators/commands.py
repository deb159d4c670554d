"""The add / update / delete verbs, applied to whole command tables.

A command table has one row per call with ``seq`` (the call order) and
``ts`` (the call's clock, used where the single-row verb reads the time).
Each verb returns a ``Result``: the new table, the history rows it writes
(order verbs only) and the rejected commands with the verb's error text.

``seq`` is unique within a batch. Every verb gives what applying the
calls one by one in ``seq`` order gives:

* a key added twice in one batch: the lowest ``seq`` of the calls that
  pass their own checks wins, the rest are rejected (the key exists by then);
* several updates of one key apply in ``seq`` order: each column ends as
  the last non-NULL value given (NULL means "keep");
* per-key winners come from ``groupBy(key).agg(min(seq))`` joined back,
  and final values from ``max_by`` aggregates, so a hot key is
  pre-aggregated map-side instead of being sorted in one task;
* the order verbs checkpoint their flagged command table (reliable, in the
  shared folder) before it feeds several branches and outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carledger import schema as S
from carledger.functions.exact import (
    as_int, cents, money_of_price_days, round_ratio_up, units_to_decimal,
)
from carledger.functions.fixed import (
    ERR_ADD_CAR, ERR_ADD_CLIENT, ERR_ADD_ORDER, ERR_DEL_CAR, ERR_DEL_CAR_BUSY, ERR_DEL_CLIENT,
    ERR_UPDATE_CAR, ERR_UPDATE_CLIENT, ERR_UPDATE_ORDER, NOTE_CREATED, NOTE_RETURNED, RENTED,
    STATUS_CLOSED, STATUS_OPEN, WAITING,
)
from carledger.functions.textfn import no_empty
from carledger.functions.timefn import MICROS_PER_DAY, micros_between, trunc_seconds
from carledger.operators.history import HISTORY_COLS, change_note
from carledger.plans import skew as SK
from carledger.plans.components import connected
from carledger.plans.joins import materialize
from carledger.session import ship_package, shuffle_parts

CAR_COLS = ["reg_num", "state_id", "color", "mark", "type", "price", "tech_serv_date"]
CLIENT_COLS = ["pass", "name"]
ORDER_COLS = ["id", "client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"]
MAX_MONEY = 10 ** 8          # number(10,2) holds |x| < 10^8


class Result(NamedTuple):
    table: DataFrame
    rejects: DataFrame
    history: DataFrame | None = None


# ----------------------------------------------------------------- helpers

def with_defaults(cmds: DataFrame, schema, defaults: dict | None = None) -> DataFrame:
    """Command table in the verb's schema: a column left out of the table
    is an argument left out of every call, so it takes the verb's default
    (NULL unless given in ``defaults``); a NULL in a present column is an
    explicit NULL, and so is an empty text. Columns are cast to the schema's
    types."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in cmds.columns:
            cols.append(no_empty(F.col(f.name), f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return cmds.select(*cols)


def _rejects(df: DataFrame, op: str, key: Column, err: Column) -> DataFrame:
    return df.select("seq", F.lit(op).alias("op"), key.cast("string").alias("key"), err.alias("err"))


def _first_per_key(cmds: DataFrame, key: str, name: str = "_first", among: Column | None = None) -> DataFrame:
    """Flag the lowest-seq command of each key (optionally among rows
    where ``among`` holds). Aggregate + join, not a window."""
    src = cmds if among is None else cmds.filter(among)
    m = src.groupBy(key).agg(F.min("seq").alias("_min_seq"))
    out = cmds.join(m, key, "left")
    flag = F.coalesce(F.col("seq") == F.col("_min_seq"), F.lit(False))
    if among is not None:
        flag = flag & among
    return out.withColumn(name, flag).drop("_min_seq")


def _has_key(cmds: DataFrame, table: DataFrame, key: str, table_key: str, name: str) -> DataFrame:
    """Flag commands whose key exists in ``table`` (keys de-duplicated first)."""
    k = table.select(F.col(table_key).alias(key)).distinct().withColumn(name, F.lit(True))
    return cmds.join(k, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _len_ok(c: str, n: int) -> Column:
    return F.col(c).isNull() | (F.length(c) <= n)


def _money_ok(c: str) -> Column:
    return F.col(c).isNull() | (F.abs(F.col(c)) < MAX_MONEY)


def _last_given(cols: list[str]) -> list[Column]:
    """Per key: the last non-NULL value of each column in seq order."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in cols]


def _apply_updates(table: DataFrame, key: str, accepted: DataFrame, cols: list[str]) -> DataFrame:
    agg = accepted.groupBy(key).agg(*_last_given(cols))
    upd = agg.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = table.join(upd, key, "left")
    return j.select(*[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in table.columns])


# -------------------------------------------------------------------- cars

def add_cars(cars: DataFrame, adds: DataFrame) -> Result:
    """Insert new cars: state 1 (waiting), service date = call time
    (to the second). Rejected: existing or repeated key, a missing value,
    a value too long or a price out of range."""
    adds = with_defaults(adds, S.CAR_ADDS)
    c = _has_key(adds, cars, "reg_num", "reg_num", "_exists")
    own = (~F.col("_exists") & F.col("reg_num").isNotNull()
           & F.col("color").isNotNull() & F.col("mark").isNotNull() & F.col("type").isNotNull()
           & F.col("price").isNotNull()
           & (F.length("reg_num") <= 10) & _len_ok("color", 20) & _len_ok("mark", 20) & _len_ok("type", 20)
           & _money_ok("price"))
    # A call that fails by itself does not take the key from a later one.
    c = c.withColumn("_own", F.coalesce(own, F.lit(False)))
    c = _first_per_key(c, "reg_num", "_ok", among=F.col("_own"))
    new = c.filter("_ok").select(
        "reg_num", F.lit(WAITING).cast("int").alias("state_id"), "color", "mark", "type",
        F.col("price").cast("decimal(10,2)").alias("price"),
        trunc_seconds("ts").alias("tech_serv_date"))
    rej = _rejects(c.filter(~F.col("_ok")), "add_car", F.col("reg_num"), F.lit(ERR_ADD_CAR))
    return Result(cars.select(*CAR_COLS).unionByName(new), rej)


def update_cars(cars: DataFrame, updates: DataFrame, car_states: DataFrame) -> Result:
    """Set-if-given update. ``state_id`` is 1 unless the call gives
    another value (the verb's default is 1, not "unchanged"); an explicit
    NULL keeps the state. Rejected: unknown car or state, bad values."""
    updates = with_defaults(updates, S.CAR_UPDATES, {"state_id": WAITING})
    u = _has_key(updates, cars, "reg_num", "reg_num", "_exists")
    u = _has_key(u, car_states, "state_id", "id", "_state_ok")
    ok = (F.col("_exists") & (F.col("state_id").isNull() | F.col("_state_ok"))
          & _len_ok("color", 20) & _len_ok("mark", 20) & _len_ok("type", 20) & _money_ok("price"))
    u = u.withColumn("_ok", ok)
    cols = ["state_id", "color", "mark", "type", "price", "tech_serv_date"]
    acc = u.filter("_ok").select("seq", "reg_num", *cols)
    new = _apply_updates(cars.select(*CAR_COLS), "reg_num", acc, cols)
    rej = _rejects(u.filter(~F.col("_ok")), "update_car", F.col("reg_num"), F.lit(ERR_UPDATE_CAR))
    return Result(new, rej)


def delete_cars(cars: DataFrame, deletes: DataFrame, orders: DataFrame) -> Result:
    """Delete cars not rented (state 2) and not in an open order.
    History rows of a deleted car stay. A repeated delete of a key is
    rejected: as busy while the car is rented, else as unknown/referenced."""
    d = _first_per_key(with_defaults(deletes, S.CAR_DELETES), "reg_num")
    cs = cars.select("reg_num", "state_id")
    d = d.join(cs, "reg_num", "left")
    d = _has_key(d, orders, "reg_num", "car_reg_num", "_in_order")
    busy = F.col("state_id") == RENTED
    ok = F.col("_first") & F.col("state_id").isNotNull() & ~busy & ~F.col("_in_order")
    d = d.withColumn("_ok", ok)
    err = F.when(busy, F.lit(ERR_DEL_CAR_BUSY)).otherwise(F.lit(ERR_DEL_CAR))
    gone = d.filter("_ok").select("reg_num")
    new = cars.select(*CAR_COLS).join(gone, "reg_num", "left_anti")
    return Result(new, _rejects(d.filter(~F.col("_ok")), "del_car", F.col("reg_num"), err))


# ----------------------------------------------------------------- clients

def add_clients(clients: DataFrame, adds: DataFrame) -> Result:
    """C4: insert new clients; rejected: existing/repeated key, no name,
    key over 10 or name over 40 characters."""
    adds = with_defaults(adds, S.CLIENT_ADDS)
    c = _has_key(adds, clients, "pass", "pass", "_exists")
    own = (~F.col("_exists") & F.col("pass").isNotNull() & F.col("name").isNotNull()
           & (F.length("pass") <= 10) & _len_ok("name", 40))
    c = c.withColumn("_own", F.coalesce(own, F.lit(False)))
    c = _first_per_key(c, "pass", "_ok", among=F.col("_own"))
    new = c.filter("_ok").select("pass", "name")
    rej = _rejects(c.filter(~F.col("_ok")), "add_client", F.col("pass"), F.lit(ERR_ADD_CLIENT))
    return Result(clients.select(*CLIENT_COLS).unionByName(new), rej)


def update_clients(clients: DataFrame, updates: DataFrame) -> Result:
    """name = the last given name (NULL keeps); unknown key rejected."""
    u = _has_key(with_defaults(updates, S.CLIENT_UPDATES), clients, "pass", "pass", "_exists")
    u = u.withColumn("_ok", F.col("_exists") & _len_ok("name", 40))
    acc = u.filter("_ok").select("seq", "pass", "name")
    new = _apply_updates(clients.select(*CLIENT_COLS), "pass", acc, ["name"])
    rej = _rejects(u.filter(~F.col("_ok")), "update_client", F.col("pass"), F.lit(ERR_UPDATE_CLIENT))
    return Result(new, rej)


def delete_clients(clients: DataFrame, deletes: DataFrame, orders: DataFrame) -> Result:
    """Delete clients without an open order; an unknown key is a
    silent success; a client with an open order is rejected."""
    d = _has_key(with_defaults(deletes, S.CLIENT_DELETES), orders, "pass", "client_pass", "_in_order")
    gone = d.filter(~F.col("_in_order")).select("pass")
    new = clients.select(*CLIENT_COLS).join(gone, "pass", "left_anti")
    rej = _rejects(d.filter("_in_order"), "del_client", F.col("pass"), F.lit(ERR_DEL_CLIENT))
    return Result(new, rej)


# ------------------------------------------------------------------ orders

def _history(df: DataFrame, status: str, note: Column, v_user: str) -> DataFrame:
    return df.select(
        F.col("seq").cast("long").alias("id"), F.col("id").cast("long").alias("order_id"),
        F.col("ts").alias("changed_at"), "client_pass", "car_reg_num", "rented_at", "returned_at",
        F.lit(status).alias("status"), F.col("total_price").cast("decimal(10,2)").alias("total_price"),
        note.alias("note"), F.lit(v_user).alias("v_user")).select(*HISTORY_COLS)


def _price(cars: DataFrame, key: str, name: str) -> DataFrame:
    return cars.select(F.col("reg_num").alias(key), F.col("price").alias(name))


#: Most calls that share clients or cars, one with the next, in one task.
CHAIN_CALLS = 1_000_000


def _join_given(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Left joins on a key that many rows lack: those meet no row, so they
    stay where they are and only the others are shuffled."""
    out = rows.filter(F.col(key).isNotNull())
    for t in tables:
        out = out.join(t, key, "left")
    return out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def _first_come(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seqs of calls whose key values no accepted call before has; the
    calls of a task come in the order of seq."""
    taken: set[tuple] = set()
    for batch in it:
        seqs, *keys = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        won = []
        for seq, *values in zip(seqs, *keys):
            own = {(k, v) for k, v in enumerate(values)}
            if taken.isdisjoint(own):
                taken |= own
                won.append(seq)
        yield pa.record_batch([pa.array(won, pa.int64())], names=["seq"])


def greedy_unique(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls (``seq`` + ``keys``) accepted when applied one by one in seq
    order, where a call fails if any of its key values is already taken by
    an accepted call.

    Calls that share key values, directly or through others, are a
    component; each is decided in one task in seq order, all components at
    once, so a chain of dependent calls takes no job of its own. If one has
    more than CHAIN_CALLS calls, the sequence is cut at quantiles of seq and
    the parts are decided one after the other, each without the calls whose
    values are taken by then; in a part components are smaller."""
    und = materialize(calls.select("seq", *keys))
    ship_package(und.sparkSession)
    node = lambda i: F.concat(F.lit(f"{i}:"), F.col(keys[i]).cast("string"))
    pairs = reduce(lambda a, b: a.unionByName(b), [und.select(node(0).alias("a"), node(i).alias("b")) for i in range(1, len(keys))])
    comps = connected(pairs).withColumnRenamed("node", "_node")
    dealt = materialize(und.join(comps, node(0) == F.col("_node")).drop("_node"))
    largest = dealt.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    if largest <= CHAIN_CALLS:
        n = shuffle_parts(und.sparkSession)
        return dealt.repartition(n, "root").sortWithinPartitions("seq").select("seq", *keys).mapInArrow(_first_come, "seq long")
    parts = -(-largest // CHAIN_CALLS) + 1
    cuts = sorted(set(und.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]))
    won, left = [], und
    for high in [*cuts, None]:
        part = left if high is None else left.filter(F.col("seq") <= high)
        own = materialize(left.join(greedy_unique(part, keys), "seq", "left_semi"))
        won.append(own.select("seq"))
        if high is not None:
            left = left.filter(F.col("seq") > high)
            for k in keys:
                left = left.join(own.select(k).distinct(), k, "left_anti")
            left = materialize(left.select("seq", *keys))
    return reduce(lambda a, b: a.unionByName(b), won)


def add_orders(orders: DataFrame, cars: DataFrame, clients: DataFrame, adds: DataFrame,
               v_user: str, id_offset: int = 0) -> Result:
    """Open orders at the call time ``ts``; total = price x days to
    returned_at (negative if returned_at is in the past). The car's state
    is neither checked nor changed. New order id = id_offset + seq.

    Rejected: unknown car or client, no returned_at, client or car already
    in an open order, total out of range, or client or car taken by an
    earlier accepted call of the same batch (exactly as one-by-one
    application: see ``greedy_unique``)."""
    a = with_defaults(adds, S.ORDER_ADDS).join(_price(cars, "car_reg_num", "price"), "car_reg_num", "left")
    a = _has_key(a, clients, "client_pass", "pass", "_client_ok")
    a = _has_key(a, orders, "client_pass", "client_pass", "_client_busy")
    a = _has_key(a, orders, "car_reg_num", "car_reg_num", "_car_busy")
    num = as_int(micros_between("returned_at", "ts")) * cents("price")
    total = money_of_price_days(num, 2)
    valid = (F.col("price").isNotNull() & F.col("_client_ok") & F.col("returned_at").isNotNull()
             & ~F.col("_client_busy") & ~F.col("_car_busy") & (F.abs(total) < MAX_MONEY))
    a = materialize(a.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("total_price", total))
    ok = greedy_unique(a.filter("_valid"), ["client_pass", "car_reg_num"]).withColumn("_ok", F.lit(True))
    # Written once for the table, the log and the rejected calls.
    a = materialize(a.join(ok, "seq", "left").withColumn("_ok", F.coalesce(F.col("_ok"), F.lit(False))))
    acc = a.filter("_ok").select(
        "seq", "ts", (F.lit(id_offset) + F.col("seq")).cast("long").alias("id"), "client_pass",
        "car_reg_num", F.col("ts").alias("rented_at"), "returned_at", "total_price")
    new = orders.select(*ORDER_COLS).unionByName(
        acc.select(*[F.col(c).cast("decimal(10,2)") if c == "total_price" else F.col(c)
                     for c in ORDER_COLS]))
    hist = _history(acc, STATUS_OPEN, F.lit(NOTE_CREATED), v_user)
    rej = _rejects(a.filter(~F.col("_ok")), "add_order", F.col("client_pass"), F.lit(ERR_ADD_ORDER))
    return Result(new, rej, hist)


NEW = ["new_car", "new_price", "new_rented", "new_returned"]
STATE = ["car_reg_num", "price", "rented_at", "returned_at"]
START = ["car0", "price0", "rented0", "returned0"]
DEN = MICROS_PER_DAY            # (cents x micros) / DEN = cents
LIMIT_CENTS = MAX_MONEY * 100   # a total must stay under 10^8 (number(10,2))
CALL_COLS = ["seq", "ts", "id", "client_pass", *NEW, *START, "total0", "_init"]


def _deltas(s: DataFrame) -> DataFrame:
    """Exact per-call change of the total in cents, rounded half up
    (``_delta``), and whether it was an exact half-cent tie (``_tie``)."""
    num = (as_int(micros_between("prev_returned", "ts")) * (cents("price") - cents("prev_price"))
           + as_int(micros_between("returned_at", "prev_returned")) * cents("price"))
    return (s.withColumn("_delta", round_ratio_up(num, F.lit(DEN), 0))
            .withColumn("_tie", F.pmod(num, F.lit(DEN).cast("decimal(38,0)")) == F.lit(DEN // 2)))


REPLAY_COLS = ["seq", "ts", "id", "client_pass", "car_reg_num", "price", "rented_at", "returned_at",
               "prev_car", "prev_price", "prev_returned", "_tie", "_upper"]


def _round_ties(s: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Totals rounded half away from zero after every call.

    ``_upper`` is the running total with every half-cent tie rounded up;
    that is exact while the total stays non-negative. A tie at call j
    rounds down instead when the total is negative there, which is
    ``_upper_j <= D_{j-1}`` with D the number of earlier down-rounded
    ties. D is found as the fixpoint of prefix counts (it only grows from
    0, and each call depends on earlier ones only); the total is
    ``_upper - D``. One check skips all of it when no tie can be affected."""
    s = s.withColumn("_tie_i", F.col("_tie").cast("long"))
    s = materialize(SK.sum_before(s, "id", ["seq"], "_tie_i", "_ties_before", hot))
    risky = s.filter(F.col("_tie") & (F.col("_upper") <= F.col("_ties_before"))).limit(1).count()
    if risky == 0:
        return s.withColumn("total_price", units_to_decimal(F.col("_upper"), 2))
    d = s.select("seq", "id", "_tie", "_upper", F.lit(0).cast("long").alias("_dn"))
    while True:
        x = SK.sum_before(d, "id", ["seq"], "_dn", "_dprev", hot)
        x = x.withColumn("_dn2", (F.col("_tie") & (F.col("_upper") <= F.col("_dprev"))).cast("long"))
        changed = x.filter(F.col("_dn2") != F.col("_dn")).limit(1).count()
        d = materialize(x.select("seq", "id", "_tie", "_upper", F.col("_dn2").alias("_dn")))
        if changed == 0:
            break
    dd = SK.sum_before(d, "id", ["seq"], "_dn", "_dprev", hot).select(
        "seq", (F.col("_dprev") + F.col("_dn")).alias("_down"))
    return s.join(dd, "seq").withColumn("total_price",
                                        units_to_decimal(F.col("_upper") - F.col("_down"), 2))


def _replay(acc: DataFrame) -> DataFrame:
    """State after each accepted call, one window per order."""
    w = Window.partitionBy("id").orderBy("seq")
    wu = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = acc.select("seq", "ts", "id", "client_pass", "total0", "car0", "price0", "returned0", *[
        F.coalesce(F.last(n, True).over(wu), F.col(b)).alias(st) for n, st, b in zip(NEW, STATE, START)])
    s = s.select("*", *[F.coalesce(F.lag(st).over(w), F.col(b)).alias(p) for st, b, p in zip(
        ["car_reg_num", "price", "returned_at"], ["car0", "price0", "returned0"],
        ["prev_car", "prev_price", "prev_returned"])])
    s = _deltas(s)
    s = s.withColumn("_upper", (cents("total0") + F.sum("_delta").over(wu)).cast("decimal(38,0)"))
    return s.select(*REPLAY_COLS)


def _replay_split(acc: DataFrame) -> DataFrame:
    """Same as ``_replay`` for hot orders cut into seq-range pieces: each
    piece starts from the state carried from earlier pieces (last given
    values) and adds the earlier pieces' delta sum to its running total."""
    k = ["id", SK.PIECE]
    wp = Window.partitionBy(*k).orderBy("seq")
    wpu = wp.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = acc.join(SK.carry_last_given(acc, "id", "seq", NEW), k, "left")
    start = {st: F.coalesce(F.col(f"_carry.{n}"), F.col(b)) for n, st, b in zip(NEW, STATE, START)}
    s = j.select("seq", "ts", *k, "client_pass", "total0",
                 *[start[st].alias(f"_s_{st}") for st in STATE],
                 *[F.coalesce(F.last(n, True).over(wpu), start[st]).alias(st) for n, st in zip(NEW, STATE)])
    s = s.select("*", *[F.coalesce(F.lag(st).over(wp), F.col(f"_s_{st}")).alias(p) for st, p in zip(
        ["car_reg_num", "price", "returned_at"], ["prev_car", "prev_price", "prev_returned"])])
    s = _deltas(s)
    s = s.join(SK.carry_sum(s, "id", "_delta"), k, "left")
    s = s.withColumn("_upper", (cents("total0") + F.col("_carry_sum") + F.sum("_delta").over(wpu))
                     .cast("decimal(38,0)"))
    return s.select(*REPLAY_COLS)


def exact_car_rule(calls: DataFrame, orders: DataFrame, hot_o: DataFrame | None = None) -> DataFrame:
    """Accept flags (seq, _ok) of calls that pass their own checks, under
    the rule that a new car must not be held by another open order at the
    time of the call, exactly as one-by-one application in seq order.

    ``calls``: seq, id, new_car, car0, a starting guess ``_ok`` and, if known,
    the orders that hold new_car at the start (``_init``). Given
    flags, each order's car just before each call is the last accepted new
    car (a last-non-NULL scan per order); the holders of car X just before
    seq s are its start holders plus a running sum of +1 (accepted swap to
    X) and -1 (accepted swap away from X) per car. A swap is accepted when
    nobody but the caller holds X then. A call depends only on earlier
    calls, so the fixpoint is unique and equals one-by-one application;
    each round fixes at least the earliest wrong call, and the loop ends
    when no flag changes (from a good guess, after one round). Both scans
    split hot orders and hot cars into pieces (``plans.skew``)."""
    # Only swaps change holders, and a call without a new car passes here.
    swaps = calls.filter(F.col("new_car").isNotNull())
    if "_init" not in calls.columns:
        swaps = swaps.join(orders.groupBy(F.col("car_reg_num").alias("new_car")).agg(F.count(F.lit(1)).alias("_init")), "new_car", "left")
    cur = materialize(swaps.select("seq", "id", "new_car", "car0", "_init", "_ok"))
    hot_c = SK.hot_keys(cur, "new_car", "seq")
    hot_c = hot_c.withColumnRenamed("new_car", "_car") if hot_c is not None else None
    keep = ["id", "new_car", "car0", "_init"]
    none_l, none_s = F.lit(None).cast("long"), F.lit(None).cast("string")
    while True:
        c = cur.withColumn("_eff", F.when(F.col("_ok"), F.col("new_car")))
        c = SK.last_given_before(c, "id", "seq", "_eff", "car0", "_before", hot_o)
        if hot_o is not None or hot_c is not None:
            c = materialize(c)        # split scans reuse c several times: keep plans small

        def event(car, v):
            return F.struct(F.col(car).alias("_car"), F.col("seq"), F.lit(1).alias("_kind"),
                            F.lit(v).cast("long").alias("_v"), none_l.alias("_own"),
                            none_l.alias("id"), none_s.alias("new_car"), none_s.alias("car0"),
                            none_l.alias("_init"), F.lit(None).cast("boolean").alias("_was"))
        # query rows carry the call's columns, so no join back is needed
        query = F.struct(F.col("new_car").alias("_car"), F.col("seq"), F.lit(0).alias("_kind"),
                         F.lit(0).cast("long").alias("_v"),
                         (F.col("_before") == F.col("new_car")).cast("long").alias("_own"),
                         F.col("id"), F.col("new_car"), F.col("car0"), F.col("_init").cast("long").alias("_init"),
                         F.col("_ok").alias("_was"))
        # A call's rows come from one scan: the query, and two events if it moves the order.
        moved = F.col("_ok") & (F.col("new_car") != F.col("_before"))
        rows = c.select(F.inline(F.when(moved, F.array(query, event("new_car", 1), event("_before", -1)))
                                 .otherwise(F.array(query))))
        held = SK.sum_before(rows, "_car", ["seq", "_kind"], "_v", "_held", hot_c).filter("_kind = 0")
        free = (F.col("_held") + F.coalesce(F.col("_init"), F.lit(0)) - F.col("_own")) == 0
        cur = materialize(held.select("seq", *keep, free.alias("_ok"), "_was"))
        if cur.filter(F.col("_ok") != F.col("_was")).limit(1).count() == 0:
            flags = cur.select("seq", "_ok")
            return (calls.select("seq").join(flags, "seq", "left")
                    .select("seq", F.coalesce(F.col("_ok"), F.lit(True)).alias("_ok")))
        cur = cur.drop("_was")


def _round(cur: DataFrame, hot: DataFrame | None) -> DataFrame:
    """One round: from the flags ``_ok`` (accepted) and ``_dn`` (accepted
    half-cent tie that rounded down) of every call, each call's state
    before it (``_b_*``: the last accepted values of its order), its
    would-be state after it, and its exact candidate total in cents."""
    e = cur.select("*", *[F.when(F.col("_ok"), F.col(n)).alias(f"_e_{n}") for n in NEW])
    s = SK.scan_before(e, "id", "seq", {f"_b_{st}": (f"_e_{n}", b) for n, st, b in zip(NEW, STATE, START)},
                       {}, hot).drop(*[f"_e_{n}" for n in NEW])
    s = s.select("*", *[F.coalesce(F.col(n), F.col(f"_b_{st}")).alias(st) for n, st in zip(NEW, STATE)])
    num = (as_int(micros_between("_b_returned_at", "ts")) * (cents("price") - cents("_b_price"))
           + as_int(micros_between("returned_at", "_b_returned_at")) * cents("price"))
    s = (s.withColumn("_rup", round_ratio_up(num, F.lit(DEN), 0))
         .withColumn("_tie", F.pmod(num, F.lit(DEN).cast("decimal(38,0)")) == F.lit(DEN // 2))
         .withColumn("_okr", F.when(F.col("_ok"), F.col("_rup")))
         .withColumn("_dni", F.col("_dn").cast("long")))
    s = SK.scan_before(s, "id", "seq", {}, {"_u": "_okr", "_d": "_dni"}, hot).drop("_okr", "_dni")
    # running total before the call (every accepted call rounded half away
    # from zero), then this call's total, also rounded half away from zero
    x = cents("total0") + F.col("_u") - F.col("_d") + F.col("_rup")
    s = s.withColumn("_x", x.cast("decimal(38,0)"))
    return s.withColumn("_cand", F.col("_x") - F.when(F.col("_tie") & (F.col("_x") <= 0), 1).otherwise(0))


def exact_updates(calls: DataFrame, hot_o: DataFrame | None) -> DataFrame:
    """Accepted update calls with their state, exactly as one-by-one
    application in seq order, for calls that pass their own checks:

    * a new car must not be held by another open order at the call;
    * the total is rounded to cents half away from zero after every call;
    * a call whose total would leave number(10,2) is rejected.

    Flags per call, ``_ok`` (accepted) and ``_dn`` (accepted tie that
    rounded down), are iterated to their fixpoint: from the flags, ordered
    scans give each call's state before it, its total and the holders of
    its new car (a running +1/-1 sum per car); every call depends only on
    earlier calls, so the fixpoint is unique and equals one-by-one
    application. Each round fixes at least the earliest wrong call; the
    loop ends when no flag changes. ``calls`` carries a starting guess
    ``_ok``; each round is checkpointed; hot orders and cars are split."""
    cur = calls.select(*CALL_COLS, "_ok", F.lit(False).alias("_dn"))
    hot_c = SK.hot_keys(calls.filter(F.col("new_car").isNotNull()), "new_car", "seq")
    hot_c = hot_c.withColumnRenamed("new_car", "_car") if hot_c is not None else None
    none = F.lit(None).cast("long")
    while True:
        s = materialize(_round(cur, hot_o))
        moved = s.filter(F.col("_ok") & F.col("new_car").isNotNull()
                         & (F.col("new_car") != F.col("_b_car_reg_num")))
        rows = (moved.select("seq", F.col("new_car").alias("_car"), F.lit(1).alias("_kind"),
                             F.lit(1).cast("long").alias("_v"), none.alias("_own"), none.alias("_init"))
                .unionByName(moved.select("seq", F.col("_b_car_reg_num").alias("_car"), F.lit(1).alias("_kind"),
                                          F.lit(-1).cast("long").alias("_v"), none.alias("_own"),
                                          none.alias("_init")))
                .unionByName(s.filter(F.col("new_car").isNotNull()).select(
                    "seq", F.col("new_car").alias("_car"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_v"),
                    (F.col("_b_car_reg_num") == F.col("new_car")).cast("long").alias("_own"),
                    F.col("_init").cast("long").alias("_init"))))
        held = SK.sum_before(rows, "_car", ["seq", "_kind"], "_v", "_held", hot_c).filter("_kind = 0")
        held = held.select("seq", ((F.col("_held") + F.coalesce(F.col("_init"), F.lit(0)) - F.col("_own")) == 0)
                           .alias("_free"))
        j = s.join(held, "seq", "left")
        ok = F.coalesce(F.col("_free"), F.lit(True)) & (F.abs(F.col("_cand")) < LIMIT_CENTS)
        j = j.withColumn("_ok_n", ok)
        j = j.withColumn("_dn_n", F.col("_ok_n") & F.col("_tie") & (F.col("_x") <= 0))
        changed = j.filter((F.col("_ok_n") != F.col("_ok")) | (F.col("_dn_n") != F.col("_dn")))
        if changed.limit(1).count() == 0:
            return s
        cur = j.select(*CALL_COLS, F.col("_ok_n").alias("_ok"), F.col("_dn_n").alias("_dn"))


def update_orders(orders: DataFrame, cars: DataFrame, updates: DataFrame, v_user: str) -> Result:
    """Extend, swap car, fix the start; many calls per order replayed
    in seq order without a loop.

    Per call at time ts with current (car c0 at price p0, end r0):
    total += days(r0 - ts)*(p1 - p0) + days(r1 - r0)*p1, rounded to cents
    after every call (p1, r1: the new price and end; NULL means keep).
    The total is rounded to cents half away from zero after every call, as
    the reference's decimal column does (deltas are exact integer ratios).

    Rejected: unknown order, new returned_at before ts, unknown new car, a
    new car held by another open order at the time of the call, or a total
    that would leave number(10,2); later calls see the state without it,
    exactly as in one-by-one application (``exact_updates``).
    """
    o = orders.select("id", "client_pass", F.col("car_reg_num").alias("car0"),
                      F.col("rented_at").alias("rented0"), F.col("returned_at").alias("returned0"),
                      F.col("total_price").alias("total0"))
    calls = with_defaults(updates, S.ORDER_UPDATES).select(
        "seq", "ts", "id", F.col("car_reg_num").alias("new_car"),
        F.col("rented_at").alias("new_rented"), F.col("returned_at").alias("new_returned"))
    # Starting guess for the car rule (the fixpoint below makes it exact): a car held by
    # another order at batch start, or first asked for by another order, is
    # refused.
    holders = orders.groupBy(F.col("car_reg_num").alias("new_car")).agg(
        F.min("id").alias("_h_min"), F.max("id").alias("_h_max"), F.count(F.lit(1)).alias("_init"))
    first_req = (calls.filter(F.col("new_car").isNotNull()).groupBy("new_car")
                 .agg(F.min_by("id", F.col("seq")).alias("_first_req")))
    # The price of an order's car is joined to the order, not to each of its calls.
    u = calls.join(_join_given(o, "car0", _price(cars, "car0", "price0")), "id", "left")
    u = _join_given(u, "new_car", _price(cars, "new_car", "new_price"), holders, first_req)
    static = (F.col("car0").isNotNull() & F.col("price0").isNotNull()
              & (F.col("new_returned").isNull() | (F.col("new_returned") >= F.col("ts")))
              & (F.col("new_car").isNull() | F.col("new_price").isNotNull()))
    guess = (F.col("new_car").isNull()
             | ((F.col("_h_min").isNull()
                 | ((F.col("_h_min") == F.col("id")) & (F.col("_h_max") == F.col("id"))))
                & (F.col("_first_req") == F.col("id"))))
    u = materialize(u.withColumn("_static", F.coalesce(static, F.lit(False)))
                    .withColumn("_guess", F.coalesce(guess, F.lit(False))))
    # Orders with very many calls (one bounded list, reused by the scans).
    hot = SK.hot_keys(u, "id", "seq")
    # Fast path: car rule by fixpoint, then one replay with exact rounding.
    # It equals one-by-one application unless an accepted call's total
    # leaves number(10,2) (one check); only then the full fixpoint runs,
    # where such calls are rejected and later calls see the state without
    # them.
    flags = exact_car_rule(u.filter("_static").select("seq", "id", "new_car", "car0", "_init",
                                                      F.col("_guess").alias("_ok")), orders, hot)
    uf = u.join(flags, "seq", "left").withColumn("_ok0", F.coalesce(F.col("_ok"), F.lit(False)))
    acc = uf.filter("_ok0")
    if hot is None:
        s = _replay(acc)
    else:
        cold, warm = SK.split(acc, "id", "seq", hot)
        s = _replay(cold).unionByName(_replay_split(warm))
    s = _round_ties(s, hot)
    if s.filter(F.abs(cents("total_price")) >= LIMIT_CENTS).limit(1).count() > 0:
        calls = u.filter("_static").select(*CALL_COLS, F.col("_guess").alias("_ok"))
        done = exact_updates(calls, hot)
        s = done.filter("_ok").withColumn("total_price", units_to_decimal(F.col("_cand"), 2)).select(
            "seq", "ts", "id", "client_pass", *STATE, F.col("_b_car_reg_num").alias("prev_car"),
            F.col("_b_returned_at").alias("prev_returned"), "total_price")
        uf = u.join(done.select("seq", F.col("_ok").alias("_okf")), "seq", "left") \
            .withColumn("_ok0", F.coalesce(F.col("_okf"), F.lit(False)))
    u = uf
    hist = _history(
        s, STATUS_OPEN,
        change_note(F.col("client_pass"), F.col("prev_car"), F.col("prev_returned"),
                    F.col("client_pass"), F.col("car_reg_num"), F.col("returned_at")),
        v_user)
    last = s.groupBy("id").agg(F.max_by(F.struct("car_reg_num", "rented_at", "returned_at", "total_price"),
                                        F.col("seq")).alias("_s"))
    j = orders.select(*ORDER_COLS).join(last, "id", "left")
    new = j.select(
        "id", "client_pass",
        *[F.coalesce(F.col(f"_s.{c}"), F.col(c)).alias(c) for c in ["car_reg_num", "rented_at", "returned_at"]],
        F.coalesce(F.col("_s.total_price"), F.col("total_price")).cast("decimal(10,2)").alias("total_price"))
    rej = _rejects(u.filter(~F.col("_ok0")), "update_order", F.col("id"), F.lit(ERR_UPDATE_ORDER))
    return Result(new, rej, hist)


def close_orders(orders: DataFrame, deletes: DataFrame, v_user: str) -> Result:
    """Remove open orders; each closes with a '1' history row holding
    the order's last values (price unchanged). Unknown ids and repeated
    deletes are silent no-ops; the car's state is not touched."""
    deletes = with_defaults(deletes, S.ORDER_DELETES)
    first = deletes.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    d = materialize(first.filter(F.col("id").isNotNull() & F.col("seq").isNotNull()))
    gone = orders.select(*ORDER_COLS).join(d, "id")
    hist = _history(gone, STATUS_CLOSED, F.lit(NOTE_RETURNED), v_user)
    new = orders.select(*ORDER_COLS).join(d.select("id"), "id", "left_anti")
    empty = deletes.limit(0)
    return Result(new, _rejects(empty, "del_order", F.col("id"), F.lit("")), hist)
