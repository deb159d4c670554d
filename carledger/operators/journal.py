"""One journal of mixed calls: all nine verbs in one sequence.

A journal row is one call: ``seq`` (its place in the sequence), ``ts`` (its
clock), ``verb`` and the verb's arguments. The result is what applying the
calls one by one gives: a car added by one call can be rented, swapped and
deleted by later ones.

Calls that name a common car, client or order depend on each other; all
others do not. So the calls form components: keys are nodes, a call joins
the keys that it names, an open order that calls can change joins its car
and its client. Every component goes to one task with the rows of the tables
that it names, and is folded there in ``seq`` order (a few dictionaries, the
rules below). A task folds all its components in one pass.

A component with more than ``FOLD_CALLS`` calls does not go to one task as a
whole: the others are folded, its calls are cut at quantiles of ``seq`` into
a few parts that are applied one after the other, and in each the components
are found anew. Within a part they are smaller, as fewer calls join them, and
most fall apart after a few cuts; only one that does not is cut again. These
parts are applied to the rows that such components can see, not to the whole
tables: what they changed goes into the tables with what was folded before.

A journal of more than 4 * ``FOLD_CALLS`` calls is cut at once into up to
``FIRST_PARTS`` parts: components of the whole of it would mostly be found
only to be cut. These parts do not grow in number with the journal, so the
tables are written a bounded number of times.

Rules of the calls (a rejected call changes nothing):

* ``add_car``, ``add_client``: the key is free, all values are given and fit.
* ``update_car``, ``update_client``: the key exists, values fit; NULL keeps.
* ``del_car``: it exists, is not rented (state 2) and in no open order;
  ``del_client``: no open order (an unknown client is no error).
* ``add_order`` (``pass``, ``reg_num``, ``returned_at``): car and client exist,
  neither is in an open order, total = price x days to the end. Its id is
  ``id_offset + seq``; later calls may name it.
* ``update_order`` (``id``; ``reg_num``, ``rented_at``, ``returned_at``): the order
  exists, a new end is not before the call, a new car exists and is in no
  other open order; total += days left x price difference + days added x
  new price, rounded to cents half away from zero.
* ``del_order``: an unknown order is no error.
* A total must stay within number(10,2). Prices are those at the call.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carledger import schema as S
from carledger.functions.fixed import (
    ERR_ADD_CAR, ERR_ADD_CLIENT, ERR_ADD_ORDER, ERR_DEL_CAR, ERR_DEL_CAR_BUSY, ERR_DEL_CLIENT, ERR_UPDATE_CAR,
    ERR_UPDATE_CLIENT, ERR_UPDATE_ORDER, NOTE_CAR_CHANGED, NOTE_CREATED, NOTE_RENEWED, NOTE_RETURNED, RENTED,
    STATUS_CLOSED, STATUS_OPEN, WAITING,
)
from carledger.functions.timefn import MICROS_PER_DAY, micros_between
from carledger.operators.commands import CAR_COLS, CLIENT_COLS, MAX_MONEY, ORDER_COLS, _len_ok, _money_ok, with_defaults
from carledger.operators.history import HISTORY_COLS
from carledger.plans.components import connected
from carledger.plans.joins import materialize, staged
from carledger.session import ship_package, shuffle_parts

#: Most calls of a component that one task folds.
FOLD_CALLS = 500_000
#: Most parts that a journal is cut into before its components are known.
FIRST_PARTS = 8

VERBS = ("add_car", "update_car", "del_car", "add_client", "update_client", "del_client", "add_order", "update_order", "del_order")
EPOCH = "1970-01-01 00:00:00"


class JournalResult(NamedTuple):
    cars: DataFrame
    clients: DataFrame
    orders: DataFrame
    history: DataFrame
    rejects: DataFrame


# ------------------------------------------------------------------- the fold

#: kind 0: an open order, 1: a car, 2: a client (as they are), 3: a call.
ROW = ("kind int, seq long, verb string, own boolean, ts long, car string, client string, oid long, color string, "
       "mark string, type string, cents long, state int, served long, name string, rented long, returned long")
#: kind h: a log row, r: a reject, c, p, o: a car, client, order that changed.
OUT = ("kind string, gone boolean, seq long, verb string, key string, err string, ts long, status string, note string, "
       "car string, client string, oid long, color string, mark string, type string, cents long, state int, "
       "served long, name string, rented long, returned long")
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_OUT = [x.split() for x in OUT.split(", ")]


def round_away(num: int, den: int) -> int:
    q = (2 * abs(num) + den) // (2 * den)
    return q if num >= 0 else -q


class Fleet:
    """The rows of some components, changed call by call. A verb gives the
    error text of a call that is rejected."""

    def __init__(self):
        self.cars, self.clients, self.orders = {}, {}, {}
        self.of_client, self.of_car = {}, {}
        self.changed = {"c": set(), "p": set(), "o": set()}
        self.out: list[dict] = []

    def put_order(self, oid, o):
        old = self.orders.get(oid)
        if old is not None:
            self.drop_order(oid)
        self.orders[oid] = o
        self.of_client.setdefault(o["client"], set()).add(oid)
        self.of_car.setdefault(o["car"], set()).add(oid)

    def drop_order(self, oid):
        o = self.orders.pop(oid)
        self.of_client[o["client"]].discard(oid)
        self.of_car[o["car"]].discard(oid)
        return o

    def log(self, r, oid, o, status, note):
        self.out.append({"kind": "h", "seq": r["seq"], "ts": r["ts"], "oid": oid, "status": status, "note": note, **o})

    def add_car(self, r):
        if not r["own"] or r["car"] in self.cars:
            return ERR_ADD_CAR
        self.cars[r["car"]] = {k: r[k] for k in ("color", "mark", "type", "cents")} | {"state": WAITING, "served": r["ts"] // 1_000_000 * 1_000_000}
        self.changed["c"].add(r["car"])

    def update_car(self, r):
        car = self.cars.get(r["car"])
        if not r["own"] or car is None:
            return ERR_UPDATE_CAR
        car.update({k: r[k] for k in ("color", "mark", "type", "cents", "state", "served") if r[k] is not None})
        self.changed["c"].add(r["car"])

    def del_car(self, r):
        car = self.cars.get(r["car"])
        if car is not None and car["state"] == RENTED:
            return ERR_DEL_CAR_BUSY
        if car is None or self.of_car.get(r["car"]):
            return ERR_DEL_CAR
        del self.cars[r["car"]]
        self.changed["c"].add(r["car"])

    def add_client(self, r):
        if not r["own"] or r["client"] in self.clients:
            return ERR_ADD_CLIENT
        self.clients[r["client"]] = r["name"]
        self.changed["p"].add(r["client"])

    def update_client(self, r):
        if not r["own"] or r["client"] not in self.clients:
            return ERR_UPDATE_CLIENT
        if r["name"] is not None:
            self.clients[r["client"]] = r["name"]
            self.changed["p"].add(r["client"])

    def del_client(self, r):
        if self.of_client.get(r["client"]):
            return ERR_DEL_CLIENT
        if self.clients.pop(r["client"], None) is not None:
            self.changed["p"].add(r["client"])

    def add_order(self, r):
        car = self.cars.get(r["car"])
        if (not r["own"] or car is None or r["client"] not in self.clients or r["oid"] in self.orders
                or self.of_client.get(r["client"]) or self.of_car.get(r["car"])):
            return ERR_ADD_ORDER
        total = round_away((r["returned"] - r["ts"]) * car["cents"], MICROS_PER_DAY)
        if abs(total) >= MAX_MONEY * 100:
            return ERR_ADD_ORDER
        o = {"client": r["client"], "car": r["car"], "rented": r["ts"], "returned": r["returned"], "cents": total}
        self.put_order(r["oid"], o)
        self.changed["o"].add(r["oid"])
        self.log(r, r["oid"], o, STATUS_OPEN, NOTE_CREATED)

    def update_order(self, r):
        o = self.orders.get(r["oid"])
        old = self.cars.get(o["car"]) if o else None
        new = old if r["car"] is None else self.cars.get(r["car"])
        if not r["own"] or old is None or new is None:
            return ERR_UPDATE_ORDER
        if r["car"] is not None and self.of_car.get(r["car"], set()) - {r["oid"]}:
            return ERR_UPDATE_ORDER
        n = {"client": o["client"], "car": r["car"] or o["car"], "rented": o["rented"] if r["rented"] is None else r["rented"],
             "returned": o["returned"] if r["returned"] is None else r["returned"]}
        n["cents"] = round_away(o["cents"] * MICROS_PER_DAY + (o["returned"] - r["ts"]) * (new["cents"] - old["cents"])
                                + (n["returned"] - o["returned"]) * new["cents"], MICROS_PER_DAY)
        if abs(n["cents"]) >= MAX_MONEY * 100:
            return ERR_UPDATE_ORDER
        note = NOTE_CAR_CHANGED if n["car"] != o["car"] else NOTE_RENEWED if n["returned"] != o["returned"] else None
        self.put_order(r["oid"], n)
        self.changed["o"].add(r["oid"])
        self.log(r, r["oid"], n, STATUS_OPEN, note)

    def del_order(self, r):
        if r["oid"] in self.orders:
            o = self.drop_order(r["oid"])
            self.changed["o"].add(r["oid"])
            self.log(r, r["oid"], o, STATUS_CLOSED, NOTE_RETURNED)


def _key_of(r: dict) -> str | None:
    kind = r["verb"].split("_")[1]
    if r["verb"] == "add_order" or kind == "client":
        return r["client"]
    return r["car"] if kind == "car" else None if r["oid"] is None else str(r["oid"])


def _values(col: pa.Array) -> list:
    """The values of a column as a list, made by the column and not one by one."""
    if col.null_count == len(col):
        return [None] * len(col)
    if pa.types.is_string(col.type) or not col.null_count:
        return col.to_numpy(zero_copy_only=False).tolist()
    out = col.fill_null(False if pa.types.is_boolean(col.type) else 0).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(col.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


#: Columns of the outcomes of a kind; the others are NULL.
_ORDER_VALUES = ("oid", "client", "car", "rented", "returned", "cents")
_OF_KIND = {"h": ("seq", "ts", "status", "note", *_ORDER_VALUES), "r": ("seq", "verb", "key", "err"),
            "c": ("car", "gone", "color", "mark", "type", "cents", "state", "served"), "p": ("client", "gone", "name"),
            "o": ("gone", *_ORDER_VALUES)}


def _flushed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Outcomes, a batch for each kind."""
    for kind, own in _OF_KIND.items():
        some = [r for r in rows if r["kind"] == kind]
        n = len(some)
        if n:
            yield pa.record_batch([pa.array([kind] * n) if c == "kind" else pa.array([r.get(c) for r in some], _TYPES[t]) if c in own
                                   else pa.nulls(n, _TYPES[t]) for c, t in _OUT], names=[c for c, _ in _OUT])


def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows first, then calls by seq (``ROW``) to outcomes (``OUT``).
    Its many small rows hold no cycles: the collector need not look for them."""
    gc.disable()
    try:
        yield from _folded(it)
    finally:
        gc.enable()


def _folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fleet = Fleet()
    apply = {verb: getattr(fleet, verb) for verb in VERBS}
    for batch in it:
        names = batch.schema.names
        for row in zip(*map(_values, batch.columns)):
            kind, seq, verb, own, ts, car, client, oid, color, mark, type_, cents, state, served, name, rented, returned = row
            if kind == 0:
                fleet.put_order(oid, {"client": client, "car": car, "rented": rented, "returned": returned, "cents": cents})
            elif kind == 1:
                fleet.cars[car] = {"color": color, "mark": mark, "type": type_, "cents": cents, "state": state, "served": served}
            elif kind == 2:
                fleet.clients[client] = name
            else:
                r = dict(zip(names, row))
                err = apply[verb](r)
                if err is not None:
                    fleet.out.append({"kind": "r", "seq": seq, "verb": verb, "key": _key_of(r), "err": err})
        if len(fleet.out) > 10_000:
            yield from _flushed(fleet.out)
            fleet.out.clear()
    rows = fleet.out
    for k in fleet.changed["c"]:
        rows.append({"kind": "c", "car": k, "gone": k not in fleet.cars, **fleet.cars.get(k, {})})
    for k in fleet.changed["p"]:
        rows.append({"kind": "p", "client": k, "gone": k not in fleet.clients, "name": fleet.clients.get(k)})
    for k in fleet.changed["o"]:
        rows.append({"kind": "o", "oid": k, "gone": k not in fleet.orders, **fleet.orders.get(k, {})})
    for i in range(0, len(rows), 10_000):
        yield from _flushed(rows[i:i + 10_000])


# ---------------------------------------------------------------- the journal

def _micros(c: str) -> Column:
    return micros_between(c, F.lit(EPOCH).cast("timestamp_ntz"))


def _time(c: str) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        (F.floor(F.col(c) / MICROS_PER_DAY)).cast("int"), F.lit(0), F.lit(0),
        (F.pmod(F.col(c), F.lit(MICROS_PER_DAY)).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))


def _cents(c: str) -> Column:
    return (F.col(c) * 100).cast("long")


def _money(c: str) -> Column:
    return (F.col(c).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,2)")


def _node(kind: str, c: str) -> Column:
    """A number for a key. Two keys with one number would share a component,
    which changes no outcome."""
    return F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(kind), F.col(c).cast("string")))


def _rows(df: DataFrame, kind: int, **cols) -> DataFrame:
    fields = [x.split() for x in ROW.split(", ")]
    return df.select("comp", *[(F.lit(kind) if c == "kind" else cols[c] if c in cols else F.lit(None)).cast(t).alias(c) for c, t in fields])


def prepared(journal: DataFrame, car_states: DataFrame, id_offset: int) -> DataFrame:
    """Calls with typed arguments, ``own`` (values fit by themselves) and
    ``keys``, the nodes that they name."""
    j = with_defaults(journal, S.JOURNAL, {"state_id": WAITING})
    states = car_states.select(F.col("id").alias("state_id"), F.lit(True).alias("_known"))
    j = j.join(F.broadcast(states), "state_id", "left")
    given = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs])
    fits = _len_ok("color", 20) & _len_ok("mark", 20) & _len_ok("type", 20) & _money_ok("price")
    verb = F.col("verb")
    own = (F.when(verb == "add_car", given("reg_num", "color", "mark", "type", "price") & (F.length("reg_num") <= 10) & fits)
           .when(verb == "update_car", fits & (F.col("state_id").isNull() | F.col("_known").isNotNull()))
           .when(verb == "add_client", given("pass", "name") & (F.length("pass") <= 10) & _len_ok("name", 40))
           .when(verb == "update_client", _len_ok("name", 40))
           .when(verb == "add_order", given("returned_at"))
           .when(verb == "update_order", F.col("returned_at").isNull() | (F.col("returned_at") >= F.col("ts")))
           .otherwise(True))
    oid = F.when(verb == "add_order", F.lit(id_offset) + F.col("seq")).when(verb.isin("update_order", "del_order"), F.col("id"))
    j = j.withColumn("oid", oid.cast("long")).withColumn("own", F.coalesce(own, F.lit(False)))
    car, client = verb.endswith("car") | verb.isin("add_order", "update_order"), verb.endswith("client") | (verb == "add_order")
    keys = F.array_compact(F.array(_node("o", "oid"), F.when(car, _node("k", "reg_num")), F.when(client, _node("c", "pass"))))
    # A call that names nothing stands alone.
    return j.withColumn("keys", F.when(F.size(keys) > 0, keys).otherwise(F.array(_node("s", "seq"))))


def _outcomes(cars: DataFrame, clients: DataFrame, orders: DataFrame, calls: DataFrame,
              whole: bool) -> tuple[DataFrame, DataFrame | None, tuple | None]:
    """(a written table of outcomes, a written table of the calls of
    components that are more than one task folds, which have no outcomes
    yet, or None, and the rows of the three tables that these calls can
    see). ``whole``: fold every component."""
    spark = calls.sparkSession
    binds = F.col("verb").isin("add_order", "del_client")
    # ``n``: calls that name the node first.
    named = materialize(calls.select(F.posexplode("keys").alias("place", "node"), binds.alias("b"))
                        .groupBy("node").agg(F.max("b").alias("b"), F.count_if(F.col("place") == 0).alias("n")))
    # Open orders that a call names, or whose car or client one does.
    held = orders.select(*ORDER_COLS, _node("o", "id").alias("o"), _node("k", "car_reg_num").alias("k"), _node("c", "client_pass").alias("c"))
    for n in ("o", "k", "c"):
        held = held.join(named.select(F.col("node").alias(n), F.col("b").alias(f"b_{n}")), n, "left")
    held = materialize(held.filter("b_o is not null or b_k is not null or b_c is not null"))
    first = F.element_at("keys", 1)
    tied = calls.select(first.alias("a"), F.explode(F.slice("keys", 2, 3)).alias("b"))
    # A named order can change whose car it holds and whether its client has one.
    can = held.filter("b_o is not null")
    tied = (tied.unionByName(can.filter("b_k is not null").select(F.col("o").alias("a"), F.col("k").alias("b")))
            .unionByName(can.filter("b_c").select(F.col("o").alias("a"), F.col("c").alias("b"))))
    comps = connected(tied)
    label = materialize(named.join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "n"))
    large = label.groupBy("comp").agg(F.sum("n").alias("n")).filter(F.col("n") > FOLD_CALLS).select("comp")
    label = label.drop("n")
    mine, rest, own = calls.withColumn("node", first).join(label, "node"), None, None

    def seen_by(label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(open orders with the components that must see them, nodes of cars
        and clients with those that name them or, for its price, hold a car)."""
        nodes = F.array_compact(F.array(*[F.when(F.col(f"b_{n}").isNotNull(), F.col(n)) for n in ("o", "k", "c")]))
        dealt = (held.withColumn("node", F.explode(nodes)).join(label, "node")
                 .select("comp", *ORDER_COLS, "k", "b_o", "b_k").distinct())
        priced = dealt.filter("b_o is not null and b_k is null").select(F.col("k").alias("node"), "comp")
        return dealt, label.select("node", "comp").unionByName(priced).distinct()

    cars = cars.select(*CAR_COLS, _node("k", "reg_num").alias("node"))
    clients = clients.select(*CLIENT_COLS, _node("c", "pass").alias("node"))
    if not whole:
        large = materialize(large)
        if not large.isEmpty():
            rest = staged(mine.join(large, "comp", "left_semi").select(*calls.columns))
            dealt, wanted = seen_by(label.join(large, "comp", "left_semi"))
            own = tuple(staged(df) for df in (
                cars.join(wanted, "node", "left_semi").select(*CAR_COLS), clients.join(wanted, "node", "left_semi").select(*CLIENT_COLS),
                dealt.select(*ORDER_COLS).distinct()))
            mine, label = mine.join(large, "comp", "left_anti"), label.join(large, "comp", "left_anti")
    dealt, wanted = seen_by(label)
    order_rows = _rows(dealt, 0, oid=F.col("id"), client=F.col("client_pass"), car=F.col("car_reg_num"), rented=_micros("rented_at"),
                       returned=_micros("returned_at"), cents=_cents("total_price"))
    car_rows = cars.join(wanted, "node")
    car_rows = _rows(car_rows, 1, car=F.col("reg_num"), color=F.col("color"), mark=F.col("mark"), type=F.col("type"), cents=_cents("price"),
                     state=F.col("state_id"), served=_micros("tech_serv_date"))
    client_rows = clients.join(label, "node")
    client_rows = _rows(client_rows, 2, client=F.col("pass"), name=F.col("name"))
    call_rows = _rows(mine, 3, seq=F.col("seq"), verb=F.col("verb"), own=F.col("own"), ts=_micros("ts"), car=F.col("reg_num"),
                      client=F.col("pass"), oid=F.col("oid"), color=F.col("color"), mark=F.col("mark"), type=F.col("type"), cents=_cents("price"),
                      state=F.col("state_id"), served=_micros("tech_serv_date"), name=F.col("name"), rented=_micros("rented_at"),
                      returned=_micros("returned_at"))
    rows = reduce(lambda a, b: a.unionByName(b), [order_rows, car_rows, client_rows, call_rows])
    parts = shuffle_parts(spark)
    ship_package(spark)
    dealt_out = rows.repartition(parts, "comp").sortWithinPartitions("kind", "seq").drop("comp")
    return staged(dealt_out.mapInArrow(fold, OUT)), rest, own


def _changed(table: DataFrame, out: DataFrame, key: str, kind: str, col: str, cols: list[Column]) -> DataFrame:
    own = out.filter(F.col("kind") == kind)
    kept = table.join(own.select(F.col(col).alias(key)), key, "left_anti").select(*table.columns)
    return kept.unionByName(own.filter("not gone").select(*cols))


def _order_out() -> list[Column]:
    return [F.col("client").alias("client_pass"), F.col("car").alias("car_reg_num"), _time("rented").alias("rented_at"),
            _time("returned").alias("returned_at"), _money("cents").alias("total_price")]


def _tables(cars: DataFrame, clients: DataFrame, orders: DataFrame, done: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with what outcomes changed, those of later parts last."""
    out = done[0]
    if len(done) > 1:
        rows = [df.filter(F.col("kind").isin("c", "p", "o")).withColumn("turn", F.lit(i)) for i, df in enumerate(done)]
        key = F.coalesce("car", "client", F.col("oid").cast("string"))
        key = F.when(F.col("kind") == "o", F.col("oid").cast("string")).otherwise(key)
        out = (reduce(lambda a, b: a.unionByName(b), rows).groupBy("kind", key.alias("_key"))
               .agg(F.max_by(F.struct(*[c for c in done[0].columns if c != "kind"]), "turn").alias("last")).select("kind", "last.*"))
    return (_changed(cars, out, "reg_num", "c", "car", [
                F.col("car").alias("reg_num"), F.col("state").alias("state_id"), "color", "mark", "type", _money("cents").alias("price"),
                _time("served").alias("tech_serv_date")]),
            _changed(clients, out, "pass", "p", "client", [F.col("client").alias("pass"), "name"]),
            _changed(orders, out, "id", "o", "oid", [F.col("oid").alias("id"), *_order_out()]))


def apply_journal(cars: DataFrame, clients: DataFrame, orders: DataFrame, journal: DataFrame, car_states: DataFrame,
                  v_user: str, id_offset: int = 0) -> JournalResult:
    """The three tables after all calls, the log rows of the order verbs and
    the rejected calls, all from one run. ``seq`` is unique; a verb that is
    none of ``VERBS`` is an error."""
    calls = staged(prepared(journal, car_states, id_offset))
    other = calls.filter(~F.col("verb").isin(*VERBS) | F.col("verb").isNull()).select("verb").first()
    if other is not None:
        raise ValueError(f"not a verb: {other['verb']}")
    return _apply(cars.select(*CAR_COLS), clients.select(*CLIENT_COLS), orders.select(*ORDER_COLS), calls, v_user)


def _cut(calls: DataFrame, parts: int) -> list[tuple[DataFrame, bool]]:
    """Calls in parts by quantiles of ``seq``, in its order. A part of one
    ``seq`` alone cannot be cut."""
    about = calls.agg(F.min("seq"), F.max("seq"), F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10 * parts)).first()
    low, high = about[0], about[1]
    if low == high:
        return [(calls, True)]
    cuts = sorted({c for c in about[2] if c < high}) or [low]
    seq = F.col("seq")
    first = seq.isNull() | (seq <= cuts[0])
    return [(calls.filter(p), False) for p in [first, *[(seq > a) & (seq <= b) for a, b in zip(cuts, cuts[1:])], seq > cuts[-1]]]


def _in_parts(tables: tuple, parts: list[tuple[DataFrame, bool]]) -> tuple[list[DataFrame], tuple]:
    """(written outcomes in their order, the tables after them) of parts that
    are applied one after the other."""
    done = []
    for i, (part, whole) in enumerate(parts):
        out, rest, own = _outcomes(*tables, part, whole)
        new = [out]
        if rest is not None:
            # What was folded and what is left name no common row.
            new += _in_parts(own, _cut(rest, 2 if rest.count() <= 4 * FOLD_CALLS else 4))[0]
        done += new
        tables = _tables(*tables, new)
        if i < len(parts) - 1:
            tables = tuple(staged(df) for df in tables)
    return done, tables


def _apply(cars: DataFrame, clients: DataFrame, orders: DataFrame, calls: DataFrame, v_user: str) -> JournalResult:
    n = calls.count()
    parts = [(calls, False)] if n <= 4 * FOLD_CALLS else _cut(calls, min(FIRST_PARTS, -(-n // FOLD_CALLS)))
    done, (cars, clients, orders) = _in_parts((cars, clients, orders), parts)
    out = reduce(lambda a, b: a.unionByName(b), done)
    history = out.filter("kind = 'h'").select(
        F.col("seq").alias("id"), F.col("oid").alias("order_id"), _time("ts").alias("changed_at"), *_order_out(), "status", "note",
        F.lit(v_user).alias("v_user")).select(*HISTORY_COLS)
    rejects = out.filter("kind = 'r'").select("seq", F.col("verb").alias("op"), "key", "err")
    return JournalResult(cars, clients, orders, history, rejects)
