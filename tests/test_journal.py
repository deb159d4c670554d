"""The journal of mixed calls against a plain one-by-one program."""

import random
from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
import pytest
from conftest import D, M

from carledger import schema as S
from carledger.operators import commands as C
from carledger.operators import journal as J
from carledger.plans import components as K
from carledger.plans import joins

T0 = datetime(2024, 3, 1)
ARGS = [f.name for f in S.JOURNAL.fields]


def days(a, b):
    d = a - b
    return Fraction((d.days * 86400 + d.seconds) * 10 ** 6 + d.microseconds, 86400 * 10 ** 6)


def money(x):
    n = abs(x) * 100
    q = int(n) + (n - int(n) >= Fraction(1, 2))
    return Decimal(q if x >= 0 else -q).scaleb(-2)


def one_by_one(cars, clients, orders, calls, offset):
    cars, clients, orders = ({k: list(v) for k, v in t.items()} for t in (cars, clients, orders))
    log, rejects = [], []
    for c in sorted(calls, key=lambda c: c["seq"]):
        v, car, cl, oid, err = c["verb"], c["reg_num"], c["pass"], c["id"], None
        fits = all(c[k] is None or len(c[k]) <= 20 for k in ("color", "mark", "type")) and (c["price"] is None or abs(c["price"]) < 10 ** 8)
        if v == "add_car":
            if None in (car, c["color"], c["mark"], c["type"], c["price"]) or not fits or len(car) > 10 or car in cars:
                err = "err: pcrud.add_car"
            else:
                cars[car] = [1, c["color"], c["mark"], c["type"], c["price"], c["ts"].replace(microsecond=0)]
        elif v == "update_car":
            if car not in cars or not fits or c["state_id"] not in (None, 1, 2, 3):
                err = "err: pcrud.update_car"
            else:
                new = [c[k] for k in ("state_id", "color", "mark", "type", "price", "tech_serv_date")]
                cars[car] = [o if n is None else n for n, o in zip(new, cars[car])]
        elif v == "del_car":
            if car in cars and cars[car][0] == 2:
                err = "err: pcrud.del_car: the car is used by a client."
            elif car not in cars or any(o[1] == car for o in orders.values()):
                err = "err: pcrud.del_car"
            else:
                del cars[car]
        elif v == "add_client":
            if None in (cl, c["name"]) or len(cl) > 10 or len(c["name"]) > 40 or cl in clients:
                err = "err: pcrud.add_client"
            else:
                clients[cl] = [c["name"]]
        elif v == "update_client":
            if cl not in clients or len(c["name"] or "") > 40:
                err = "err: pcrud.update_client"
            elif c["name"] is not None:
                clients[cl] = [c["name"]]
        elif v == "del_client":
            if any(o[0] == cl for o in orders.values()):
                err = "err: pcrud.del_client"
            else:
                clients.pop(cl, None)
        elif v == "add_order":
            oid = offset + c["seq"]
            busy = any(o[0] == cl or o[1] == car for o in orders.values())
            total = None if car not in cars or c["returned_at"] is None else money(days(c["returned_at"], c["ts"]) * Fraction(cars[car][4]))
            if total is None or cl not in clients or busy or abs(total) >= 10 ** 8:
                err = "err: pcrud.add_order"
            else:
                orders[oid] = [cl, car, c["ts"], c["returned_at"], total]
                log.append((c["seq"], oid, c["ts"], *orders[oid][:4], "0", total, "order was created."))
        elif v == "update_order":
            o, err = orders.get(oid), "err: pcrud.update_order"
            if o and o[1] in cars and not (c["returned_at"] and c["returned_at"] < c["ts"]) and (car is None or car in cars) \
                    and not any(p[1] == car for k, p in orders.items() if k != oid):
                p0, p1 = Fraction(cars[o[1]][4]), Fraction(cars[car or o[1]][4])
                ret = c["returned_at"] or o[3]
                total = money(Fraction(o[4]) + days(o[3], c["ts"]) * (p1 - p0) + days(ret, o[3]) * p1)
                if abs(total) < 10 ** 8:
                    note = "client changed a car." if car and car != o[1] else "client renewed a car." if ret != o[3] else None
                    orders[oid] = [o[0], car or o[1], c["rented_at"] or o[2], ret, total]
                    log.append((c["seq"], oid, c["ts"], *orders[oid][:4], "0", total, note))
                    err = None
        elif oid in orders:
            o = orders.pop(oid)
            log.append((c["seq"], oid, c["ts"], *o[:4], "1", o[4], "client returned a car."))
        if err:
            kind = v.split("_")[1]
            key = cl if v == "add_order" or kind == "client" else car if kind == "car" else None if oid is None else str(oid)
            rejects.append((c["seq"], v, key, err))
    return cars, clients, orders, log, rejects


def tables(spark, cars, clients, orders):
    return (spark.createDataFrame([(k, *v) for k, v in cars.items()], S.CARS).repartition(3),
            spark.createDataFrame([(k, *v) for k, v in clients.items()], S.CLIENTS),
            spark.createDataFrame([(k, *v) for k, v in orders.items()], S.ORDERS).repartition(3))


def check(spark, cars, clients, orders, calls, offset=1000):
    want = one_by_one(cars, clients, orders, calls, offset)
    df = spark.createDataFrame([tuple(c[a] for a in ARGS) for c in calls], S.JOURNAL).repartition(4)
    from carledger.operators.quality import car_states
    r = J.apply_journal(*tables(spark, cars, clients, orders), df, car_states(spark), "U", offset)
    for got, exp in zip(r[:3], want[:3]):
        assert sorted(tuple(x) for x in got.collect()) == sorted((k, *v) for k, v in exp.items())
    log = sorted((x.id, x.order_id, x.changed_at, x.client_pass, x.car_reg_num, x.rented_at, x.returned_at, x.status,
                  x.total_price, x.note) for x in r.history.collect())
    assert log == sorted(want[3]) and {x.v_user for x in r.history.collect()} <= {"U"}
    assert sorted(map(tuple, r.rejects.collect())) == sorted(want[4])
    return want


def call(seq, verb, ts=T0, **args):
    return {**dict.fromkeys(ARGS), "seq": seq, "ts": ts, "verb": verb, **args}


def random_journal(rng, n, keys):
    cars = {f"K{i}": [rng.randint(1, 3), "red", "m", "t", Decimal(rng.randint(1, 10 ** 6)).scaleb(-2), T0] for i in range(keys)}
    clients = {f"P{i}": [f"n{i}"] for i in range(keys)}
    orders = {}
    for i in range(1, keys):        # some clients and cars hold two open orders, as a loaded table may
        orders[i] = [f"P{rng.randint(0, keys - 1)}", f"K{rng.randint(0, keys - 1)}", T0, T0 + timedelta(hours=rng.randint(1, 99)), M(rng.randint(0, 999))]
    calls, made = [], []
    for seq in rng.sample(range(5 * n), n):
        verb = rng.choice(J.VERBS + ("add_order", "update_order", "update_order", "del_order"))
        ts = T0 + timedelta(hours=rng.randint(-5, 50), microseconds=rng.randint(0, 999_999))
        some = lambda *v: rng.choice([None, *v])
        args = {"reg_num": some(*[f"K{rng.randint(0, keys + 3)}"] * 6), "pass": some(*[f"P{rng.randint(0, keys + 3)}"] * 6)}
        if verb.endswith("_car"):
            args |= {"color": some("blue", "green", "x" * 21), "mark": some("a", "b", "c"), "type": some("t", "u"),
                     "price": some(M(5), Decimal("7.77"), Decimal(rng.randint(1, 10 ** 9)).scaleb(-2)), "state_id": some(1, 1, 2, 3, 9),
                     "tech_serv_date": some(ts)}
        elif verb.endswith("_client"):
            args["name"] = some("ann", "bob", "z" * 41)
        else:
            args |= {"id": some(rng.randint(1, keys + 2), *(made[-3:] or [5])), "rented_at": some(None, ts),
                     "returned_at": some(ts + timedelta(seconds=rng.randint(-9999, 10 ** 6)), ts + timedelta(days=400_000))}
            if verb == "add_order":
                made.append(1000 + seq)
        calls.append(call(seq, verb, ts, **args))
    return cars, clients, orders, calls


@pytest.mark.parametrize("seed, n, keys", [(1, 400, 12), (2, 500, 60), (3, 300, 400)])
def test_journal_equals_one_by_one(spark, seed, n, keys):
    want = check(spark, *random_journal(random.Random(seed), n, keys))
    assert len(want[3]) > 10 and len({r[1] for r in want[4]}) >= 6


def test_parts_of_a_large_component(spark, monkeypatch):
    """More calls than a task folds: the sequence is applied in parts."""
    monkeypatch.setattr(J, "FOLD_CALLS", 40)
    check(spark, *random_journal(random.Random(4), 260, 10))


def test_only_a_large_component_is_cut_and_no_finer_than_needed(spark, monkeypatch):
    """Ninety swaps tie all cars, fewer do not: a few cuts do, and the calls
    of other components are folded before them."""
    monkeypatch.setattr(J, "FOLD_CALLS", 30)
    cars = {f"K{i:03d}": [1, "c", "m", "t", M(10 + i), T0] for i in range(91)}
    clients = {f"P{i:03d}": ["x"] for i in range(90)}
    orders = {i + 1: [f"P{i:03d}", f"K{i:03d}", T0, T0 + timedelta(days=9), M(50)] for i in range(90)}
    # Even calls first: each alone names two cars and nobody's neighbour.
    calls = [call(k, "update_order", id=i + 1, reg_num=f"K{i + 1:03d}", returned_at=T0 + timedelta(days=12))
             for k, i in enumerate([*range(0, 90, 2), *range(89, 0, -2)])]
    calls += [call(1000 + i, "add_client", **{"pass": f"N{i}"}, name="y") for i in range(20)]
    runs, real = [], J._outcomes
    monkeypatch.setattr(J, "_outcomes", lambda *a: runs.append(a[3].count()) or real(*a))
    check(spark, cars, clients, orders, calls)
    # The old cut took as many parts as calls ask for: four, and the whole before.
    assert runs[0] == 110 and len(runs) == 3 and sum(runs[1:]) == 90


def test_a_long_journal_is_cut_before_its_components_are_found(spark, monkeypatch):
    """Fifty swaps tie all cars and are more than four tasks fold: two parts, in which they fall apart."""
    monkeypatch.setattr(J, "FOLD_CALLS", 10)
    monkeypatch.setattr(J, "FIRST_PARTS", 2)
    cars = {f"K{i:03d}": [1, "c", "m", "t", M(10 + i), T0] for i in range(51)}
    clients = {f"P{i:03d}": ["x"] for i in range(50)}
    orders = {i + 1: [f"P{i:03d}", f"K{i:03d}", T0, T0 + timedelta(days=9), M(50)] for i in range(50)}
    calls = [call(k, "update_order", id=i + 1, reg_num=f"K{i + 1:03d}", returned_at=T0 + timedelta(days=12))
             for k, i in enumerate([*range(0, 50, 2), *range(49, 0, -2)])]
    runs, real = [], J._outcomes
    monkeypatch.setattr(J, "_outcomes", lambda *a: runs.append(a[3].count()) or real(*a))
    check(spark, cars, clients, orders, calls)
    assert len(runs) == 2 and sum(runs) == 50 and max(runs) < 40


def test_parts_of_a_large_component_read_only_the_rows_that_it_sees(spark, monkeypatch):
    """Ninety swaps tie ninety cars; three hundred other cars, clients and orders stay out of its parts."""
    monkeypatch.setattr(J, "FOLD_CALLS", 30)
    cars = {f"K{i:03d}": [1, "c", "m", "t", M(10 + i), T0] for i in range(400)}
    clients = {f"P{i:03d}": ["x"] for i in range(400)}
    orders = {i + 1: [f"P{i:03d}", f"K{i:03d}", T0, T0 + timedelta(days=9), M(50)] for i in [*range(90), *range(100, 400)]}
    calls = [call(k, "update_order", id=i + 1, reg_num=f"K{i + 1:03d}", returned_at=T0 + timedelta(days=12))
             for k, i in enumerate([*range(0, 90, 2), *range(89, 0, -2)])]
    calls += [call(1000 + i, "update_car", reg_num=f"K{i:03d}", price=M(3)) for i in range(100, 400, 20)]
    calls += [call(2000 + i, "del_order", id=i + 1) for i in range(100, 400, 25)]
    runs, real = [], J._outcomes
    monkeypatch.setattr(J, "_outcomes", lambda *a: runs.append(tuple(df.count() for df in a[:3])) or real(*a))
    check(spark, cars, clients, orders, calls)
    assert runs[0] == (400, 400, 390) and len(runs) >= 3 and all(c <= 91 and p <= 90 and o <= 90 for c, p, o in runs[1:])


def test_outcomes_of_a_kind_hold_all_their_columns():
    row = {c: None for c, _ in J._OUT}
    rows = [{"kind": "h", "seq": 1, "ts": 2, "oid": 3, "status": "0", "note": None, "client": "P", "car": "K", "rented": 4, "returned": 5, "cents": 6},
            {"kind": "r", "seq": 7, "verb": "add_car", "key": "K", "err": "e"}, {"kind": "o", "oid": 8, "gone": True},
            {"kind": "c", "car": "K", "gone": False, "color": "r", "mark": "m", "type": "t", "cents": 9, "state": 1, "served": 10},
            {"kind": "p", "client": "P", "gone": False, "name": "n"}]
    got = [r for b in J._flushed(rows) for r in b.to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr({**row, **r}) for r in rows)


def test_values_of_a_column():
    for typ, values in ((pa.int64(), [1, None, 2 ** 62]), (pa.int32(), [3, -4, 0]), (pa.string(), ["a", None, ""]),
                        (pa.bool_(), [True, None, False]), (pa.int64(), [None, None])):
        got = J._values(pa.array(values, typ))
        assert got == values and [type(x) for x in got] == [type(x) for x in values]


def test_walk_through(spark):
    """A car and a client come, rent, change, and go, in one journal."""
    calls = [
        call(1, "add_car", reg_num="AAAAA55555", color="red", mark="bently", type="supercar", price=M(8000)),
        call(2, "update_car", reg_num="AAAAA55555", color="mixed", state_id=1), call(3, "add_client", **{"pass": "9999944444", "name": "steven"}),
        call(4, "update_client", **{"pass": "9999944444", "name": "stephen"}),
        call(5, "add_order", reg_num="AAAAA55555", returned_at=T0 + timedelta(days=1), **{"pass": "9999944444"}),
        call(6, "del_car", reg_num="AAAAA55555"), call(7, "del_client", **{"pass": "9999944444"}),
        call(8, "update_order", id=1005, returned_at=T0 + timedelta(days=3)), call(9, "del_order", id=1005),
        call(10, "del_car", reg_num="AAAAA55555"), call(11, "del_client", **{"pass": "9999944444"}), call(12, "del_order", id=1005)]
    cars, clients, orders, log, rejects = check(spark, {"K": [1, "c", "m", "t", M(1), T0]}, {"P": ["x"]}, {}, calls)
    assert set(cars) == {"K"} and set(clients) == {"P"} and not orders
    assert [x[-2] for x in log] == [M(8000), M(24000), M(24000)] and [r[0] for r in rejects] == [6, 7]


def test_journal_without_calls_and_unknown_verbs(spark, fixture_tables):
    t = fixture_tables
    empty = spark.createDataFrame([], S.JOURNAL)
    r = J.apply_journal(t["cars"], t["clients"], t["orders"], empty, t["car_states"], "U")
    assert [x.count() for x in r] == [4, 3, 1, 0, 0]
    bad = spark.createDataFrame([(1, T0, "drop_table")], "seq long, ts timestamp_ntz, verb string")
    with pytest.raises(ValueError, match="drop_table"):
        J.apply_journal(t["cars"], t["clients"], t["orders"], bad, t["car_states"], "U")
    # Columns left out are arguments left out; NULLs in all of them reject.
    few = spark.createDataFrame([(i, T0, v) for i, v in enumerate(J.VERBS)], "seq long, ts timestamp_ntz, verb string")
    r = J.apply_journal(t["cars"], t["clients"], t["orders"], few, t["car_states"], "U")
    assert sorted(x.op for x in r.rejects.collect()) == sorted(set(J.VERBS) - {"del_client", "del_order"})


def test_components_of_chains_stars_and_rings(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(300)] + [("hub", f"s{i}") for i in range(200)]
    edges += [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("x", "x"), ("a5", "a4")]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # edges lie apart
    try:
        spread = {r.node: r.root for r in K.connected(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for got in (spread, {r.node: r.root for r in K.connected(df).collect()}):
        assert len({got[f"a{i}"] for i in range(301)}) == len({got[f"s{i}"] for i in range(200)} | {got["hub"]}) == 1
        assert len(set(got.values())) == 3 and "x" not in got
    assert K.connected(df.limit(0)).count() == 0


def test_few_edges_are_joined_in_one_round(spark, monkeypatch):
    """A chain over many partitions: one round if it is short, more if it is not, the same components."""
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # edges lie apart
    seen = []
    monkeypatch.setattr(K, "materialize", lambda x: seen.append(1) or joins.materialize(x))
    try:
        short = {r.node: r.root for r in K.connected(df).collect()}
        rounds = len(seen)
        monkeypatch.setattr(K, "LAST_EDGES", 20)
        long = {r.node: r.root for r in K.connected(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for got in (short, long):
        assert len(got) == 303 and len({got[i] for i in range(301)}) == 1 and len(set(got.values())) == 2
    assert rounds == 2 and len(seen) - rounds > 3


def test_dependent_adds_take_few_checkpoints(spark, monkeypatch):
    """200 adds that each depend on the one before."""
    seen = []

    def counted(df):
        seen.append(1)
        return joins.materialize(df)
    for module in (C, K):
        monkeypatch.setattr(module, "materialize", counted)
    n = 200
    clients = spark.createDataFrame([(f"P{i}", "n") for i in range(n)], S.CLIENTS)
    cars = spark.createDataFrame([(f"K{i}", 1, "c", "m", "t", M(10), D(1)) for i in range(n + 1)], S.CARS)
    orders = spark.createDataFrame([], S.ORDERS)
    # Client i first asks for the car that client i - 1 asked for second.
    adds = [(2 * i + j, D(2), f"P{i}", f"K{i + j}", D(5)) for i in range(n) for j in (0, 1)]
    r = C.add_orders(orders, cars, clients, spark.createDataFrame(adds, S.ORDER_ADDS), "U")
    assert sorted(x.id for x in r.history.collect()) == [2 * i for i in range(n)]
    assert len(seen) <= 12
