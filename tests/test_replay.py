"""C8 invariant: the window replay of many update calls per order equals
applying the calls one at a time (exact fractions, rounding the total to
cents half away from zero after every call)."""

import random

import pytest
from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from carledger import schema as S
from carledger.operators import commands as C

DAY_US = 86_400_000_000


def us(a, b):
    d = a - b
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def round_cents(x: Fraction) -> Decimal:
    n = abs(x) * 100
    q = int(n)
    if n - q >= Fraction(1, 2):
        q += 1
    q = q if x >= 0 else -q
    return Decimal(q).scaleb(-2)


def fold(orders, prices, cmds):
    state = {i: dict(o) for i, o in orders.items()}
    totals, rejects = {}, set()
    for c in sorted(cmds, key=lambda c: c["seq"]):
        o = state.get(c["id"])
        if o is None or (c["returned"] is not None and c["returned"] < c["ts"]):
            rejects.add(c["seq"])
            continue
        po = prices.get(o["car"])
        pn = prices.get(c["car"]) if c["car"] is not None else po
        if po is None or pn is None:
            rejects.add(c["seq"])
            continue
        if c["car"] is not None and any(o2["car"] == c["car"] for k2, o2 in state.items() if k2 != c["id"]):
            rejects.add(c["seq"])        # the car is held by another open order now
            continue
        new_ret = c["returned"] if c["returned"] is not None else o["returned"]
        d1 = Fraction(us(o["returned"], c["ts"]), DAY_US)
        d2 = Fraction(us(new_ret, o["returned"]), DAY_US)
        total = round_cents(Fraction(o["total"]) + d1 * (Fraction(pn) - Fraction(po)) + d2 * Fraction(pn))
        if abs(total) >= Decimal(10 ** 8):
            rejects.add(c["seq"])        # the total would leave number(10,2)
            continue
        o["total"] = total
        o["returned"] = new_ret
        if c["car"] is not None:
            o["car"] = c["car"]
        if c["rented"] is not None:
            o["rented"] = c["rented"]
        totals[c["seq"]] = o["total"]
    return state, totals, rejects


@pytest.fixture(params=[None, "3"], ids=["plain", "hot-split"])
def hot_rows(spark, request):
    if request.param:
        spark.conf.set("carledger.hotKeyRows", request.param)
    yield request.param
    spark.conf.unset("carledger.hotKeyRows")


def test_replay_equals_sequential_fold(spark, hot_rows):
    rnd = random.Random(7)
    t0 = datetime(2024, 3, 1)
    cars, prices, orders, cmds = [], {}, {}, []
    seq = 0
    for oid in range(1, 161):
        pool = [f"R{oid:05d}{k:04d}"[:10] for k in range(4)]
        for reg in pool:
            p = Decimal(rnd.randint(50_000, 300_000)).scaleb(-2)
            prices[reg] = p
            cars.append((reg, 1, "c", "m", "t", p, t0))
        rented = t0 + timedelta(seconds=rnd.randint(0, 10 * 86400))
        ret = rented + timedelta(seconds=rnd.randint(3600, 7 * 86400), microseconds=rnd.randint(0, 999_999))
        total = Decimal(rnd.randint(100_000, 2_000_000)).scaleb(-2)
        orders[oid] = {"car": pool[0], "rented": rented, "returned": ret, "total": total}
        now = rented
        for _ in range(rnd.randint(0, 6)):
            seq += rnd.randint(1, 3)
            now = now + timedelta(seconds=rnd.randint(60, 86400))
            car = rnd.choice([None, None, pool[1], pool[2], pool[3], "NOCAR00000"])
            r = rnd.random()
            new_ret = (None if r < 0.3 else
                       now - timedelta(hours=1) if r < 0.4 else
                       now + timedelta(seconds=rnd.randint(0, 9 * 86400)))
            fix = rented - timedelta(hours=1) if rnd.random() < 0.1 else None
            cmds.append({"seq": seq, "ts": now, "id": oid, "car": car, "rented": fix, "returned": new_ret})
    cmds.append({"seq": seq + 1, "ts": t0, "id": 9999, "car": None, "rented": None, "returned": None})

    cars_df = spark.createDataFrame(cars, S.CARS)
    orders_df = spark.createDataFrame(
        [(i, f"P{i:09d}", o["car"], o["rented"], o["returned"], o["total"]) for i, o in orders.items()],
        S.ORDERS)
    cmd_df = spark.createDataFrame(
        [(c["seq"], c["ts"], c["id"], c["car"], c["rented"], c["returned"]) for c in cmds], S.ORDER_UPDATES)
    res = C.update_orders(orders_df, cars_df, cmd_df, "T")

    state, totals, rejects = fold(orders, prices, cmds)
    got = {r.id: r for r in res.table.collect()}
    for i, o in state.items():
        g = got[i]
        assert (g.car_reg_num, g.rented_at, g.returned_at, g.total_price) == (
            o["car"], o["rented"], o["returned"], o["total"]), i
    assert {r.id: r.total_price for r in res.history.collect()} == totals
    assert {r.seq for r in res.rejects.collect()} == rejects


def test_greedy_unique_equals_one_by_one(spark):
    """Adds contending for 25 clients and 25 cars: the parallel rounds must
    accept exactly the calls that one-by-one application accepts."""
    rnd = random.Random(11)
    calls = [(s, f"k{rnd.randrange(25)}", f"c{rnd.randrange(25)}") for s in range(1, 401)]
    taken_k, taken_c, want = set(), set(), set()
    for s, k, c in calls:
        if k not in taken_k and c not in taken_c:
            want.add(s)
            taken_k.add(k)
            taken_c.add(c)
    df = spark.createDataFrame(calls, "seq long, client_pass string, car_reg_num string")
    got = {r.seq for r in C.greedy_unique(df, ["client_pass", "car_reg_num"]).collect()}
    assert got == want
    assert 10 <= len(want) <= 25


def test_replay_with_car_contention(spark, hot_rows):
    """40 orders swap among 55 cars: cars are taken, given back and taken
    again inside one batch; acceptance must follow one-by-one application."""
    rnd = random.Random(3)
    t0 = datetime(2024, 3, 1)
    pool = [f"S{k:09d}" for k in range(55)]
    prices = {r: Decimal(rnd.randint(50_000, 300_000)).scaleb(-2) for r in pool}
    cars = [(r, 1, "c", "m", "t", p, t0) for r, p in prices.items()]
    orders, cmds, seq = {}, [], 0
    start = rnd.sample(pool, 40)
    for oid in range(1, 41):
        rented = t0 + timedelta(hours=rnd.randint(0, 48))
        orders[oid] = {"car": start[oid - 1], "rented": rented,
                       "returned": rented + timedelta(days=rnd.randint(3, 9)),
                       "total": Decimal(rnd.randint(100_000, 900_000)).scaleb(-2)}
    for _ in range(300):
        seq += 1
        oid = rnd.randint(1, 40)
        now = orders[oid]["rented"] + timedelta(minutes=seq)
        car = rnd.choice(pool + [None])
        cmds.append({"seq": seq, "ts": now, "id": oid, "car": car, "rented": None,
                     "returned": now + timedelta(days=rnd.randint(1, 5)) if rnd.random() < 0.3 else None})
    cars_df = spark.createDataFrame(cars, S.CARS)
    orders_df = spark.createDataFrame(
        [(i, f"P{i:09d}", o["car"], o["rented"], o["returned"], o["total"]) for i, o in orders.items()],
        S.ORDERS)
    cmd_df = spark.createDataFrame(
        [(c["seq"], c["ts"], c["id"], c["car"], c["rented"], c["returned"]) for c in cmds], S.ORDER_UPDATES)
    res = C.update_orders(orders_df, cars_df, cmd_df, "T")
    state, totals, rejects = fold(orders, prices, cmds)
    got = {r.id: r for r in res.table.collect()}
    for i, o in state.items():
        assert (got[i].car_reg_num, got[i].returned_at, got[i].total_price) == (
            o["car"], o["returned"], o["total"]), i
    assert {r.seq for r in res.rejects.collect()} == rejects
    assert {r.id: r.total_price for r in res.history.collect()} == totals
    assert 20 < len(rejects) < 280


def test_replay_rejects_overflowing_totals(spark, hot_rows):
    """Very expensive cars: some calls would push a total past
    99,999,999.99 and are rejected; later calls continue from the state
    without them, as one-by-one application does."""
    rnd = random.Random(17)
    t0 = datetime(2024, 4, 1)
    pool = [f"B{k:09d}" for k in range(30)]
    prices = {r: Decimal(rnd.randint(100_000_000, 900_000_000)).scaleb(-2) for r in pool}
    cars = [(r, 1, "c", "m", "t", p, t0) for r, p in prices.items()]
    orders, cmds = {}, []
    for oid in range(1, 21):
        rented = t0 + timedelta(hours=oid)
        orders[oid] = {"car": pool[oid - 1], "rented": rented, "returned": rented + timedelta(days=5),
                       "total": Decimal(rnd.randint(1_000_000, 90_000_000)).scaleb(-2)}
    for seq in range(1, 201):
        oid = rnd.randint(1, 20)
        now = orders[oid]["rented"] + timedelta(minutes=seq)
        cmds.append({"seq": seq, "ts": now, "id": oid, "car": rnd.choice(pool[20:] + [None, None]),
                     "rented": None,
                     "returned": now + timedelta(days=rnd.randint(1, 40)) if rnd.random() < 0.6 else None})
    cars_df = spark.createDataFrame(cars, S.CARS)
    orders_df = spark.createDataFrame(
        [(i, f"P{i:09d}", o["car"], o["rented"], o["returned"], o["total"]) for i, o in orders.items()],
        S.ORDERS)
    cmd_df = spark.createDataFrame(
        [(c["seq"], c["ts"], c["id"], c["car"], c["rented"], c["returned"]) for c in cmds], S.ORDER_UPDATES)
    res = C.update_orders(orders_df, cars_df, cmd_df, "T")
    state, totals, rejects = fold(orders, prices, cmds)
    got = {r.id: r for r in res.table.collect()}
    for i, o in state.items():
        assert (got[i].car_reg_num, got[i].returned_at, got[i].total_price) == (
            o["car"], o["returned"], o["total"]), i
    assert {r.seq for r in res.rejects.collect()} == rejects
    assert {r.id: r.total_price for r in res.history.collect()} == totals


def test_calls_without_a_car_are_dealt_over_tasks(spark, monkeypatch):
    """Calls that give no new car, or name no order, meet no car: they do not
    all go to one task of a join with cars."""
    t0, n = datetime(2024, 1, 1), 200
    cars = spark.createDataFrame([(f"K{i:03d}", 1, "c", "m", "t", Decimal("10.00"), t0) for i in range(n)], S.CARS)
    orders = spark.createDataFrame(
        [(i, f"P{i}", f"K{i:03d}", t0, t0 + timedelta(days=3), Decimal("30.00")) for i in range(n)], S.ORDERS)
    cmds = [(2 * i, t0, i if i % 2 else -i - 1, None, None, t0 + timedelta(days=4)) for i in range(n)]
    cmds += [(2 * i + 1, t0, i, f"K{i:03d}", None, None) for i in range(0, n, 10)]
    seen = []
    real = C.materialize

    def kept(df):
        out = real(df)
        seen.append(out)
        return out
    monkeypatch.setattr(C, "materialize", kept)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        res = C.update_orders(orders, cars, spark.createDataFrame(cmds, S.ORDER_UPDATES), "T")
        tasks = [r["count"] for r in seen[0].filter("new_car is null").groupBy(F.spark_partition_id()).count().collect()]
        assert res.rejects.count() == n // 2 and res.table.count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == n and max(tasks) < 0.6 * n
