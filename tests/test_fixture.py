"""Hand-computed fixture (five history rows, four cars) and the CRUD
walk-through: every report, rule and verb against values worked out by hand."""

from decimal import Decimal

from conftest import D, M

from carledger import schema as S
from carledger.operators import commands as C
from carledger.operators import fleetops as FO
from carledger.operators import history as H
from carledger.operators import reports as R


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_orders_changes(fixture_tables):
    out = rows(R.orders_changes(fixture_tables["history"]),
               "order_id", "changed_times", "used_cars", "renews_on", "status")
    assert out == [(1, 4, 2, 1.0, "closed"), (2, 1, 1, 0.0, "open")]


def test_orders_changes_report(fixture_tables):
    r = R.orders_changes_report(fixture_tables["history"], fixture_tables["orders"]).collect()[0]
    assert (r.total_orders, r.distinct_orders, r.open_orders) == (3, 2, 1)
    assert (r.avg_changes, r.avg_cars, r.avg_renew) == (M(2.5), M(1.5), M(1))
    assert (r.min_price, r.avg_price, r.max_price) == (M(3600), M(3600), M(3600))


def test_cars_rents(fixture_tables):
    out = rows(R.cars_rents(fixture_tables["history"], fixture_tables["cars"]),
               "car_reg_num", "order_id", "rented_at", "returned_at", "rented_time", "revenue")
    assert out == [
        ("A000000001", 1, D(5), D(9), 4.0, Decimal("4000")),
        ("A000000001", 2, D(10), D(12, 12), 2.5, Decimal("2500")),
        ("A000000002", 1, D(5), D(9), 4.0, Decimal("3200")),
    ]


def test_cars_report(fixture_tables):
    out = rows(R.cars_report(fixture_tables["history"], fixture_tables["cars"], "2024-01-21 00:00:00"),
               "reg_num", "orders_num", "clients_num", "total_revenue", "total_rented_time",
               "days_since_service")
    assert out == [("A000000001", 2, 2, M(6500), M(6.5), M(20)),
                   ("A000000002", 1, 1, M(3200), M(4), M(20))]


def test_fin_report(fixture_tables):
    h = fixture_tables["history"]
    assert R.fin_report(h, "2024-01-01 00:00:00", "2024-01-31 00:00:00").collect()[0].revenue == M(3600)
    assert R.fin_report(h, "2024-01-10 00:00:00", "2024-01-31 00:00:00").collect()[0].revenue is None


def test_client_report(fixture_tables):
    out = rows(R.client_report(fixture_tables["history"]),
               "client_pass", "car_list", "revenue", "closed_revenue")
    assert out == [("1000000001", "A000000001, A000000002", M(14400), M(3600))]


def test_client_report_equals_literal_self_join(spark, fixture_tables):
    fixture_tables["history"].createOrReplaceTempView("h_fix")
    lit = spark.sql("""
        SELECT oh.client_pass, CAST(sum(t1.total_price) AS decimal(38,2)) AS revenue
        FROM h_fix oh JOIN (SELECT client_pass, total_price FROM h_fix WHERE status = '1') t1
          ON t1.client_pass = oh.client_pass GROUP BY oh.client_pass""")
    ours = R.client_report(fixture_tables["history"])
    assert rows(lit, "client_pass", "revenue") == rows(ours, "client_pass", "revenue")


def test_autopark_and_find(fixture_tables):
    t = fixture_tables
    assert rows(R.autopark_status(t["cars"], t["car_states"]), "state", "num") == [
        ("onserving", 1), ("rented", 1), ("waiting", 2)]
    assert rows(R.find_car(t["cars"], t["car_states"]), "reg_num") == [("A000000002",), ("A000000004",)]
    assert R.find_car(t["cars"], t["car_states"], type="sedan").count() == 0
    assert rows(R.find_car(t["cars"], t["car_states"], type="sedan", state_id=None), "reg_num") == [
        ("A000000001",)]
    assert R.find_car(t["cars"], t["car_states"], color="", state_id=None).count() == 4


def test_fleet_tick(fixture_tables):
    t = fixture_tables
    out = rows(FO.fleet_tick(t["cars"], t["orders"], "2024-01-21 00:00:00"),
               "reg_num", "state_id", "tech_serv_date")
    assert out == [("A000000001", 3, D(21)), ("A000000002", 3, D(21)),
                   ("A000000003", 1, D(10)), ("A000000004", 1, D(20))]


def test_change_log_notes(fixture_tables):
    log = H.order_change_log(H.events_from_history(fixture_tables["history"]))
    assert rows(log, "id", "status", "note") == [
        (1, "0", "order was created."), (2, "0", "client renewed a car."),
        (3, "0", "client changed a car."), (4, "1", "client returned a car."),
        (5, "0", "order was created.")]


def _cmds(spark, schema, data):
    return spark.createDataFrame(data, schema)


def test_update_orders_reprice(spark, fixture_tables):
    t = fixture_tables
    cmds = _cmds(spark, S.ORDER_UPDATES, [
        (1, D(11), 2, "A000000002", None, None),
        (2, D(11), 2, None, None, D(13, 12)),
        (3, D(11), 2, None, None, D(10)),        # return before the call: rejected
    ])
    res = C.update_orders(t["orders"], t["cars"], cmds, "T")
    assert rows(res.history, "id", "total_price", "note") == [
        (1, M(2200), "client changed a car."), (2, M(3000), "client renewed a car.")]
    assert rows(res.table, "id", "car_reg_num", "returned_at", "total_price") == [
        (2, "A000000002", D(13, 12), M(3000))]
    assert rows(res.rejects, "seq", "err") == [(3, "err: pcrud.update_order")]


def test_delete_and_update_cars(spark, fixture_tables):
    t = fixture_tables
    dels = _cmds(spark, S.CAR_DELETES, [(1, D(21), "A000000001"), (2, D(21), "A000000002")])
    res = C.delete_cars(t["cars"], dels, t["orders"])
    assert rows(res.rejects, "key", "err") == [
        ("A000000001", "err: pcrud.del_car: the car is used by a client.")]
    assert "A000000002" not in [r.reg_num for r in res.table.collect()]
    ups = _cmds(spark, S.CAR_UPDATES, [(1, D(21), "A000000001", 1, "green", None, None, None, None)])
    out = C.update_cars(t["cars"], ups, t["car_states"]).table.filter("reg_num = 'A000000001'").collect()[0]
    assert (out.state_id, out.color, out.price) == (1, "green", M(1000))


def test_walk_through(spark, fixture_tables):
    """Add a car and a client, rent for one day, extend to three days at
    the same instant, close, then delete car and client."""
    t = fixture_tables
    T = D(15, 9, 30)
    cars = C.add_cars(t["cars"], _cmds(spark, S.CAR_ADDS, [
        (1, T, "AAAAA55555", "red", "bently", "supercar", M(8000))])).table
    cars = C.update_cars(cars, _cmds(spark, S.CAR_UPDATES, [
        (2, T, "AAAAA55555", 1, "mixed", None, None, None, None)]), t["car_states"]).table
    clients = C.add_clients(t["clients"], _cmds(spark, S.CLIENT_ADDS, [(3, T, "9999944444", "steven")])).table
    clients = C.update_clients(clients, _cmds(spark, S.CLIENT_UPDATES, [(4, T, "9999944444", "stephen")])).table
    add = C.add_orders(t["orders"], cars, clients, _cmds(spark, S.ORDER_ADDS, [
        (5, T, "9999944444", "AAAAA55555", D(16, 9, 30))]), "T", id_offset=3611)
    new_id = 3616
    assert rows(add.table.filter(f"id = {new_id}"), "total_price") == [(M(8000),)]
    upd = C.update_orders(add.table, cars, _cmds(spark, S.ORDER_UPDATES, [
        (6, T, new_id, None, None, D(18, 9, 30))]), "T")
    assert rows(upd.table.filter(f"id = {new_id}"), "total_price") == [(M(24000),)]
    closed = C.close_orders(upd.table, _cmds(spark, S.ORDER_DELETES, [(7, T, new_id)]), "T")
    log = add.history.unionByName(upd.history).unionByName(closed.history)
    assert rows(log, "id", "status", "total_price", "note") == [
        (5, "0", M(8000), "order was created."), (6, "0", M(24000), "client renewed a car."),
        (7, "1", M(24000), "client returned a car.")]
    cars2 = C.delete_cars(cars, _cmds(spark, S.CAR_DELETES, [(8, T, "AAAAA55555")]), closed.table).table
    assert cars2.filter("reg_num = 'AAAAA55555'").count() == 0
    cl2 = C.delete_clients(clients, _cmds(spark, S.CLIENT_DELETES, [(9, T, "9999944444")]), closed.table)
    assert cl2.table.filter("pass = '9999944444'").count() == 0
    assert cl2.rejects.count() == 0


def test_report_lines(spark, fixture_tables):
    from carledger.operators import lines as L
    t = fixture_tables
    rep = R.cars_report(t["history"], t["cars"], "2024-01-21 00:00:00")
    got = {r.reg_num: r.line for r in L.cars_report_lines(rep).collect()}
    assert got["A000000001"] == ("Reg num A000000001: 2 orders, 2 clients, revenue 6500 P, "
                                 "6.5 days in rent, 20 from last serving")
    fin = L.fin_report_lines(R.fin_report(t["history"], "2024-01-10 00:00:00", "2024-01-31 00:00:00"))
    assert fin.collect()[0].line == "Fin report for 10.01.24 00:00:00 - 31.01.24 00:00:00:  P"
    nums = spark.createDataFrame([(Decimal("0.50"),), (Decimal("-0.25"),), (Decimal("100.00"),),
                                  (Decimal("12.30"),)], "x decimal(10,2)")
    assert [r.t for r in nums.select(L.num_text("x").alias("t")).collect()] == [".5", "-.25", "100", "12.3"]
    cl = L.client_report_lines(R.client_report(t["history"])).orderBy("line_no").collect()
    assert [r.line for r in cl] == ["Client: 1000000001, used cars: A000000001, A000000002",
                                    "  Revenue: 14400"]


def test_left_out_state_means_waiting(spark, fixture_tables):
    """update_car: a state left out is 1 (the verb's default); an explicit
    NULL keeps the state."""
    t = fixture_tables
    left_out = spark.createDataFrame([(1, D(21), "A000000003", "grey")], "seq long, ts timestamp_ntz, "
                                     "reg_num string, color string")
    out = C.update_cars(t["cars"], left_out, t["car_states"]).table.filter("reg_num = 'A000000003'").collect()[0]
    assert (out.state_id, out.color) == (1, "grey")
    explicit = spark.createDataFrame([(1, D(21), "A000000003", None, "grey")], "seq long, ts timestamp_ntz, "
                                     "reg_num string, state_id int, color string")
    out = C.update_cars(t["cars"], explicit, t["car_states"]).table.filter("reg_num = 'A000000003'").collect()[0]
    assert (out.state_id, out.color) == (3, "grey")
