"""Registered queries over stored layouts, states, versions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from carledger import params as P
from carledger.operators import commands as C
from carledger.operators import history as H
from carledger.operators import lookups as LK
from carledger.operators import quality as Q
from carledger.operators import reports as R
from carledger.operators.rolling import RollingReports
from carledger.registry import _q
from carledger.registry_more import _journal
from carledger.session import forget_at_exit, shared_path
from carledger.sources import driver_commands as DC
from carledger.sources import driver_tables as DT
from carledger.sources import sinks
from carledger.sources.fleet_store import FleetStore, StoredFleetTables


def _folder(t, name: str) -> str:
    path = shared_path(t.spark, name)
    forget_at_exit(t.spark, path)
    return path


# -------------------------------------------- log from two versions of a table
def _diff_log(t):
    after = t.once("journal", lambda: _journal(t, t.spark, t.sf_dir)).orders
    return H.diff_log(t.orders, after, F.lit(P.AS_OF).cast("timestamp_ntz"), P.V_USER, P.DIFF_ID_OFFSET)


# ---------------------------------------------------- reports kept up to date
def _rolling(t) -> RollingReports:
    """The history, appended year by year in batches; one arrives twice."""
    state = RollingReports(t.spark, _folder(t, "rolling"))
    year, cuts = F.year("changed_at"), P.ROLLING_CUTS
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        rows = t.history.filter((F.lit(True) if low is None else year >= low) & (F.lit(True) if high is None else year < high))
        for _ in range(2 if i == 1 else 1):
            state.append(i, rows)
    return state


def _rolled(report):
    return _q(lambda t: report(t.once("rolling", lambda: _rolling(t)), t))


# ------------------------------------------------------- batches that are stored
def _batches(t):
    """The tables stored anew, all four, then changed by two batches of calls, of
    which the second arrives twice. They are derived into this store, not
    copied from the session's, which would be written for that alone."""
    st = FleetStore.ingest(t.spark, t.sf_dir).write_all()
    st.apply(1, lambda b: C.update_orders(b.orders, b.cars, DC.order_updates(b.orders_first_car), P.V_USER), "orders")
    for _ in range(2):
        st.apply(2, lambda b: C.close_orders(b.orders, DC.order_deletes(b.orders), P.V_USER), "orders")
    return StoredFleetTables(t.spark, "-", store=st)


# ------------------------------------------------------------ export and back
def _exported(query):
    def run(t):
        df = query(t)
        path = _folder(t, "export")
        sinks.write_delimited(df, path)
        return sinks.read_ordered(t.spark, path, df.schema)
    return _q(run)


# ------------------------------------------------------- checks of a batch only
def _batch_violations(t):
    history = t.history         # first, as the open orders then come from it
    return Q.batch_violations(t.cars, t.clients, t.orders, history, *_unchecked(t))


def _unchecked(t):
    """Rows appended without the verb's checks: an order for each call to
    add one, and a history row for each open order under an id it has."""
    calls = DC.order_adds(t.spark, t.sf_dir, t.orders)
    orders = calls.select((F.lit(P.ORDER_ID_OFFSET) + F.floor(F.col("seq") / 2)).cast("long").alias("id"), "client_pass", "car_reg_num",
                          F.col("ts").alias("rented_at"), "returned_at", F.lit(1).cast("decimal(10,2)").alias("total_price"))
    rows = t.orders.select((F.col("id") * DT.LINES + 1).alias("id"), F.col("id").alias("order_id"), F.col("rented_at").alias("changed_at"),
                           "client_pass", "car_reg_num", "rented_at", "returned_at",
                           F.when(F.col("id") % 2 == 0, F.lit("0")).otherwise(F.lit("x")).alias("status"), "total_price",
                           F.lit(None).cast("string").alias("note"), F.lit("A long user name").alias("v_user"))
    return orders, rows


QUERIES = {
    "orders_diff_log": _q(_diff_log),
    "rolling_orders_changes": _rolled(lambda r, t: r.orders_changes()),
    "rolling_orders_changes_report": _rolled(lambda r, t: r.orders_changes_report(t.orders)),
    "rolling_cars_report": _rolled(lambda r, t: r.cars_report(t.cars, P.AS_OF)),
    "client_history": _q(lambda t: LK.history_for(t.store.layout("client_pass"), "client_pass", t.orders.select("client_pass"))),
    "car_history": _q(lambda t: LK.history_for(t.store.layout("car_reg_num"), "car_reg_num", t.cars.filter("state_id = 2").select("reg_num"))),
    "client_lookup": _q(lambda t: LK.history_of(t.store.layout("client_pass"), "client_pass", [f"{k:010X}" for k in P.LOOKUP_KEYS])),
    "car_lookup": _q(lambda t: LK.history_of(t.store.layout("car_reg_num"), "car_reg_num", [f"C{k:09X}" for k in P.LOOKUP_KEYS])),
    "stored_batches_history": _q(lambda t: t.once("batches", lambda: _batches(t)).history),
    "stored_batches_orders": _q(lambda t: t.once("batches", lambda: _batches(t)).orders),
    "orders_history_csv": _exported(lambda t: R.orders_history_export(t.history)),
    "cars_history_csv": _exported(lambda t: R.cars_history_export(t.history, t.cars)),
    "batch_violations": _q(_batch_violations),
    "client_report_parts": _q(lambda t: R.client_report_parts(t.history, P.PART_CARS)),
}
