"""Registered queries for history, fleet rules, checks and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from carledger import params as P
from carledger.functions.timefn import add_days
from carledger.operators import fleetops as FO
from carledger.operators import history as H
from carledger.operators import quality as Q
from carledger.plans.joins import drop_shuffles, release, staged
from carledger.registry import _q
from carledger.sources.driver_tables import client_key, read_table


def _swaps(t):
    o = t.orders_first_car
    return o.select("id", F.col("first_car").alias("car_reg_num"), add_days("rented_at", 1).alias("ts"))


def _closes(t):
    """Two calls for each open order; those of two thirds name an unknown
    order, so these stay open."""
    i = F.col("id")
    first = t.orders.select((i * 10 + 7).alias("seq"), add_days("rented_at", 1).alias("ts"), F.when(i % 3 == 0, i).otherwise(-i).alias("id"))
    return first.unionByName(first.select((F.col("seq") + 1).alias("seq"), add_days("ts", 1).alias("ts"), "id"))


def _violations(t):
    history = t.history         # first, as the open orders then come from it
    return Q.constraint_violations(t.car_states, t.cars, t.clients, t.orders, history)


def _free_keys(t):
    part = read_table(t.spark, t.sf_dir, "part", ["p_partkey"])
    cand = part.select(client_key(F.col("p_partkey")).alias("pass"))
    return Q.free_keys(cand, t.clients, "pass", "pass")


QUERIES = {
    "order_change_log": _q(lambda t: H.order_change_log(H.events_from_history(t.history))),
    "expired_orders": _q(lambda t: FO.expired_orders(t.orders, P.EXPIRE_AT, P.V_USER,
                                                     P.EXPIRE_ID_OFFSET).history),
    "fleet_tick": _q(lambda t: FO.fleet_tick(t.cars, t.orders, P.TICK_AT)),
    "pick_free_car": _q(lambda t: FO.pick_free_car(t.cars, P.PICK_SEED)),
    "swap_quote": _q(lambda t: FO.swap_quote(t.orders, t.cars, _swaps(t))),
    "renew_quote": _q(lambda t: FO.renew_quote(t.orders, t.cars)),
    "expired_orders_left": _q(lambda t: FO.expired_orders(t.orders, P.EXPIRE_AT, P.V_USER, P.EXPIRE_ID_OFFSET).orders),
    "close_early": _q(lambda t: FO.close_early(t.orders, t.cars, _closes(t), P.V_USER).history),
    "close_early_orders": _q(lambda t: FO.close_early(t.orders, t.cars, _closes(t), P.V_USER).orders),
    "close_early_cars": _q(lambda t: FO.close_early(t.orders, t.cars, _closes(t), P.V_USER).cars),
    "constraint_violations": _q(_violations),
    "free_keys": _q(_free_keys),
}


# ------------------------------------------------------------------ commands
from carledger.operators import commands as C  # noqa: E402
from carledger.operators import journal as J  # noqa: E402
from carledger.sources import driver_commands as DC  # noqa: E402


def _cmd(fn):
    return _q(lambda t: fn(t, t.spark, t.sf_dir))


_VERBS = {
    "add_cars": lambda t, s, d: C.add_cars(t.cars, DC.car_adds(s, d)),
    "update_cars": lambda t, s, d: C.update_cars(t.cars, DC.car_updates(s, d), t.car_states),
    "delete_cars": lambda t, s, d: C.delete_cars(t.cars, DC.car_deletes(s, d), t.orders),
    "add_clients": lambda t, s, d: C.add_clients(t.clients, DC.client_adds(s, d)),
    "update_clients": lambda t, s, d: C.update_clients(t.clients, DC.client_updates(s, d)),
    "delete_clients": lambda t, s, d: C.delete_clients(t.clients, DC.client_deletes(s, d), t.orders),
    "add_orders": lambda t, s, d: C.add_orders(t.orders, t.cars, t.clients, DC.order_adds(s, d, t.orders),
                                               P.V_USER, P.ORDER_ID_OFFSET),
    "update_orders": lambda t, s, d: C.update_orders(t.orders, t.cars, DC.order_updates(t.orders_first_car), P.V_USER),
    "close_orders": lambda t, s, d: C.close_orders(t.orders, DC.order_deletes(t.orders), P.V_USER),
}


def _output(verb, part, shared=None):
    """One output of a verb; ``shared`` names a run whose outputs are
    written once and read by all its queries."""
    if shared is None:
        return _cmd(lambda t, s, d: getattr(verb(t, s, d), part))
    return _cmd(lambda t, s, d: getattr(t.once(shared, lambda: verb(t, s, d)), part))


# The table after a batch, its rejected calls, and for orders the history rows.
for _name, _verb in _VERBS.items():
    if _name == "close_orders":
        QUERIES["close_orders"], QUERIES["close_orders_table"] = _output(_verb, "history"), _output(_verb, "table")
        continue
    _run = _name if _name in ("add_orders", "update_orders") else None
    QUERIES[_name] = _output(_verb, "table", _run)
    QUERIES[f"{_name}_rejects"] = _output(_verb, "rejects", _run)
    if _run:
        QUERIES[f"{_name}_log"] = _output(_verb, "history", _run)


def _journal(t, s, d):
    calls = DC.journal(s, d, t.orders_first_car, P.ORDER_ID_OFFSET)
    return J.apply_journal(t.cars, t.clients, t.orders, calls, t.car_states, P.V_USER, P.ORDER_ID_OFFSET)


for _name, _part in {"apply_journal": "orders", "apply_journal_cars": "cars", "apply_journal_clients": "clients",
                     "apply_journal_log": "history", "apply_journal_rejects": "rejects"}.items():
    QUERIES[_name] = _output(_journal, _part, "journal")


# ----------------------------------------------------------------- streaming
def _change_stream(t):
    """H1 streamed: events arrive year by year, as they happened, in small
    files dealt by the hash that deals the state, and are consumed by an
    availableNow stream in micro-batches of a bounded number of files into
    a parquet sink. A file holds few blocks, so a micro-batch reads and
    writes the state of those only; its files go when it is done. The folders
    go when the application ends."""
    from carledger.session import delete_path, forget_at_exit, shared_path, shuffle_parts
    from carledger.streaming.order_stream import blocks_for, run_change_log
    spark = t.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    about = t.history.agg(F.approx_count_distinct("order_id").alias("orders"), F.min(F.year("changed_at")).alias("first"),
                          F.max(F.year("changed_at")).alias("last")).first()
    if about["first"] is None:
        return spark.createDataFrame([], ORDERS_HISTORY)
    src, sink, ckpt = (shared_path(spark, x) for x in ("events", "history-stream", "stream-ckpt"))
    for path in (src, sink, ckpt):
        forget_at_exit(spark, path)
    # Files and a micro-batch's files grow with the rows, so the number of
    # micro-batches, each of which writes state, does not.
    parts = shuffle_parts(spark)
    # A file holds a year of a block, a few events an order: larger blocks
    # (in tasks as many as before) take fewer Python calls.
    blocks = max(min(blocks_for(about["orders"]), 4 * n), blocks_for(about["orders"], P.STREAM_BLOCK_ORDERS))
    block = F.pmod(F.xxhash64("order_id"), F.lit(blocks))
    ev = staged(H.events_from_history(t.history).withColumn("year", F.year("ts")), "year")
    for year in range(about["first"], about["last"] + 1):
        # A block's events of a year lie in one task's files, one after the other.
        (ev.filter(F.col("year") == year).drop("year").repartition(parts, block)
         .sortWithinPartitions(block, "order_id", "seq").write.option("compression", "zstd")
         .option("maxRecordsPerFile", P.STREAM_FILE_ROWS).parquet(f"{src}/year={year}"))
        delete_path(spark, f"{ev._staged}/year={year}")
    release(ev)
    drop_shuffles(spark)
    run_change_log(spark, f"{src}/*", sink, ckpt, max_files_per_trigger=parts, blocks=blocks, late=P.STREAM_LATE, clean=True)
    for path in (src, ckpt):
        delete_path(spark, path)
    return spark.read.schema(ORDERS_HISTORY).parquet(sink)


from carledger.schema import ORDERS_HISTORY  # noqa: E402

QUERIES["order_change_stream"] = _q(_change_stream)


# -------------------------------------------------------------- text lines
from carledger.operators import lines as L  # noqa: E402
from carledger.operators import reports as R  # noqa: E402

QUERIES.update({
    "cars_report_lines": _q(lambda t: L.cars_report_lines(R.cars_report(t.history, t.cars, P.AS_OF))),
    "client_report_lines": _q(lambda t: L.client_report_lines(R.client_report(t.history))),
    "orders_changes_report_lines": _q(lambda t: L.orders_changes_report_lines(
        R.orders_changes_report(t.history, t.orders))),
    "fin_report_lines": _q(lambda t: L.fin_report_lines(R.fin_report(t.history, P.FIN_START, P.FIN_END))),
    "autopark_status_lines": _q(lambda t: L.autopark_status_lines(R.autopark_status(t.cars, t.car_states))),
})
QUERIES.update({
    "find_car_lines": _q(lambda t: L.find_car_lines(R.find_car(t.cars, t.car_states, type=P.FIND_TYPE))),
    "list_cars_lines": _q(lambda t: L.list_cars_lines(R.list_cars(t.cars, t.car_states))),
    "list_clients_lines": _q(lambda t: L.list_clients_lines(R.list_clients(t.clients))),
    "list_orders_lines": _q(lambda t: L.list_orders_lines(R.list_orders(t.orders))),
})
