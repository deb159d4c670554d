"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the fleet tables derived from the driver's parquet
tables (``StoredFleetTables``: derived and written to the shared folder
once per session and data directory) and runs one operator over the
whole of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carledger import params as P
from carledger.operators import reports as R
from carledger.sources.fleet_store import StoredFleetTables

Query = Callable[[SparkSession, str], DataFrame]


def _q(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(StoredFleetTables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


REPORTS: dict[str, Query] = {
    "orders_history_export": _q(lambda t: R.orders_history_export(t.history)),
    "cars_history_export": _q(lambda t: R.cars_history_export(t.history, t.cars)),
    "orders_changes": _q(lambda t: R.orders_changes(t.history)),
    "orders_changes_report": _q(lambda t: R.orders_changes_report(t.history, t.orders)),
    "cars_rents": _q(lambda t: R.cars_rents(t.history, t.cars)),
    "cars_report": _q(lambda t: R.cars_report(t.history, t.cars, P.AS_OF)),
    "fin_report": _q(lambda t: R.fin_report(t.history, P.FIN_START, P.FIN_END)),
    "client_report": _q(lambda t: R.client_report(t.history)),
    "autopark_status": _q(lambda t: R.autopark_status(t.cars, t.car_states)),
    "find_car_default": _q(lambda t: R.find_car(t.cars, t.car_states)),
    "find_car_by_type": _q(lambda t: R.find_car(t.cars, t.car_states, type=P.FIND_TYPE)),
    "find_car_any_state": _q(lambda t: R.find_car(t.cars, t.car_states, type=P.FIND_TYPE,
                                                  color=P.FIND_COLOR, state_id=None)),
    "list_cars": _q(lambda t: R.list_cars(t.cars, t.car_states)),
    "list_clients": _q(lambda t: R.list_clients(t.clients)),
    "list_orders": _q(lambda t: R.list_orders(t.orders)),
}


def queries() -> dict[str, Query]:
    out = dict(REPORTS)
    from carledger import registry_more, registry_stored
    out.update(registry_more.QUERIES)
    out.update(registry_stored.QUERIES)
    return out
