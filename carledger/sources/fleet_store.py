"""Stored fleet tables: derive once, write to the shared folder, read many.

The fleet tables are derived from the driver tables once per session and
data directory, each when it is first read, and written under ``spark.checkpoint.dir`` (shared storage
on a cluster), which also cuts the lineage: a lost executor costs a file
re-read, not a re-derivation. Layout, chosen for the queries that follow:

* ``history``: bucketed by ``order_id`` (sorted by order_id, id),
  partitioned by ``batch`` and ``status``, with parquet bloom filters on
  ``client_pass`` and ``car_reg_num`` for point lookups (the source schema's
  secondary indexes on status, client and car). Per-order aggregates and
  per-order windows (changes report, change log, open orders) then run
  without a shuffle, and closed-row reports read only the ``status=1``
  directories, the role the status index plays in the reference schema.
* ``orders``: bucketed by ``id``, with the car each order began with, so
  no query reads the history for it; ``cars``, ``clients``: plain parquet; all
  three partitioned by ``version``. Empty texts are stored as NULL.
* ``layout(key)``: the history again, bucketed by client or car, for lookups.

Applying a batch of calls (``apply``): its history rows are partition
``batch=b`` of the history, the tables it changes partition ``version=b``,
each one write with dynamic partition overwrite. A batch is computed from
the tables as they were before it, so a batch that is repeated, after a crash
or by mistake, writes the same rows over its own. Readers see a batch when
all of its writes are done.

If one order holds more than two average buckets' worth of rows and more
than ``carledger.hotKeyRows`` rows (checked on the raw lines' keys, without
a join), the history is stored unbucketed instead: scans split, per-order
aggregates pre-aggregate before their shuffle and the ordered per-order
scans split hot orders (``plans.skew``). Results are the same.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carledger.functions.textfn import without_empty
from carledger.plans.joins import drop_shuffles
from carledger.plans.skew import key_group
from carledger.session import delete_path, files_state, forget_at_exit, shared_path, size_shuffles
from carledger.sources import driver_tables as DT

_LOCK = threading.Lock()
_STORES: dict[tuple[str, str], tuple] = {}      # (state of the source files, store)


HISTORY_COLS = ["id", "order_id", "changed_at", "client_pass", "car_reg_num", "rented_at", "returned_at",
                "status", "total_price", "note", "v_user"]


#: A history of more rows is not written for the open orders alone: they
#: come from the lines of the orders that may be open.
ALONE_ROWS = 1_000_000
#: Layouts of the history for lookups: name -> key.
LAYOUTS = {"history_by_client": "client_pass", "history_by_car": "car_reg_num"}


def _buckets(spark: SparkSession, rows: int) -> int:
    """Buckets of a history of ``rows`` rows; the session's shuffles are
    sized for it as well."""
    sized = size_shuffles(spark, rows)
    n = spark.conf.get("carledger.buckets", None)
    return int(n) if n else sized


def _rows_of(lines: DataFrame, key: str) -> tuple[int, int]:
    """(rows of the key with the most, rows of all)."""
    r = (lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
         .agg(F.max("n").alias("top"), F.sum("n").alias("total")).collect()[0])
    return r["top"] or 0, r["total"] or 0


def has_hot_order(lines: DataFrame, key: str, buckets: int, counted: tuple[int, int] | None = None) -> bool:
    """True if one order (``key`` of ``lines``) holds more than two average buckets' worth of
    history rows and more than ``carledger.hotKeyRows`` rows: bucketing by
    order would then give one task most of the work, so the history is
    stored unbucketed (per-order aggregates then pre-aggregate before their
    shuffle, and windows split hot orders)."""
    floor = int(lines.sparkSession.conf.get("carledger.hotKeyRows", None) or 1_000_000)

    def hot(top: int, total: int) -> bool:
        return top > max(2 * total / buckets, floor)
    # Groups of keys hold no less than each of their keys; few of them are counted without a shuffle of the keys.
    return hot(*counted) if counted else hot(*_rows_of(lines.select(key_group(key).alias("k")), "k")) and hot(*_rows_of(lines, key))


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    return files_state(spark, [f"{sf_dir}/{t}.parquet" for t in ("part", "customer", "lineitem", "orders")])


class FleetStore:
    """Catalog tables ``fleet_<token>_<name>`` over files in the shared folder."""

    def __init__(self, spark: SparkSession, root: str, token: str, buckets: int,
                 bucket_history: bool = True):
        self.spark, self.root, self.token, self.buckets = spark, root, token, buckets
        self.bucket_history = bucket_history
        #: Versions of each table, and batches of the history, that are done.
        self.done = {"cars": [0], "clients": [0], "orders": [0], "history": [0]}
        self.bucket_layout: dict[str, bool] = {}
        self.layouts: dict[str, int] = {}
        #: Results whose outputs are written once and read by several queries.
        self.results: dict = {}
        #: Tables that are derived and written when first read.
        self.pending: dict = {}
        self._lock = threading.RLock()

    def _written(self, table: str) -> None:
        with self._lock:
            build = self.pending.get(table)
            if build is not None:
                build()
                del self.pending[table]
                drop_shuffles(self.spark)

    def _name(self, table: str) -> str:
        return f"fleet_{self.token}_{table}"

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table as it is, or as it was before a batch."""
        self._written(name)
        done = [v for v in self.done[name] if before is None or v < before]
        df = self.spark.table(self._name(name))
        if name == "history":
            return df.filter(F.col("batch") <= max(done)).drop("batch")
        return df.filter(F.col("version") == max(done)).drop("version")

    def layout(self, key: str) -> DataFrame:
        """The history bucketed by ``client_pass`` or ``car_reg_num``, written
        when first asked for after a batch. If one key holds so much that
        its bucket would be most of the work, it is sorted by the key
        instead, and row groups are skipped by their range and bloom filter."""
        name = next(n for n, k in LAYOUTS.items() if k == key)
        last = max(self.done["history"])
        table = self._name(f"{name}_{last}")
        if name not in self.layouts or self.layouts[name] != last:
            rows = self.table("history").select(*HISTORY_COLS)
            self.bucket_layout[name] = not has_hot_order(rows, key, self.buckets)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self._write(name, rows, f"{self.root}/{name}/batch{last}", table, mode="overwrite")
            self.layouts[name] = last
        return self.spark.table(table)

    # --------------------------------------------------------------- write
    def _write(self, name: str, df: DataFrame, path: str, table: str, mode: str = "errorifexists", dealt: bool = False) -> None:
        """``dealt``: the rows lie in the partitions of their buckets."""
        n = self.buckets
        if name == "history" and self.bucket_history:
            w = ((df if dealt else df.repartition(n, "order_id")).write.mode(mode).partitionBy("batch", "status")
                 .bucketBy(n, "order_id").sortBy("order_id", "id"))
        elif name == "history":
            w = df.sortWithinPartitions("order_id", "id").write.mode(mode).partitionBy("batch", "status")
        elif name == "orders":
            w = df.repartition(n, "id").write.mode(mode).partitionBy("version").bucketBy(n, "id").sortBy("id")
        elif name in LAYOUTS and self.bucket_layout[name]:
            w = df.repartition(n, LAYOUTS[name]).write.mode(mode).bucketBy(n, LAYOUTS[name]).sortBy(LAYOUTS[name], "id")
        elif name in LAYOUTS:
            w = df.sortWithinPartitions(LAYOUTS[name], "id").write.mode(mode)
        else:
            w = df.write.mode(mode).partitionBy("version")
        if name == "history" or name in LAYOUTS:
            # Point lookups by client or car (the secondary indexes of the
            # source schema) skip row groups through parquet bloom filters.
            w = (w.option("parquet.bloom.filter.enabled#client_pass", "true")
                 .option("parquet.bloom.filter.enabled#car_reg_num", "true"))
        w.option("path", path).saveAsTable(table)

    @classmethod
    def create(cls, spark: SparkSession, cars: DataFrame, clients: DataFrame, history: DataFrame,
               orders: DataFrame | None = None, buckets: int | None = None,
               lines: tuple[DataFrame, str] | None = None) -> "FleetStore":
        """Write the tables (open orders derived from the history if not
        given) under a fresh folder of the shared checkpoint location, which
        goes when the application ends. ``lines``: a table with one row for
        each history row and its order column, if there is a cheaper one
        than the history to look for hot orders in."""
        root = shared_path(spark, "fleet")
        forget_at_exit(spark, root)
        lines = lines or (history, "order_id")
        counted = _rows_of(*lines)
        n = buckets or _buckets(spark, counted[1])
        hot = has_hot_order(*lines, n, counted)
        st = cls(spark, root, hashlib.sha1(root.encode()).hexdigest()[:10], n, bucket_history=not hot)
        st._first("cars", cars.select(*DT.CAR_COLS))
        st._first("clients", clients.select("pass", "name"))
        st._first("history", history.select(*HISTORY_COLS))
        if orders is not None and "first_car" not in orders.columns:
            orders = orders.select(*DT.ORDER_COLS).join(DT.first_cars(st.table("history")), "id", "left")
        st._first_orders(orders)
        return st

    def _first(self, name: str, df: DataFrame, dealt: bool = False) -> None:
        """Write a table as it is before the first batch."""
        rows = without_empty(df).withColumn("batch" if name == "history" else "version", F.lit(0))
        path = f"{self.root}/{name}"
        if name in self.pending:
            # What a try that failed has left.
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
            delete_path(self.spark, path)
        self._write(name, rows, path, self._name(name), dealt=dealt)

    def _first_orders(self, orders: DataFrame | None = None) -> None:
        if orders is None:
            orders = DT.open_orders_with_first_car(self.table("history"))
        self._first("orders", orders.select(*DT.ORDER_COLS, "first_car"))

    @classmethod
    def ingest(cls, spark: SparkSession, sf_dir: str, buckets: int | None = None) -> "FleetStore":
        """The store of a data directory. Each table is derived and written
        when it is first read, so a query pays for those that it reads."""
        lines = DT.read_table(spark, sf_dir, "lineitem", ["l_orderkey"])
        root = shared_path(spark, "fleet")
        forget_at_exit(spark, root)
        rows = lines.count()
        st = cls(spark, root, hashlib.sha1(root.encode()).hexdigest()[:10], buckets or _buckets(spark, rows))

        def history() -> None:
            st.bucket_history = not has_hot_order(lines, "l_orderkey", st.buckets)
            if st.bucket_history:
                st._first("history", DT.rent_history(spark, sf_dir, st.buckets), dealt=True)
            else:
                st._first("history", DT.rent_history(spark, sf_dir))

        def orders() -> None:
            if "history" in st.pending and rows > ALONE_ROWS:
                st._first_orders(DT.open_orders_with_first_car(DT.rent_history(spark, sf_dir, st.buckets, maybe_open=True)))
            else:
                st._first_orders()
        st.pending = {"cars": lambda: st._first("cars", DT.cars(spark, sf_dir)),
                      "clients": lambda: st._first("clients", DT.clients(spark, sf_dir)),
                      "history": history, "orders": orders}
        return st

    def write_all(self) -> "FleetStore":
        """Write the tables that nothing has read so far."""
        for name in list(self.pending):
            self._written(name)
        return self

    # ------------------------------------------------------- apply results
    def _put(self, name: str, df: DataFrame, column: str, batch: int) -> None:
        """Write one partition (``column`` = batch), over what it may hold."""
        self._written(name)
        table = self.spark.table(self._name(name))
        key = {"history": "order_id", "orders": "id"}.get(name)
        if key and (name == "orders" or self.bucket_history):
            df = df.repartition(self.buckets, key)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            df.withColumn(column, F.lit(batch)).select(*table.columns).write.mode("overwrite").insertInto(self._name(name))
        finally:
            self.spark.conf.set(mode, before)

    def apply(self, batch: int, verb, name: str | None = None) -> None:
        """Apply a batch of calls under its number, which grows from batch
        to batch: ``verb`` gets the tables as they were before the batch and
        gives its result, for table ``name``, or for all tables (a journal's
        result). History ids are the verb's plus the largest id of earlier
        batches, so they differ over batches. One writer at a time.

        The same number again computes the same rows and overwrites them;
        one that is not larger than another batch that came later is an
        error."""
        if batch <= 0 or any(v > batch for done in self.done.values() for v in done):
            raise ValueError(f"batch {batch} is not the last one")
        result = verb(StoredFleetTables(self.spark, "-", store=self, before=batch))
        tables = {name: result.table} if name else {n: getattr(result, n) for n in ("cars", "clients", "orders")}
        if "orders" in tables and "first_car" not in tables["orders"].columns:
            # An order that was not there before begins with its car.
            old = self.table("orders", batch).select("id", "first_car")
            tables["orders"] = (tables["orders"].join(old, "id", "left")
                                .withColumn("first_car", F.coalesce("first_car", "car_reg_num")))
        if result.history is not None:
            top = self.table("history", batch).agg(F.max("id")).first()[0] or 0
            rows = result.history.select(*HISTORY_COLS).withColumn("id", F.col("id") + F.lit(top).cast("long"))
            self._put("history", without_empty(rows), "batch", batch)
        for n, df in tables.items():
            self._put(n, without_empty(df), "version", batch)
        for n in [*tables, *(["history"] if result.history is not None else [])]:
            self.spark.sql(f"REFRESH TABLE {self._name(n)}")
            self.done[n] = [*[v for v in self.done[n] if v != batch], batch]
        self.results.clear()

    def drop(self) -> None:
        """Remove the store's tables and files."""
        for t in ("cars", "clients", "history", "orders"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(t)}")
        for t, last in self.layouts.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{t}_{last}')}")
        delete_path(self.spark, self.root)

    @classmethod
    def for_dir(cls, spark: SparkSession, sf_dir: str) -> "FleetStore":
        """The session's store for ``sf_dir``, ingested on first use and
        again (the old one dropped) when files of its tables have changed."""
        key = (spark.sparkContext.applicationId, sf_dir)
        now = state_of(spark, sf_dir)
        with _LOCK:
            state, st = _STORES.get(key, (None, None))
            if st is None or state != now:
                if st is not None:
                    st.drop()
                st = cls.ingest(spark, sf_dir)
                _STORES[key] = (now, st)
            return st


class StoredFleetTables:
    """Same interface as ``driver_tables.FleetTables``, over the store."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: FleetStore | None = None, before: int | None = None):
        self.spark, self.sf_dir, self.before = spark, sf_dir, before
        self.store = store or FleetStore.for_dir(spark, sf_dir)

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name, self.before)

    def once(self, name: str, build):
        """A result on the stored tables that several queries read: built by
        the first of them, gone with the store."""
        if name not in self.store.results:
            self.store.results[name] = build()
        return self.store.results[name]

    @property
    def cars(self) -> DataFrame:
        return self._table("cars").select(*DT.CAR_COLS)

    @property
    def clients(self) -> DataFrame:
        return self._table("clients").select("pass", "name")

    @property
    def history(self) -> DataFrame:
        return self._table("history").select(*HISTORY_COLS)

    @property
    def orders_first_car(self) -> DataFrame:
        """Open orders with the car each began with."""
        return self._table("orders").select(*DT.ORDER_COLS, "first_car")

    @property
    def orders(self) -> DataFrame:
        return self._table("orders").select(*DT.ORDER_COLS)

    @property
    def car_states(self) -> DataFrame:
        from carledger.operators.quality import car_states
        return car_states(self.spark)

