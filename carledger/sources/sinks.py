"""Delimited-file exports of reports.

The reference spools two reports as delimited text: ``;`` between fields,
``'`` around a field when it needs quoting, a header line with the export
names. Here every task writes its own part file in parallel; the export's
order is kept across part files (part-00000 holds the first range, and so
on) because the DataFrame is range-sorted. Nothing passes through the
driver and there is no single-file ``coalesce(1)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carledger.functions.textfn import without_empty
from carledger.operators import reports as R
from carledger.plans.joins import materialize

# Field separator and quote character of the exports.
SEPARATOR = ";"
QUOTE = "'"


def write_delimited(df: DataFrame, path: str, quote_all: bool = False, mode: str = "errorifexists") -> str:
    """Part files with a header. NULL and an empty text, which is NULL, are
    an empty field; separators, quotes and line ends are quoted."""
    (without_empty(df).write.mode(mode)
     .option("sep", SEPARATOR).option("quote", QUOTE).option("escape", QUOTE)
     .option("header", True).option("quoteAll", quote_all)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .csv(path))
    return path


def read_delimited(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = (spark.read.option("sep", SEPARATOR).option("quote", QUOTE).option("escape", QUOTE)
         .option("header", True).option("multiLine", True))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def export_orders_history(history: DataFrame, path: str, **kw) -> str:
    """R1 export: the change history, ordered by rented_at."""
    return write_delimited(R.orders_history_export(history), path, **kw)


def export_cars_history(history: DataFrame, cars: DataFrame, path: str, **kw) -> str:
    """R2 export: per (car, order, client) rental span and revenue."""
    return write_delimited(R.cars_history_export(history, cars), path, **kw)


def read_ordered(spark: SparkSession, path: str, schema) -> DataFrame:
    """An export's rows with ``position``, their place in it from 0: part
    files in the order of their numbers, rows in the order of the lines. A
    file that does not fit the schema is an error.

    A part file is read by one task (its lines may hold line ends), so rows
    count within their file, and the counts of the earlier files, a row for
    each file, are added."""
    r = (spark.read.option("sep", SEPARATOR).option("quote", QUOTE).option("escape", QUOTE).option("header", True)
         .option("multiLine", True).option("mode", "FAILFAST").schema(schema).csv(path))
    number = lambda i: F.regexp_extract("_file", r"part-(\d+)-.*?(?:-c(\d+))?\.csv", i).cast("long")
    rows = materialize(r.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")))
    files = rows.groupBy("_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(number(1), number(2)).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return rows.join(starts, "_file").select(*r.columns, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("position"))
