"""Text lines of the reports, as the reference prints them.

The typed report columns are the product; these are optional projections
for users who read the printed lines. Two text rules of the reference's
SQL dialect are kept: ``||`` treats NULL as empty (``concat_ws('')``), and
a number prints without trailing zeros and without the 0 before the
decimal point (``3600.00`` -> ``3600``, ``0.50`` -> ``.5``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carledger.functions.timefn import col_, fmt17

# The label texts of the lines below, and currency marks of the printed lines (the car and order lists
# carry U+FFFD where the source file lost its character; other lines use P).
MARK_BROKEN = "�"
MARK_P = "P"


def num_text(c) -> Column:
    """Decimal -> text: no trailing zeros, no '.' at the end, no 0 before '.'."""
    s = col_(c).cast("string")
    s = F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1")
    s = F.regexp_replace(s, r"\.$", "")
    return F.regexp_replace(s, r"^(-?)0\.", "$1.")


def cat(*parts) -> Column:
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    """One row per printed line, ``line_no`` keeps the order inside a row."""
    return df.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def cars_report_lines(report: DataFrame) -> DataFrame:
    return report.select("reg_num", cat(
        "Reg num ", F.col("reg_num"), ": ", num_text("orders_num"), " orders, ",
        num_text("clients_num"), " clients, revenue ", num_text("total_revenue"), " P, ",
        num_text("total_rented_time"), " days in rent, ", num_text("days_since_service"),
        " from last serving").alias("line"))


def client_report_lines(report: DataFrame) -> DataFrame:
    return report.select("client_pass", F.posexplode(F.array(
        cat("Client: ", F.col("client_pass"), ", used cars: ", F.col("car_list")),
        cat("  Revenue: ", num_text("revenue")))).alias("line_no", "line"))


def fin_report_lines(report: DataFrame) -> DataFrame:
    return report.select(cat("Fin report for ", fmt17("start_ts"), " - ", fmt17("end_ts"), ": ",
                             num_text("revenue"), " ", MARK_P).alias("line"))


def orders_changes_report_lines(report: DataFrame) -> DataFrame:
    r = F.col
    return _lines(
        report,
        cat("Total orders: ", num_text(r("total_orders"))),
        cat("Open orders: ", num_text(r("open_orders"))),
        cat("Avg changing of order: ", num_text(r("avg_changes"))),
        cat("Avg number of usage cars: ", num_text(r("avg_cars"))),
        cat("Avg renew time (in days): ", num_text(r("avg_renew"))),
        cat("Revenue by order(min, avg, max): ", num_text(r("min_price")), " ", num_text(r("avg_price")),
            " ", num_text(r("max_price"))),
    )


def autopark_status_lines(status: DataFrame) -> DataFrame:
    return status.select("state_id", cat("[", F.col("state"), "] ", num_text("num")).alias("line"))


def find_car_lines(found: DataFrame) -> DataFrame:
    return found.select("reg_num", cat(
        "[", F.col("state"), "]", F.col("reg_num"), ": ", F.col("color"), ", ", F.col("type"), ", ",
        F.col("mark"), " - ", num_text("price"), MARK_P).alias("line"))


def list_cars_lines(cars: DataFrame) -> DataFrame:
    return cars.select("reg_num", cat(
        "[", F.col("state"), "]", F.col("reg_num"), ": ", F.col("color"), ", ", F.col("mark"), ", ",
        F.col("type"), " - ", MARK_BROKEN, num_text("price")).alias("line"))


def list_clients_lines(clients: DataFrame) -> DataFrame:
    return clients.select("pass", cat(F.col("pass"), ": ", F.col("name")).alias("line"))


def list_orders_lines(orders: DataFrame) -> DataFrame:
    ts = "dd.MM.yy HH:mm:ss,SSSSSS"
    return orders.select("id", cat(
        "[", F.col("id").cast("string"), "], (", F.col("client_pass"), ":", F.col("car_reg_num"), "), (",
        F.date_format("rented_at", ts), " - ", F.date_format("returned_at", ts), ") - ", MARK_BROKEN,
        num_text("total_price")).alias("line"))
