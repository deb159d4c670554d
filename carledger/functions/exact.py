"""Exact decimal arithmetic for money and averages.

Money is kept as integer cents and durations as integer microseconds, so
``price * days`` is ``cents * micros / 86_400_000_000``: a ratio of two
integers. Rounding such a ratio half away from zero is done with integer
division only, so the result is exact, independent of summation order,
and identical in any SQL engine that has integer division.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from carledger.functions.timefn import MICROS_PER_DAY, col_

INT = "decimal(38,0)"


def as_int(c) -> Column:
    return col_(c).cast(INT)


def cents(price) -> Column:
    """Integer cents of a decimal(.,2) amount."""
    return (col_(price) * F.lit(100)).cast(INT)


def floor_div(a, b) -> Column:
    """floor(a / b) for b > 0, exact on decimal(38,0)."""
    a, b = as_int(a), as_int(b)
    return ((a - F.pmod(a, b)) / b).cast(INT)


def round_ratio(num, den, scale: int = 2) -> Column:
    """num/den rounded half away from zero to ``scale`` places; den > 0.

    Returns an integer count of 10^-scale units (decimal(38,0)).
    """
    n, d = as_int(num), as_int(den)
    k = F.lit(2 * 10 ** scale).cast(INT)
    mag = floor_div(F.abs(n) * k + d, d * F.lit(2).cast(INT))
    return (F.signum(n).cast(INT) * mag).cast(INT)


def round_ratio_up(num, den, scale: int = 2) -> Column:
    """num/den rounded half up (toward +inf) to ``scale`` places; den > 0."""
    n, d = as_int(num), as_int(den)
    k = F.lit(2 * 10 ** scale).cast(INT)
    return floor_div(n * k + d, d * F.lit(2).cast(INT))


def units_to_decimal(units, scale: int = 2, precision: int = 38) -> Column:
    """Integer count of 10^-scale units -> decimal(precision, scale), exact."""
    step = F.lit(Decimal(1).scaleb(-scale))
    return (as_int(units) * step).cast(f"decimal({precision},{scale})")


def money_of_price_days(price_cents_micros, scale: int = 2) -> Column:
    """sum(cents * micros) -> money: divide once by micros/day and 100,
    rounded half away from zero."""
    den = F.lit(MICROS_PER_DAY * 100).cast(INT)
    return units_to_decimal(round_ratio(price_cents_micros, den, scale), scale)


def exact_days_money(micros, price, scale: int = 6) -> Column:
    """price * ts_diff as an exact decimal(38, scale) (scale >= 5 keeps
    every multiple of 1/8 day exact; other values rounded half away)."""
    return money_of_price_days(as_int(micros) * cents(price), scale)


def ratio_decimal(num, den, scale: int = 2) -> Column:
    """Exact half-away rounding of num/den to decimal(38, scale); NULL if den = 0."""
    d = as_int(den)
    return F.when(d > 0, units_to_decimal(round_ratio(num, d, scale), scale))
