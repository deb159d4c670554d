"""Time helpers as Column expressions (JVM-side, no UDF).

``ts_diff(a, b)`` is the signed number of days from ``b`` to ``a`` with a
fraction (days + hours/24 + minutes/1440 + seconds/86400). It is computed
from the exact microsecond difference, which also works on zone-less
timestamps and keeps the sign in every part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carledger.functions.fixed import TS17_FORMAT

MICROS_PER_DAY = 86_400_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(a, b) -> Column:
    """Exact microseconds from b to a (bigint), a - b."""
    return F.timestamp_diff("MICROSECOND", col_(b), col_(a))


def ts_diff(a, b) -> Column:
    """Days from b to a as a double (exact for multiples of 2^-k days)."""
    return micros_between(a, b) / F.lit(float(MICROS_PER_DAY))


def trunc_seconds(ts) -> Column:
    return F.date_trunc("second", col_(ts)).cast("timestamp_ntz")


def add_days(ts, days, hours=0) -> Column:
    """ts + days + hours, with integer columns or literals."""
    d = col_(days) if not isinstance(days, int) else F.lit(days)
    h = col_(hours) if not isinstance(hours, int) else F.lit(hours)
    return col_(ts) + F.make_dt_interval(d.cast("int"), h.cast("int"))


def plus_one_day(ts) -> Column:
    """Reference ``ts + 1``: whole seconds kept, one day added."""
    return trunc_seconds(ts) + F.make_dt_interval(F.lit(1))


def fmt17(ts) -> Column:
    """17-character text of a timestamp: dd.MM.yy HH:mm:ss."""
    return F.date_format(col_(ts), TS17_FORMAT)
