"""Lookups of history rows by many clients or cars.

The stored history is laid out by order. A second layout, bucketed by the
looked-up key (``FleetStore.layout``), serves lookups: a list of values reads
only the buckets and row groups they lie in, and a table of keys joins it
without a shuffle of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_of(layout: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of a few keys, given as values."""
    return layout.filter(F.col(key).isin(list(values)))


def history_for(layout: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of the keys of a table; repeated and NULL keys add nothing."""
    return layout.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi").select(*layout.columns)
