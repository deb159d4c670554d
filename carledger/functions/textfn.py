"""Text rules of the reference's SQL dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_empty(c: Column, kind: T.DataType | None = None) -> Column:
    """An empty text is NULL; other types are cast as they are."""
    if kind is None or isinstance(kind, T.StringType):
        return F.nullif(c.cast("string"), F.lit(""))
    return c.cast(kind)


def without_empty(df: DataFrame) -> DataFrame:
    """``df`` with NULL for every empty text."""
    return df.select(*[no_empty(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
