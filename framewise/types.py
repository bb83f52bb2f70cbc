"""Data types of the library and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType:
    """Type codes for casts, schemas and user functions. DECIMAL is a double."""

    INT = 1
    STRING = 2
    DECIMAL = 3
    TIMESTAMP = 4
    DATE = 5
    ARRAY = 6


SPARK: dict[int, T.DataType] = {
    DataType.INT: T.LongType(),
    DataType.STRING: T.StringType(),
    DataType.DECIMAL: T.DoubleType(),
    DataType.TIMESTAMP: T.TimestampNTZType(),
    DataType.DATE: T.DateType(),
    DataType.ARRAY: T.ArrayType(T.StringType()),
}


def spark_type(kind: int | T.DataType) -> T.DataType:
    """The Spark type of a code (or a Spark type as it is)."""
    if isinstance(kind, T.DataType):
        return kind
    if kind not in SPARK:
        raise ValueError(f"unknown type {kind!r}: use a DataType code")
    return SPARK[kind]


def cast(c: Column, kind: int | T.DataType) -> Column:
    """``c`` as ``kind``; what can't be converted becomes null. Texts with decimals become ints by truncation."""
    target = spark_type(kind)
    if isinstance(target, T.LongType):
        return F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long"))
    if isinstance(target, T.ArrayType):
        return c
    return c.try_cast(target)
