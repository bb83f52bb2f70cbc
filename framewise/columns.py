"""``col`` and ``udf``: builders of the column expressions that ``Frame.map`` takes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise import types


class Col:
    """A column by name and what is done to it. Every method gives a new one."""

    def __init__(self, name: str, expr: Column | None = None) -> None:
        self.name = name
        self.expr = F.col(f"`{name}`") if expr is None else expr

    def _with(self, expr: Column) -> "Col":
        return Col(self.name, expr)

    def cast(self, kind: int | T.DataType) -> "Col":
        return self._with(types.cast(self.expr, kind))

    def to_datetime(self, mask: str, last_year: int | None = None) -> "Col":
        """A date read with a pattern such as ``dd/MM/yy HH:mm:ss.SSSSSS``; unreadable texts become null.

        A year of two digits is of 2000 to 2099, or with ``last_year`` of the hundred years that end with it.
        """
        day = F.to_date(F.try_to_timestamp(self.expr, F.lit(mask)))
        if last_year is not None:
            back = F.add_months(day, -1200 * F.ceil((F.year(day) - last_year) / 100).cast("int"))
            day = F.when(F.dayofmonth(back) == F.dayofmonth(day), back)  # no 29 February in 1900
        return self._with(day)

    def year(self) -> "Col":
        return self._with(F.year(self.expr))

    def month(self) -> "Col":
        return self._with(F.month(self.expr))

    mouth = month

    def day(self) -> "Col":
        return self._with(F.dayofmonth(self.expr))

    def hour(self) -> "Col":
        return self._with(F.hour(self.expr))

    def minute(self) -> "Col":
        return self._with(F.minute(self.expr))

    def second(self) -> "Col":
        return self._with(F.second(self.expr))

    def date(self) -> "Col":
        return self._with(F.to_date(self.expr))

    def time(self) -> "Col":
        """Time of day as ``HH:mm:ss``."""
        return self._with(F.date_format(self.expr, "HH:mm:ss"))

    def dayofyear(self) -> "Col":
        return self._with(F.dayofyear(self.expr))

    def weekofyear(self) -> "Col":
        """ISO week."""
        return self._with(F.weekofyear(self.expr))

    week = weekofyear

    def dayofweek(self) -> "Col":
        """Monday is 0."""
        return self._with(F.weekday(self.expr))


class Udf:
    """A Python function over columns and constants, row by row, sent in Arrow batches."""

    def __init__(self, fn: Callable[..., Any], kind: int | T.DataType, *args: Any) -> None:
        call = F.udf(fn, types.spark_type(kind), useArrow=True)
        self.expr = call(*[a.expr if isinstance(a, Col) else a if isinstance(a, Column) else F.lit(a) for a in args])


class VectorUdf:
    """A function over pandas Series instead of single values; the faster kind."""

    def __init__(self, fn: Callable[..., Any], kind: int | T.DataType, *args: Any) -> None:
        call = F.pandas_udf(fn, types.spark_type(kind))
        self.expr = call(*[a.expr if isinstance(a, Col) else a if isinstance(a, Column) else F.lit(a) for a in args])


col = Col
udf = Udf
vector_udf = VectorUdf


def expr_of(f: Any) -> Column:
    """The Spark column of a ``Col``, ``Udf``, Spark column or constant."""
    return f.expr if isinstance(f, (Col, Udf, VectorUdf)) else f if isinstance(f, Column) else F.lit(f)
