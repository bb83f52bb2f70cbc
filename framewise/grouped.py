"""``group_by``: a builder of aggregates that is itself a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.frame import Frame, names


def _ordered(f, by):
    return lambda c: f(c, F.struct(*[F.col(f"`{x}`") for x in by]))


def aggregate(func: str, c: Column, order_by: Sequence[str] = ()) -> Column:
    """An aggregate by name. ``first``/``last`` are those of ``order_by``, else of the partition order; nulls are passed over."""
    plain = {
        "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "list": F.collect_list, "set": F.collect_set,
        "std": F.stddev_samp, "stddev": F.stddev_samp, "var": F.var_samp, "variance": F.var_samp, "median": F.median, "nunique": F.count_distinct,
        "size": lambda _: F.count(F.lit(1)), "skew": F.skewness, "kurt": F.kurtosis, "mode": lambda x: F.mode(x, True), "prod": F.product, "any": F.bool_or, "all": F.bool_and,
    }
    if func in ("first", "last"):
        if order_by:
            pick = F.min_by if func == "first" else F.max_by
            known = F.struct(*[F.col(f"`{x}`") for x in order_by])
            return pick(c, F.when(c.isNotNull(), known))
        return (F.first if func == "first" else F.last)(c, ignorenulls=True)
    if func not in plain:
        raise ValueError(f"unknown aggregate {func!r}: one of {sorted([*plain, 'first', 'last'])}")
    return plain[func](c)


class GroupedFrame(Frame):
    """Groups of a frame. Aggregates chain: ``f.group_by('a').sum('b').count('*')`` is a frame with both."""

    def __init__(self, base: DataFrame, keys: Sequence[str] | str, keep_null_keys: bool = False, aggs: tuple[Column, ...] = ()) -> None:
        self._base, self._aggs, self._keep = base, aggs, keep_null_keys
        keys = names(keys)
        self._keys = list(base.columns) if keys == ["*"] else keys
        for k in self._keys:
            if k not in base.columns:
                raise ValueError(f"unknown column {k!r}")

    @property
    def df(self) -> DataFrame:
        return self._grouped(self._aggs)

    def _grouped(self, aggs: Sequence[Column]) -> DataFrame:
        rows = self._base if self._keep else self._base.dropna(subset=[f"`{k}`" for k in self._keys])
        keys = [F.col(f"`{k}`") for k in self._keys]
        return rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()

    def agg(self, order_by: Sequence[str] | str | None = None, **operations: tuple[str, str]) -> Frame:
        """``alias=(column, function)``; these alone make the result."""
        by = names(order_by or [])
        return Frame(self._grouped([self._one(c, f, by).alias(a) for a, (c, f) in operations.items()]))

    @staticmethod
    def _one(c: str, func: str, order_by: Sequence[str]) -> Column:
        return F.count(F.lit(1)) if c == "*" else aggregate(func, F.col(f"`{c}`"), order_by)

    def _add(self, func: str, cols: Sequence[str] | str, alias: Sequence[str] | str | None, order_by: Sequence[str] | str | None = None) -> "GroupedFrame":
        cols, alias = names(cols), names(alias or [])
        alias += [f"{func}({c})" for c in cols[len(alias) :]]
        new = tuple(self._one(c, func, names(order_by or [])).alias(a) for c, a in zip(cols, alias))
        return GroupedFrame(self._base, self._keys, self._keep, self._aggs + new)

    def avg(self, cols, alias=None):
        return self._add("avg", cols, alias)

    def mean(self, cols, alias=None):
        return self._add("mean", cols, alias)

    def count(self, cols, alias=None):
        """Known values; ``'*'`` counts rows."""
        return self._add("count", cols, alias)

    def first(self, cols, alias=None, order_by=None):
        return self._add("first", cols, alias, order_by)

    def last(self, cols, alias=None, order_by=None):
        return self._add("last", cols, alias, order_by)

    def list(self, cols, alias=None):
        return self._add("list", cols, alias)

    def set(self, cols, alias=None):
        return self._add("set", cols, alias)

    def max(self, cols, alias=None):
        return self._add("max", cols, alias)

    def min(self, cols, alias=None):
        return self._add("min", cols, alias)

    def sum(self, cols, alias=None):
        return self._add("sum", cols, alias)
