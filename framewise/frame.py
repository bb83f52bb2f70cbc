"""``Frame``: a lazy table with the library's operations. Every method gives a new frame over a Spark plan."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise import types
from framewise.columns import expr_of
from framewise.functions.exprs import compile_expression, split_assignment
from framewise.operators import missing, partition, stats
from framewise.operators.joins import equi_join
from framewise.plans.scale import free_name

if TYPE_CHECKING:
    from framewise.grouped import GroupedFrame
    from framewise.sources.writers import Writer


def names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def quoted(c: str):
    return F.col(f"`{c}`")


class Frame:
    """A lazy table. ``df`` is the Spark frame; missing values are nulls."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def save(self) -> "Writer":
        from framewise.sources.writers import Writer

        return Writer(self.df, self)

    def __repr__(self) -> str:
        return f"Frame[{', '.join(f'{n}: {k}' for n, k in self.df.dtypes)}]"

    # Rows and columns

    def select(self, columns: Sequence[str] | str) -> "Frame":
        """These columns; unknown names are left out."""
        return Frame(self.df.select(*[quoted(c) for c in names(columns) if c in self.df.columns]))

    def select_expression(self, *exprs: str) -> "Frame":
        """Columns by expressions ``name = expression``, later ones seeing earlier ones, or names; anything else is left out."""
        env = _locals()
        df, out = self.df, []
        for text in exprs:
            name, body = split_assignment(text)
            if name:
                df = df.withColumn(name, compile_expression(body, {c: quoted(c) for c in df.columns}, env))
                out.append(name)
            elif text.strip().strip("`") in df.columns:
                out.append(text.strip().strip("`"))
        return Frame(df.select(*[quoted(c) for c in dict.fromkeys(out)]))

    def filter(self, expr: str) -> "Frame":
        """Rows for which the expression is true."""
        return Frame(self.df.filter(compile_expression(expr, {c: quoted(c) for c in self.df.columns}, _locals())))

    def drop(self, columns: Sequence[str] | str) -> "Frame":
        """All but these columns; unknown names don't matter."""
        columns = names(columns)
        if not columns:
            raise ValueError("no columns to drop")
        return Frame(self.df.drop(*columns))

    def rename(self, old: Sequence[str] | str, new: Sequence[str] | str) -> "Frame":
        old, new = names(old), names(new)
        if len(old) != len(new):
            raise ValueError("as many new names as old ones are needed")
        return Frame(self.df.withColumnsRenamed(dict(zip(old, new))))

    def cast(self, column: Sequence[str] | str, cast: Sequence[int] | int) -> "Frame":
        """Columns as other types (one type counts for all); what can't be converted becomes null."""
        column = names(column)
        kinds = list(cast) if isinstance(cast, (list, tuple)) else [cast] * len(column)
        if len(kinds) == 1:
            kinds *= len(column)
        if len(kinds) != len(column):
            raise ValueError("one type, or as many as columns")
        return Frame(self.df.withColumns({c: types.cast(quoted(c), k) for c, k in zip(column, kinds)}))

    def map(self, f: Any, alias: str) -> "Frame":
        """Column ``alias`` from a ``col`` operation, a ``udf`` or a Spark column."""
        return Frame(self.df.withColumn(alias, expr_of(f)))

    def replace(self, replaces: Mapping[Any, Any], subset: Sequence[str] | str | None = None, regex: bool = False) -> "Frame":
        """Values by others, of another type if need be (then the column becomes text); ``regex`` replaces matches inside texts."""
        cols = [c for c in names(subset or self.df.columns) if c in self.df.columns]
        kinds = dict(self.df.dtypes)
        new = {}
        for c in cols:
            x = quoted(c)
            if regex:
                if kinds[c] != "string":
                    continue
                for a, b in replaces.items():
                    x = F.regexp_replace(x, str(a), str(b))
                new[c] = x
                continue
            text = kinds[c] == "string"
            fits = {a: b for a, b in replaces.items() if isinstance(a, str) == text and not (isinstance(a, bool) != (kinds[c] == "boolean"))}
            if not fits:
                continue
            mixed = any(b is not None and isinstance(b, str) != text for b in fits.values())
            numbers = text and all(isinstance(b, (int, float)) for b in fits.values())
            out = x.cast("string") if mixed and not numbers else x
            for a, b in reversed(list(fits.items())):
                out = F.when(x == F.lit(a), F.lit(str(b) if mixed and b is not None and not isinstance(b, str) else b)).otherwise(out)
            new[c] = out
        return Frame(self.df.withColumns(new) if new else self.df)

    def explode(self, column: str) -> "Frame":
        """One row per element of a list column, in its place."""
        return Frame(self.df.withColumn(column, F.explode(quoted(column))))

    def add_column(self, data2: "Frame", suffixes: Sequence[str] = ("_l", "_r")) -> "Frame":
        """The other frame's columns beside these, row by row, as long as the shorter."""
        return Frame(partition.zip_columns(self.df, data2.df, suffixes))

    # Missing values

    def dropna(self, subset: Sequence[str] | str | None = None, mode: str = "REMOVE_ROW", how: str = "any", thresh: int | None = None) -> "Frame":
        return Frame(missing.drop_missing(self.df, names(subset) if subset else None, mode, how, thresh))

    def fillna(self, subset: Sequence[str] | str | None = None, mode: str = "VALUE", value: Any = None) -> "Frame":
        return Frame(missing.fill_missing(self.df, names(subset) if subset else None, mode, value))

    # Joins and sets

    def join(self, data2: "Frame", key1: Sequence[str] | str | None = None, key2: Sequence[str] | str | None = None, mode: str = "inner", suffixes: Sequence[str] = ("_l", "_r"), keep_keys: bool = False, case: bool = True, drop_null_keys: bool = True) -> "Frame":
        key1 = names(key1 or key2 or [])
        return Frame(equi_join(self.df, data2.df, key1, names(key2 or key1), mode, suffixes, keep_keys, case, drop_null_keys))

    def cross_join(self, data2: "Frame", suffixes: Sequence[str] = ("_l", "_r")) -> "Frame":
        clash = set(self.df.columns) & set(data2.df.columns)
        a = self.df.select(*[quoted(c).alias(c + suffixes[0] if c in clash else c) for c in self.df.columns])
        return Frame(a.crossJoin(data2.df.select(*[quoted(c).alias(c + suffixes[1] if c in clash else c) for c in data2.df.columns])))

    def union(self, data2: "Frame") -> "Frame":
        """All rows of both, columns by place."""
        return Frame(self.df.union(data2.df))

    def union_by_name(self, data2: "Frame") -> "Frame":
        """All rows of both, columns by name, absent ones null."""
        return Frame(self.df.unionByName(data2.df, allowMissingColumns=True))

    def distinct(self, cols: Sequence[str] | str = (), opt: bool = True, order_by: Sequence[str] | str | None = None) -> "Frame":
        """One row per key (all columns if none): the first by ``order_by``, else any."""
        cols = names(cols)
        if not cols or set(cols) == set(self.df.columns):
            return Frame(self.df.distinct())
        if order_by:
            # The least row by the order, by a map-side aggregate: no key's rows are gathered.
            rest = [c for c in self.df.columns if c not in cols]
            least = F.min(F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(names(order_by))], *[quoted(c).alias(f"v{i}") for i, c in enumerate(rest)])).alias("__fw_m")
            found = self.df.groupBy(*[quoted(c) for c in cols]).agg(least)
            return Frame(found.select(*[quoted(c) if c in cols else F.col(f"__fw_m.v{rest.index(c)}").alias(c) for c in self.df.columns]))
        return Frame(self.df.dropDuplicates(cols))

    drop_duplicates = distinct

    def intersect(self, data2: "Frame") -> "Frame":
        return Frame(self.df.intersect(data2.df))

    def intersect_all(self, data2: "Frame") -> "Frame":
        return Frame(self.df.intersectAll(data2.df))

    def subtract(self, data2: "Frame") -> "Frame":
        return Frame(self.df.subtract(data2.df))

    def except_all(self, data2: "Frame") -> "Frame":
        return Frame(self.df.exceptAll(data2.df))

    # Groups, order, samples

    def group_by(self, group_by: Sequence[str] | str, keep_null_keys: bool = False) -> "GroupedFrame":
        """Groups by columns (``'*'``: all); rows with a null key belong to none unless they are kept."""
        from framewise.grouped import GroupedFrame

        return GroupedFrame(self.df, group_by, keep_null_keys)

    def sort(self, cols: Sequence[str] | str, ascending: Sequence[bool] | bool | None = None) -> "Frame":
        """Rows in order, nulls last either way; a missing flag is True."""
        cols = names(cols)
        flags = [] if ascending is None else [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
        flags += [True] * (len(cols) - len(flags))
        return Frame(self.df.orderBy(*[quoted(c).asc_nulls_last() if up else quoted(c).desc_nulls_last() for c, up in zip(cols, flags)]))

    def take(self, num: int, order_by: Sequence[str] | str | None = None) -> "Frame":
        """The first rows, of an order if one is given."""
        df = self.df.orderBy(*[quoted(c).asc_nulls_last() for c in names(order_by)]) if order_by else self.df
        return Frame(df.limit(num))

    def sample(self, value: float | int | None = None, seed: int | None = None) -> "Frame":
        """Exactly so many rows (int) or that share of them (float in [0, 1], rounded up)."""
        return Frame(partition.sample_exact(self.df, value, _seed(seed)))

    def split(self, percentage: float = 0.5, seed: int | None = None) -> tuple["Frame", "Frame"]:
        """Two frames without a common row; the first has that share of the rows, rounded up."""
        if not 0 <= percentage <= 1:
            raise ValueError("percentage must be in [0, 1]")
        import math

        total = self.df.count()
        a, b = partition.split_exact(self.df, math.ceil(round(total * percentage, 9)), _seed(seed))
        return Frame(a), Frame(b)

    def repartition(self, nfrag: int = -1, distribution: Sequence[int] | None = None) -> "Frame":
        """Contiguous partitions in order: ``nfrag`` of equal size, or of the sizes in ``distribution``."""
        sizes = list(distribution) if distribution else partition.balanced_sizes(self.df.count(), nfrag if nfrag > 0 else self.df.rdd.getNumPartitions())
        return Frame(partition.repartition_rows(self.df, sizes))

    def hash_partition(self, columns: Sequence[str] | str = (), nfrag: int | None = None) -> "Frame":
        """Partitions by a hash of the columns (all if none)."""
        cols = [quoted(c) for c in names(columns) or self.df.columns]
        return Frame(self.df.repartition(nfrag, *cols) if nfrag else self.df.repartition(*cols))

    def range_partition(self, columns: Sequence[str] | str, ascending: Sequence[bool] | bool | None = None, nfrag: int | None = None) -> "Frame":
        """Partitions by ranges of the columns."""
        cols = names(columns)
        flags = [] if ascending is None else [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
        flags += [True] * (len(cols) - len(flags))
        by = [quoted(c).asc_nulls_last() if up else quoted(c).desc_nulls_last() for c, up in zip(cols, flags)]
        return Frame(self.df.repartitionByRange(nfrag, *by) if nfrag else self.df.repartitionByRange(*by))

    def balancer(self, forced: bool = False) -> "Frame":
        """Equal partitions in the same order and number if sizes vary by more than a fifth (``forced``: by more than one row)."""
        sizes = partition.partition_counts(self.df)
        mean = sum(sizes) / len(sizes) if sizes else 0
        spread = (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5 if sizes else 0
        if mean and (spread / mean > 0.20 or (forced and max(sizes) - min(sizes) > 1)):
            return Frame(partition.repartition_rows(self.df, partition.balanced_sizes(sum(sizes), len(sizes))))
        return Frame(self.df)

    # Statistics

    def describe(self, columns: Sequence[str] | str | None = None) -> pd.DataFrame:
        return stats.describe(self.df, names(columns) if columns else None).toPandas()

    def correlation(self, col1: str, col2: str) -> float:
        return stats.correlation(self.df, col1, col2)

    def covariance(self, col1: str, col2: str) -> float:
        return stats.covariance(self.df, col1, col2)

    def cross_tab(self, col1: str, col2: str) -> "Frame":
        return Frame(stats.cross_tab(self.df, col1, col2))

    def freq_items(self, col: Sequence[str] | str, support: float = 0.01) -> "Frame":
        return Frame(stats.freq_items(self.df, names(col), support))

    def kolmogorov_smirnov_one_sample(self, col: str, distribution: str = "norm", mode: str = "asymp", args: Sequence[float] = ()) -> tuple[float, float]:
        return stats.ks_one_sample(self.df, col, distribution, mode, args)

    # Geography

    def geo_within(self, shp_object: "Frame", lat_col: str, lon_col: str, polygon: str = "points", attributes: Sequence[str] | None = None, suffix: str = "_shp") -> "Frame":
        from framewise.operators.geo import geo_within

        return Frame(geo_within(self.df, shp_object.df, lat_col, lon_col, polygon, attributes, suffix))

    def crst_transform(self, lat_col: str, lon_col: str, src_epsg: int, dst_epsg: int, lat_alias: str | None = None, lon_alias: str | None = None) -> "Frame":
        from framewise.operators.geo import crst_transform

        return Frame(crst_transform(self.df, lat_col, lon_col, src_epsg, dst_epsg, lat_alias, lon_alias))

    # Actions

    def cache(self) -> "Frame":
        """Compute now and keep on disk."""
        df = self.df.persist(StorageLevel.DISK_ONLY)
        df.count()
        return Frame(df)

    persist = cache

    def unpersist(self) -> "Frame":
        self.df.unpersist()
        return self

    def count_rows(self, total: bool = True) -> int | list[int]:
        """Rows, or rows of every partition."""
        return self.df.count() if total else partition.partition_counts(self.df)

    def num_of_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def columns(self) -> list[str]:
        return self.df.columns

    def schema(self) -> pd.DataFrame:
        return pd.DataFrame(self.df.dtypes, columns=["columns", "dtypes"])

    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def show(self, n: int = 20) -> "Frame":
        print(self.df.limit(n).toPandas())
        return self

    def to_df(self, columns: Sequence[str] | str | None = None, split: bool = False) -> pd.DataFrame | list[pd.DataFrame]:
        """All rows as pandas; ``split`` gives a list by partition."""
        df = self.df.select(*[quoted(c) for c in names(columns)]) if columns else self.df
        if not split:
            return df.toPandas()
        part = free_name("__fw_part", df.columns)
        n = df.rdd.getNumPartitions()
        whole = df.withColumn(part, F.spark_partition_id()).toPandas()
        return [whole[whole[part] == k].drop(columns=part).reset_index(drop=True) for k in range(n)]

    def export_partitions(self) -> list[pd.DataFrame]:
        return self.to_df(split=True)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> "Frame":
        """A function of Spark frames applied."""
        return Frame(f(self.df))


def _locals() -> dict[str, Any]:
    """Variables of the code that called the frame's method."""
    caller = sys._getframe(2)
    return {**caller.f_globals, **caller.f_locals}


def _seed(seed: int | None) -> int:
    if seed is not None:
        return int(seed)
    import random

    return random.randrange(1 << 31)


__all__ = ["Frame", "names", "quoted"]
