"""Dropping and filling missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, int], int]:
    """(nulls by column, rows): one aggregate."""
    row = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in columns]).first()
    return {c: row[0] - row[i + 1] for i, c in enumerate(columns)}, row[0]


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, mode: str = "REMOVE_ROW", how: str = "any", thresh: int | None = None) -> DataFrame:
    """Rows or columns with missing values taken out; names not in ``df`` are ignored.

    REMOVE_ROW: ``any``/``all`` of the subset missing, or fewer than ``thresh`` present. REMOVE_COLUMN:
    columns with a missing value, missing in every row, or missing in more than ``thresh`` rows.
    """
    cols = [c for c in (subset or df.columns) if c in df.columns]
    if mode == "REMOVE_ROW":
        return df.dropna(how=how, thresh=thresh, subset=[f"`{c}`" for c in cols]) if cols else df
    if mode != "REMOVE_COLUMN":
        raise ValueError("mode must be REMOVE_ROW or REMOVE_COLUMN")
    nulls, rows = null_counts(df, cols)
    if thresh is not None:
        gone = [c for c in cols if nulls[c] > thresh]
    elif how == "any":
        gone = [c for c in cols if nulls[c] > 0]
    else:
        gone = [c for c in cols if nulls[c] == rows]
    return df.drop(*gone)


def fill_missing(df: DataFrame, subset: Sequence[str] | None = None, mode: str = "VALUE", value: Any = None) -> DataFrame:
    """Missing values replaced.

    VALUE: by ``value`` where types allow it, or by column from a dict (then ``subset`` doesn't count).
    MEAN and MEDIAN (exact): numeric columns by that of their known values. MODE: by the most frequent
    value, the smallest of those tied. Columns without a known value stay as they are.
    """
    mode = mode.upper()
    if mode == "VALUE":
        if isinstance(value, Mapping):
            return df.fillna({k: v for k, v in value.items() if k in df.columns})
        if value is None:
            raise ValueError("a value is needed")
        cols = [c for c in (subset or df.columns) if c in df.columns]
        return df.fillna(value, subset=[c for c in cols])
    kinds = dict(df.dtypes)
    cols = [c for c in (subset or df.columns) if c in kinds]
    if mode in ("MEAN", "MEDIAN"):
        cols = [c for c in cols if kinds[c].split("(")[0] in NUMERIC]
    if not cols:
        return df
    if mode == "MODE":
        found = {c: F.mode(F.col(f"`{c}`"), True) for c in cols}
    elif mode == "MEAN":
        found = {c: F.avg(F.col(f"`{c}`")) for c in cols}
    elif mode == "MEDIAN":
        return _fill(df, exact_medians(df, cols))
    else:
        raise ValueError("mode must be VALUE, MEAN, MEDIAN or MODE")
    row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(found.values())]).first()
    return _fill(df, dict(zip(found, row)))


def _fill(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    new = {}
    for c, v in values.items():
        if v is not None:
            kind = dict(df.dtypes)[c]
            whole = kind in ("tinyint", "smallint", "int", "bigint") and isinstance(v, float) and not float(v).is_integer()
            new[c] = F.coalesce(F.col(f"`{c}`").cast("double") if whole else F.col(f"`{c}`"), F.lit(v))
    return df.withColumns(new)


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Medians (mean of the two middle values) without gathering a column: the middle ranks are found by refining histograms."""
    from framewise.operators.hotkeys import key_profile

    out: dict[str, float | None] = {}
    for c in columns:
        n = df.select(F.count(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")))).first()[0]
        if not n:
            out[c] = None
            continue
        ranks = [(n + 1) // 2, n // 2 + 1]
        one = df.select(F.lit(0).alias("__fw_one"), F.col(f"`{c}`").alias("__fw_x"))
        row = key_profile(one, ["__fw_one"], "__fw_x", [r / n for r in ranks] if ranks[0] != ranks[1] else [ranks[0] / n]).first()
        got = list(row)[-(1 if ranks[0] == ranks[1] else 2) :]
        out[c] = sum(got) / len(got)
    return out
