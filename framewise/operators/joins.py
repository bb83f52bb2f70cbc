"""Equi-joins with the library's naming rule and null rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("inner", "left", "right")


def equi_join(left: DataFrame, right: DataFrame, key1: Sequence[str], key2: Sequence[str], mode: str = "inner", suffixes: Sequence[str] = ("_l", "_r"), keep_keys: bool = False, case: bool = True, drop_null_keys: bool = True) -> DataFrame:
    """``left`` joined with ``right`` on ``key1`` = ``key2``.

    A name on both sides gets ``suffixes[0]`` on the left, except a key if ``keep_keys`` is false, and
    ``suffixes[1]`` on the right, keys included. With ``keep_keys`` false the right key columns are
    dropped; in mode ``right`` the left ones are, and the right ones get their names. Rows with a null
    key are dropped on both sides first. ``case=False`` compares keys as lower-case texts. The join
    strategy is left to the optimizer and adaptive execution.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not key1 or len(key1) != len(key2):
        raise ValueError("both sides need the same number of keys")
    if drop_null_keys:
        left, right = left.dropna(subset=list(key1)), right.dropna(subset=list(key2))
    clash = set(left.columns) & set(right.columns)
    names_l = {c: c + suffixes[0] if c in clash and (keep_keys or c not in key1) else c for c in left.columns}
    names_r = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    a = left.select(*[F.col(f"`{c}`").alias(f"__fw_l{i}") for i, c in enumerate(left.columns)])
    b = right.select(*[F.col(f"`{c}`").alias(f"__fw_r{i}") for i, c in enumerate(right.columns)])
    at_l = {c: f"__fw_l{i}" for i, c in enumerate(left.columns)}
    at_r = {c: f"__fw_r{i}" for i, c in enumerate(right.columns)}
    key = (lambda c: F.col(c)) if case else (lambda c: F.lower(F.col(c).cast("string")))
    on = reduce(lambda x, y: x & y, [key(at_l[x]) == key(at_r[y]) for x, y in zip(key1, key2)])
    joined = a.join(b, on, mode)
    out = [F.col(at_l[c]).alias(names_l[c]) for c in left.columns if keep_keys or mode != "right" or c not in key1]
    for c in right.columns:
        if c in key2 and not keep_keys:
            if mode == "right":
                out.append(F.col(at_r[c]).alias(key1[list(key2).index(c)]))
        else:
            out.append(F.col(at_r[c]).alias(names_r[c]))
    return joined.select(*out)
