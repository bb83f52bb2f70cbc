"""Writers: csv, json, parquet and pickle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = {"overwrite": "overwrite", "ignore": "ignore", "error": "errorifexists"}


def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return MODES[mode]


class Writer:
    """``frame.save``; bound to its frame, writes at once, one file per partition."""

    def __init__(self, df: DataFrame, frame) -> None:
        self.df, self.frame = df, frame

    def csv(
        self, filepath: str, header: bool = True, mode: str = "overwrite", sep: str = ",", na_rep: str = "", float_format: str | None = None, columns: Sequence[str] | None = None, encoding: str = "utf-8",
        quoting: int | None = None, quotechar: str = '"', date_format: str | None = None, doublequote: bool = True, escapechar: str | None = None, decimal: str = ".",
    ):
        """Delimited text. ``quoting`` 1 quotes all fields, 3 none; ``float_format`` is a printf format."""
        df = self.df.select(*[F.col(f"`{c}`") for c in columns]) if columns else self.df
        new = {}
        for c, kind in df.dtypes:
            if kind in ("float", "double"):
                x = F.format_string(float_format, F.col(f"`{c}`")) if float_format else F.col(f"`{c}`").cast("string")
                x = F.when(F.col(f"`{c}`").isNotNull(), x)
                if decimal != ".":
                    x = F.replace(x, F.lit("."), F.lit(decimal))
                new[c] = x
        df = df.withColumns(new) if new else df
        w = df.write.mode(_mode(mode)).option("sep", sep).option("header", header).option("nullValue", na_rep).option("emptyValue", "").option("encoding", encoding).option("quoteAll", quoting == 1)
        w = w.option("quote", "\u0000" if quoting == 3 else quotechar).option("escape", escapechar or (quotechar if doublequote else "\\"))
        if date_format:
            w = w.option("dateFormat", date_format).option("timestampFormat", date_format).option("timestampNTZFormat", date_format)
        w.csv(filepath)
        return self.frame

    def json(self, filepath: str, mode: str = "overwrite", date_format: str | None = None, double_precision: int = 10, force_ascii: bool = True, date_unit: str = "ms"):
        """JSON lines, as the reader expects; nulls are kept."""
        doubles = {c: F.round(F.col(f"`{c}`"), double_precision) for c, kind in self.df.dtypes if kind in ("float", "double")}
        w = (self.df.withColumns(doubles) if doubles else self.df).write.mode(_mode(mode)).option("ignoreNullFields", False)
        if date_format and date_format not in ("iso", "epoch"):
            w = w.option("dateFormat", date_format).option("timestampFormat", date_format).option("timestampNTZFormat", date_format)
        w.json(filepath)
        return self.frame

    def parquet(self, filepath: str, mode: str = "overwrite", compression: str = "snappy"):
        self.df.write.mode(_mode(mode)).option("compression", compression).parquet(filepath)
        return self.frame

    def pickle(self, filepath: str, mode: str = "overwrite", compression: str | None = None):
        """One pickled pandas frame per partition, ``part_<n>.pkl``, written by the tasks (``compression`` isn't used)."""
        import os
        import shutil

        import pandas as pd

        local = filepath.removeprefix("file://").removeprefix("file:")
        if "://" in local:
            raise ValueError("pickle files are written to a mounted file system")
        if os.path.exists(local):
            if mode == "ignore":
                return self.frame
            if mode == "error":
                raise FileExistsError(local)
            shutil.rmtree(local)
        _mode(mode)
        os.makedirs(local)

        def run(batches):
            from pyspark import TaskContext

            whole = [b for b in batches]
            if whole:
                pd.concat(whole, ignore_index=True).to_pickle(os.path.join(local, f"part_{TaskContext.get().partitionId():05d}.pkl"), compression=None)
                yield pd.DataFrame({"n": [sum(map(len, whole))]})

        self.df.mapInPandas(run, "n long").agg(F.sum("n")).collect()
        return self.frame
