"""Readers: csv, txt, json, parquet, pickle and shapefile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise import types
from framewise.sources.shapefile import ShapefileSource

#: Texts read as missing unless keep_default_na is off.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _parts(df: DataFrame, n: int | str) -> DataFrame:
    return df if n in ("*", -1, None) else df.repartition(int(n))


class Reader:
    """``read.csv(...)`` and its siblings; every one gives a Frame and reads nothing yet."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _frame(self, df: DataFrame):
        from framewise.frame import Frame

        return Frame(df)

    def csv(
        self, filepath: str | Sequence[str], num_of_parts: int | str = "*", schema: str | Mapping[str, int] = "str", sep: str = ",", header: bool = True, delimiter: str | None = None,
        na_filter: bool = True, usecols: Sequence[str] | None = None, prefix: str | None = None, engine: str | None = None, converters: Mapping[str, Any] | None = None,
        true_values: Sequence[str] | None = None, false_values: Sequence[str] | None = None, skipinitialspace: bool = False, na_values: Any = None, keep_default_na: bool = True,
        skip_blank_lines: bool = True, parse_dates: Sequence[str] | bool = False, decimal: str = ".", dayfirst: bool = False, thousands: str | None = None, quotechar: str = '"',
        doublequote: bool = True, escapechar: str | None = None, comment: str | None = None, encoding: str = "utf-8", error_bad_lines: bool = True, warn_bad_lines: bool = True,
        delim_whitespace: bool = False, float_precision: str | None = None,
    ):
        """Delimited text: a file, a folder or a list. Every column is a text unless ``schema`` types it.

        Without a header columns are ``<prefix>0..`` (``col_0..``). Lines with too many fields fail
        the read, or are dropped with ``error_bad_lines=False``; too few fields are nulls. ``engine``, ``float_precision`` and
        ``warn_bad_lines`` have no effect.
        """
        sep = "\t" if delim_whitespace else (delimiter or sep)
        r = self.spark.read.option("sep", sep).option("header", header).option("quote", quotechar or "\u0000").option("escape", escapechar or ('"' if doublequote and quotechar == '"' else quotechar if doublequote else "\\"))
        r = r.option("encoding", encoding).option("ignoreLeadingWhiteSpace", skipinitialspace).option("mode", "FAILFAST" if error_bad_lines else "DROPMALFORMED").option("enforceSchema", False).option("inferSchema", False)
        r = r.option("comment", comment) if comment else r
        paths = [filepath] if isinstance(filepath, str) else list(filepath)
        if delim_whitespace:
            lines = self.spark.read.text(paths, wholetext=False)
            parts = F.split(F.trim("value"), r"\s+", -1)
            first = lines.first()
            names = first[0].split() if first and header else [f"_c{i}" for i in range(len(first[0].split()) if first else 0)]
            rows = lines.where(F.col("value") != first[0]) if header and first else lines
            df = rows.where(F.trim("value") != "").select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
        else:
            df = r.csv(paths)
        if not header:
            df = df.toDF(*[f"{prefix or 'col_'}{i}" for i in range(len(df.columns))])
        if usecols:
            df = df.select(*[F.col(f"`{c}`") for c in usecols])
        return self._frame(_parts(self._typed(df, schema, na_filter, na_values, keep_default_na, true_values, false_values, converters, parse_dates, dayfirst, decimal, thousands), num_of_parts))

    txt = csv

    def _typed(self, df: DataFrame, schema, na_filter, na_values, keep_default_na, true_values, false_values, converters, parse_dates, dayfirst, decimal, thousands) -> DataFrame:
        base = MISSING if keep_default_na else []
        if na_filter:
            new: dict[str, Column] = {}
            for c in df.columns:
                own = na_values.get(c, []) if isinstance(na_values, Mapping) else na_values or []
                missing = [*base, *([own] if isinstance(own, str) else map(str, own))]
                new[c] = F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")) if missing else F.col(f"`{c}`")
            df = df.withColumns(new)
        kinds = {} if isinstance(schema, str) else dict(schema)
        new = {}
        for c, kind in kinds.items():
            if c not in df.columns:
                continue
            x = F.col(f"`{c}`")
            if types.spark_type(kind) in (T.LongType(), T.DoubleType()):
                x = F.replace(x, F.lit(thousands), F.lit("")) if thousands else x
                x = F.replace(x, F.lit(decimal), F.lit(".")) if decimal != "." else x
                for values, number in ((true_values, "1"), (false_values, "0")):
                    x = F.when(x.isin(list(values)), F.lit(number)).otherwise(x) if values else x
            new[c] = types.cast(x, kind)
        for c in df.columns if parse_dates is True else (parse_dates or []):
            patterns = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy"] if dayfirst else ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]
            x = F.col(f"`{c}`")
            new[c] = F.coalesce(x.try_cast("timestamp_ntz"), *[F.try_to_timestamp(x, F.lit(p)).cast("timestamp_ntz") for p in patterns])
        for c, f in (converters or {}).items():
            new[c] = F.udf(f, T.StringType(), useArrow=True)(F.col(f"`{c}`"))
        return df.withColumns(new) if new else df

    def json(self, filepath: str | Sequence[str], num_of_parts: int | str = "*", schema: str | Mapping[str, int] = "str", precise_float: bool = False, encoding: str = "utf-8"):
        """JSON lines; scalars are texts unless ``schema`` types them."""
        r = self.spark.read.option("primitivesAsString", isinstance(schema, str)).option("encoding", encoding)
        df = r.json([filepath] if isinstance(filepath, str) else list(filepath))
        if not isinstance(schema, str):
            df = df.withColumns({c: types.cast(F.col(f"`{c}`"), k) for c, k in schema.items() if c in df.columns})
        return self._frame(_parts(df, num_of_parts))

    def parquet(self, filepath: str | Sequence[str], num_of_parts: int | str = "*", columns: Sequence[str] | None = None):
        """Parquet files; ``columns`` are the only ones read."""
        df = self.spark.read.parquet(*([filepath] if isinstance(filepath, str) else filepath))
        return self._frame(_parts(df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df, num_of_parts))

    def pickle(self, filepath: str | Sequence[str], num_of_parts: int | str = "*"):
        """Pickled pandas frames, one per file (or a folder of them), read by the tasks. Only for files one trusts.

        The columns and types are those of the whole first file; the others must have them.
        """
        import io

        import pandas as pd

        paths = [filepath] if isinstance(filepath, str) else list(filepath)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.pkl*").load(paths).select("content")
        first = files.first()
        if first is None:
            raise FileNotFoundError(f"no pickle files in {paths}")
        shape = self.spark.createDataFrame(pd.read_pickle(io.BytesIO(bytes(first[0])), compression=None)).schema

        def run(batches):
            for b in batches:
                for content in b["content"]:
                    yield pd.read_pickle(io.BytesIO(content), compression=None)[shape.names]

        return self._frame(_parts(files.mapInPandas(run, shape), num_of_parts))

    def shapefile(self, shp_path: str, dbf_path: str, polygon: str = "points", attributes: Sequence[str] | None = None, num_of_parts: int | str = "*", schema: str | Mapping[str, int] = "str", lat_first: bool = True):
        """An ESRI shapefile with its attribute table: attributes, and ``polygon`` as a list of [lat, lon]."""
        self.spark.dataSource.register(ShapefileSource)
        r = self.spark.read.format("framewise_shapefile").option("shp", shp_path).option("dbf", dbf_path).option("polygon", polygon).option("lat_first", str(lat_first))
        df = r.load()
        if attributes:
            df = df.select(*[F.col(f"`{c}`") for c in attributes if c in df.columns], F.col(f"`{polygon}`"))
        if not isinstance(schema, str):
            df = df.withColumns({c: types.cast(F.col(f"`{c}`"), k) for c, k in schema.items() if c in df.columns})
        return self._frame(_parts(df, num_of_parts))
