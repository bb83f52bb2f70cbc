"""What all models share: column arguments, naming of outputs, and JSON persistence."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.frame import Frame, names

__all__ = ["F", "Column", "DataFrame", "Frame", "Model", "emit", "names", "out_names", "spark_df", "x"]


def spark_df(data: Frame | DataFrame) -> DataFrame:
    return data.df if isinstance(data, Frame) else data


def x(c: str) -> Column:
    return F.col(f"`{c}`")


def out_names(inputs: Sequence[str], output: Sequence[str] | str | None, default: str = "") -> list[str]:
    """One output per input: a list as it is, a text as a suffix; without either the default suffix (none: in place)."""
    if output is None:
        output = default
    return [f"{c}{output}" for c in inputs] if isinstance(output, str) else list(output)


def emit(df: DataFrame, new: dict[str, Column], inputs: Sequence[str] = (), remove: bool = False) -> Frame:
    """``df`` with the new columns last; ``remove`` takes the inputs out."""
    gone = {*new, *(inputs if remove else ())}
    return Frame(df.select(*[x(c) for c in df.columns if c not in gone], *[v.alias(k) for k, v in new.items()]))


class Model:
    """A fitted model is its plain parameters; ``save_model``/``load_model`` write and read them as JSON."""

    parameters: ClassVar[tuple[str, ...]] = ()

    def fit_transform(self, data: Frame, *args: Any, **kwargs: Any) -> Frame:
        out = {k: kwargs.pop(k) for k in ("output_col", "pred_col", "remove") if k in kwargs}
        return self.fit(data, *args, **kwargs).transform(data, **out)

    def check_fitted(self) -> None:
        missing = [p for p in self.parameters if getattr(self, p, None) is None]
        if missing:
            raise ValueError(f"{type(self).__name__} isn't fitted")

    def save_model(self, filepath: str, overwrite: bool = True) -> "Model":
        """A folder with one JSON text, on any file system Spark writes to."""
        from pyspark.sql import SparkSession

        body = json.dumps({"class": type(self).__name__, "state": {k: v for k, v in vars(self).items() if not k.startswith("_")}})
        spark = SparkSession.active()
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(filepath)
        return self

    def load_model(self, filepath: str) -> "Model":
        from pyspark.sql import SparkSession

        body = json.loads(SparkSession.active().read.text(filepath, wholetext=True).first()[0])
        if body["class"] != type(self).__name__:
            raise ValueError(f"a {body['class']} is saved there")
        vars(self).update(body["state"])
        return self
