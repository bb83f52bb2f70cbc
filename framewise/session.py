"""``Context``: a Spark session with the library's readers and tools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framewise import types
from framewise.frame import Frame, quoted
from framewise.operators import partition
from framewise.sources.readers import Reader


class Context:
    """Entry point. Uses the active session, or makes one that fits any master."""

    def __init__(self, spark: SparkSession | None = None, app_name: str = "framewise", conf: Mapping[str, str] | None = None) -> None:
        if spark is None:
            builder = SparkSession.builder.appName(app_name)
            for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **(conf or {})}.items():
                builder = builder.config(k, v)
            spark = builder.getOrCreate()
        self.spark = spark

    @property
    def read(self) -> Reader:
        return Reader(self.spark)

    def parallelize(self, df: pd.DataFrame, num_of_parts: int | str = "*") -> Frame:
        """A pandas frame as contiguous partitions; NaN becomes null."""
        n = self.spark.sparkContext.defaultParallelism if num_of_parts in ("*", -1) else int(num_of_parts)
        made = self.spark.createDataFrame(df)
        doubles = {c: _null_nan(c) for c, k in made.dtypes if k in ("double", "float")}
        made = made.withColumns(doubles) if doubles else made
        return Frame(partition.repartition_rows(made, partition.balanced_sizes(len(df), n)))

    def import_data(self, df_list: Sequence[pd.DataFrame] | Sequence[str], schema: Mapping[str, int] | None = None, parquet: bool = False) -> Frame:
        """Existing pandas frames (or Parquet files) as one frame, in their order."""
        if parquet:
            df = self.spark.read.parquet(*df_list)
        else:
            df = reduce(DataFrame.unionByName, [self.spark.createDataFrame(p) for p in df_list])
            doubles = {c: _null_nan(c) for c, k in df.dtypes if k in ("double", "float")}
            df = df.withColumns(doubles) if doubles else df
        if schema:
            df = df.withColumns({c: types.cast(quoted(c), k) for c, k in schema.items() if c in df.columns})
        return Frame(df)

    def stop(self) -> None:
        self.spark.stop()

    def start_monitor(self) -> str | None:
        """The address of Spark's web interface."""
        return self.spark.sparkContext.uiWebUrl

    def show_tasks(self) -> pd.DataFrame:
        """Active stages with their tasks."""
        tracker = self.spark.sparkContext.statusTracker()
        found = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return pd.DataFrame([(s.stageId, s.name, s.numTasks, s.numActiveTasks, s.numCompletedTasks, s.numFailedTasks) for s in found if s], columns=["stage", "name", "tasks", "active", "completed", "failed"])

    def set_log(self, level: str | bool = "WARN") -> None:
        self.spark.sparkContext.setLogLevel({True: "INFO", False: "ERROR"}.get(level, level))

    @staticmethod
    def context_status(frame: Frame) -> str:
        """The frame's plan."""
        return frame.df._jdf.queryExecution().toString()


def _null_nan(c: str):
    from pyspark.sql import functions as F

    return F.when(~F.isnan(quoted(c)), quoted(c))
