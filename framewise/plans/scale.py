"""Plan helpers shared by the operators: lineage cuts, size-checked broadcasts, free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows; its columns are keys and scalars.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the session names in ``spark.checkpoint.dir``.

    Only a session on one machine (tests, a laptop) may leave that unset and gets a temporary folder; on a cluster
    executors don't see the driver's folders, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="framewise-")


def split_code(c: Column) -> Column:
    """``c`` (a number) unchanged, by way of a lambda. Spark puts a projection with a lambda in it outside whole-stage code and
    splits its expressions into small methods; a large projection inside becomes one method, which the JVM
    interprets if it is over 8,000 bytes."""
    return F.get(F.transform(F.array(c), lambda v: v + F.lit(0.0)), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    done = df.checkpoint(eager=True)
    # A checkpoint keeps the size that its plan was estimated at, and a join multiplies its sides' sizes: over the rounds
    # of a loop the estimate doubles its digits each time. A frame over the stored rows alone has none; adaptive
    # execution then decides by the real sizes.
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: for tables with many rows that are scanned several times,
    by column and compressed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``cut`` and ``store`` have left in the shared folder for this application. Frames built on it can't be read any more."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    there = sc._jsc.sc().getCheckpointDir()
    folders = [there.get()] if there.isDefined() else []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        for item in fs.listStatus(path) if fs.exists(path) else []:
            if item.getPath().getName().startswith(("rdd-", "stored-")):
                fs.delete(item.getPath(), True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Equi-join a large side with one that is expected, but not known, to be small.

    ``small`` must be cheap to count (cut or aggregated). Up to ``limit`` rows it is broadcast. Beyond
    that both sides are shuffled on the keys and a salt, so that a hot key is spread over ``salts`` tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    return join_salted(big, small, on, how, salts)


def join_salted(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Shuffle join in which every row of ``small`` is repeated per salt and rows of ``big`` draw one."""
    salt = free_name("__fw_salt", big.columns + small.columns)
    spread = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, salt], how).drop(salt)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_2``, ``name_3`` ... if a column of that name (in any case) is there already."""
    used = {x.lower() for x in taken}
    k, found = 2, name
    while found.lower() in used:
        found, k = f"{name}_{k}", k + 1
    return found


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
