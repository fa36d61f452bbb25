"""Small helpers on tables: written intermediates, checked broadcasts, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a written table that may be broadcast, as Parquet; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a folder of this machine
    serves a session that runs on it alone; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="holdfast-"))
        found = _own[0]
    return found


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside go when it ends; what was made of them must be stored by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, until the ``scratch`` around it, if any, ends."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    for held in _scratch[-1:]:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small in bytes. A table that is read as it was written (columns of it,
    perhaps) is measured by its files, without a job; any other is written first."""
    measured = df if _scanned(df) else written(df)
    return F.broadcast(measured) if _bytes(measured) <= most else measured


def _scanned(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.nodeName() in ("LogicalRelation", "DataSourceV2ScanRelation")


def _bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    spark = df.sparkSession
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(configuration).getFileStatus(path).getLen()
    return total


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables in the folder ``path``, in order; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 0 in the order of the columns ``order``, without gathering it in one task:
    range partitions are sorted each, and their sizes give the first rank of each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("part")).count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    both = placed.withColumn("part", part).join(F.broadcast(before), "part")  # a row per partition
    return both.withColumn(name, F.col("before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "__id")
