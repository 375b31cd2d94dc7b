"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Folders of the tables that ``scratch`` removes.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)
#: Folders of the tables that one reader alone takes, until ``spent`` removes them.
_ONCE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, but on a local master
    only: on a cluster every machine would have its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='affinis-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/affinis/{name}-{uuid.uuid4().hex}"


def unmarked(df: DataFrame, mode: str = "error") -> DataFrameWriter:
    """A writer that makes no _SUCCESS file. It is the one file of a table that the driver makes, and
    where there is no native Hadoop library, the driver starts a process (chmod) for each file, which
    shares its memory for a moment and is counted as much again."""
    return df.write.mode(mode).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back: computed once, and kept if executors go."""
    path = fresh(df.sparkSession, name)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    unmarked(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh`` gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Put a written folder in the place of another one, or of none."""
    removed(spark, to)
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))  # noqa: SLF001
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written into the shared folder inside go when this ends; results must lie elsewhere."""
    mark = _SCRATCH.set([])
    try:
        yield
    finally:
        for path in _SCRATCH.get():
            removed(spark, path)
        _SCRATCH.reset(mark)
        freed(spark)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written; the shuffles it came from go from the disk."""
    out = written(df, name)
    freed(df.sparkSession)
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` kept for one reader, which tells by ``spent`` that it has read it."""
    path = fresh(df.sparkSession, name)
    unmarked(df).parquet(path)
    freed(df.sparkSession)
    _ONCE.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(df: DataFrame) -> None:
    """Delete the tables for one reader that ``df`` was made from; nothing may read ``df`` again."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()} if _ONCE else set()
    for path in [p for p in _ONCE if p.rsplit("/", 1)[-1] in names]:
        removed(df.sparkSession, path)
        _ONCE.discard(path)


def leaf_bytes(df: DataFrame) -> list[int]:
    """Bytes of each table that ``df`` reads, as far as Spark knows them before it runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # noqa: SLF001
    return [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]


def freed(spark: SparkSession) -> None:
    """Let Spark remove shuffles that no plan holds any more. The listeners hold the plan of the last
    query for a moment, so garbage is collected twice."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()  # noqa: SLF001
        time.sleep(0.3)
