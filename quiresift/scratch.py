"""Tables that several later steps read, kept where every executor sees them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quiresift-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Tables of the freed() blocks that are open, the innermost last.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


@contextmanager
def freed() -> Iterator[None]:
    """Tables that keep() writes within the block, but for lasting ones, are deleted at its end: nothing that outlives it may read them."""
    own: list[DataFrame] = []
    mark = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(mark)
        drop(*own)


def keep(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Cuts the lineage like checkpoint() does, but stays columnar and compressed.
    The table goes with drop() or the freed() block around it, or else when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _open.get() and not lasting:
        _open.get()[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() returned, once nothing that is still to run reads them."""
    for table in tables:
        where, files = _file_system(table.sparkSession, table._kept_at)
        files.delete(where, True)
