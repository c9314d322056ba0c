"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written by :func:`cut` that nothing has deleted yet.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder (a Parquet file or a directory of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.  Where none is set a temporary one serves a local master; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and a lost executor takes nothing with it.

    The table stays until :func:`uncut`, the end of the :func:`scope` it was made in, or the end of the program.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/loomgraph/{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def uncut(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames made by :func:`cut` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables cut within it; results that read them must have been written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(_written[path], path)


@atexit.register
def _end() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
