"""Intermediate tables and side files in the folder that the cluster shares.

Every table that cuts lineage and every side file goes below ``spark.checkpoint.dir``; a folder of our own is set only
where the session has none (tests, local runs). Tables are written by Spark's committer. Side files are written by tasks
under a temporary name and then renamed, so a retried or speculative task can only replace a file by an equal one.
"""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets one on this machine only where none is configured and the master is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(_FALLBACK)
        found = sc.getCheckpointDir()
    return found if ":" in found.split("/")[0] else f"file://{found}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh, unused folder URI below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows of a batch that a Python task gets while a table is written; texts can be long.
BATCH = "1000"


def written(df: DataFrame, what: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: (table, folder). Cuts the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    before = spark.conf.get(rows := "spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, BATCH)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path), path


def whole_row(names: list[str]) -> Column:
    """A struct of the columns of these names, whatever characters they have."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in names))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders of :func:`shared_dir` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def task_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a Python task uses for a folder URI of Spark, and the path there; raises where there is none."""
    kind, _, rest = uri.partition(":")
    if kind in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif kind == "dbfs":  # mounted on every node
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    return pafs.FileSystem.from_uri(uri)


def loadable(uri: str) -> bool:
    """Whether tasks can read tables below this URI themselves."""
    try:
        task_store(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def put(uri: str, data: bytes) -> None:
    """Write one side file from a task: temporary name, then rename."""
    folder, _, name = uri.rpartition("/")
    store, at = task_store(folder)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{at}/{name}")


_LOADED: dict[str, list] = {}


def load_sorted(folder: str, columns: tuple[str, ...]) -> list:
    """In a task: the long columns of a small table of the shared folder as numpy arrays, sorted by the first one.

    A worker process keeps the two tables it read last. The caller has checked the table's size.
    """
    if folder not in _LOADED:
        import numpy as np
        import pyarrow.parquet as pq

        store, at = task_store(folder)
        names = sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
        parts = [pq.read_table(n, columns=list(columns), filesystem=store) for n in names]
        cols = [np.concatenate([np.zeros(0, np.int64), *(p[c].to_numpy() for p in parts)]) for c in columns]
        order = np.argsort(cols[0], kind="stable")
        while len(_LOADED) > 1:  # the two tables read last stay
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[folder] = [c[order] for c in cols]
    return _LOADED[folder]


def relieve() -> None:
    """In a task: give back what earlier stages left in this worker process, loaded tables and freed memory that Arrow keeps."""
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
