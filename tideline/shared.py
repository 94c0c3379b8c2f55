"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "file:///tmp/checkpoints"
_written: list[tuple[weakref.ref, str]] = []
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where it is unset and all runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = _OWN_DIR
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when this process ends."""
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut there.

    ``codec``: zstd for long texts; its native buffers are too large for many small files.
    A lost executor costs only the tasks that were under way; what was written stays.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove written tables that nothing needs any more, and let Spark drop the shuffle files behind them."""
    for df in tables:
        if path := _paths.pop(id(df), None):
            remove(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written_paths() -> list[str]:
    """All fresh paths of this process so far."""
    return [path for _, path in _written]


def paths_of(df: DataFrame) -> list[str]:
    """The root folders of the files that a plan reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out += [roots.apply(i).toString() for i in range(roots.size())]
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for ref, path in _written:
        if (spark := ref()) is not None:
            with contextlib.suppress(Exception):
                remove(spark, path)


atexit.register(_remove_all)
