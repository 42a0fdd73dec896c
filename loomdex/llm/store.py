"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own if the master is local (tests on one machine),
    else an error: executors of a cluster would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: a later loss of an executor reads it again, not its plan.

    Tables of results stay until the folder is cleared, since Spark reads them lazily; drop() deletes one that no plan reads any more.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[got] = path
    return got


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made. Only for those whose readers have all been run and written themselves."""
    for t in tables:
        if (path := _PATHS.pop(t, None)) is not None:
            _delete(t.sparkSession, path)
