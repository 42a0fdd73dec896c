"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write where spark.checkpoint.dir says. A folder of our own stands in only where that is unset and the
    master is local; on a cluster an unset one is an error, since each executor would write to a disk of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        at = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
    sc.setCheckpointDir(at)
