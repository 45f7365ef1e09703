"""Storing intermediate rows where all executors can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a session on one machine may have none; a temporary folder stands in for it there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="srcatlas-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared checkpoint folder and without lineage.

    A checkpoint keeps the size that Spark estimated for its plan. Under joins in a loop
    these estimates are multiplied again and again, until the numbers themselves take
    minutes to handle; so the stored rows become a source that has none.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    stored = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored.queryExecution().toRdd(), stored.schema(), False), spark)
