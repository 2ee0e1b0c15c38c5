"""The folder that all executors share, for tables that cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder from the session's settings.

    Only where all of Spark is one process (local mode) and none is set, a folder of
    this machine is made; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = context.getConf().get("spark.checkpoint.dir", None)
        if at is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that all executors share")
            at = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(at)
    return context.getCheckpointDir()


#: Bits of Spark's estimate of a table's size beyond which it is dropped: it says no more than "too large to broadcast".
SIZE_BITS = 63


def estimate(df: DataFrame) -> int:
    """Spark's estimate of df's bytes."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def free_shuffles(spark: SparkSession) -> None:
    """Have shuffle files go that nothing reads any longer; for after large ones.

    Spark's cleaner acts when the driver's garbage is collected, the later the larger
    its heap.  To remove a query's files at its end (Spark has a setting for that)
    breaks jobs that adaptive execution has given up and that still run.
    """
    spark._jvm.System.gc()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder, without its lineage.

    checkpoint() keeps the plan's estimated size, and a join's is the product of
    its sides: over rounds of joins the number's digits double again and again,
    until they fill the driver.  A size beyond all bounds gives way to the default.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    if estimate(out).bit_length() <= SIZE_BITS:
        return out
    jdf = out._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
