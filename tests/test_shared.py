from __future__ import annotations

import time

from pyspark.sql import functions as F

from canopyq.sources.shared import estimate, free_shuffles, shared_checkpoint


def test_size_of_repeated_joins_stays_a_number(spark):
    t = shared_checkpoint(spark.range(3).groupBy("id").count())
    for _ in range(9):
        t = shared_checkpoint(t.join(t.withColumnRenamed("count", "c"), "id").select("id", F.greatest("count", "c").alias("count")))
    assert estimate(t).bit_length() <= 63
    assert sorted(map(tuple, t.collect())) == [(0, 1), (1, 1), (2, 1)]


def shuffle_files(spark):
    """Bytes of each shuffle file of this process."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    sizes = {}
    while found.hasNext():
        at = found.next()
        if at.getName().startswith("shuffle_") and at.getName().endswith(".data"):
            sizes[at.getPath()] = at.length()
    return sizes


def test_shuffle_files_go_when_nothing_reads_them(spark):
    before = set(shuffle_files(spark))
    out = shared_checkpoint(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).count())
    for _ in range(20):  # they are removed in the background
        free_shuffles(spark)
        if not (left := set(shuffle_files(spark)) - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 5000
