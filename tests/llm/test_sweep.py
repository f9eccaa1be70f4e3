"""Intermediate tables: what was shuffled to write one does not stay on disk."""

import time

from pyspark.sql import functions as F

from tessella.llm.common import _SWEEP, written


def test_written_leaves_no_shuffle(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, kept = files(), spark.conf.get(_SWEEP, None)
    out = written(spark.range(1_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sweep")
    for _ in range(50):  # files go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 7 and spark.conf.get(_SWEEP, None) == kept
