"""What steps leave behind."""

import time

from pyspark.sql import functions as F

from marquee.session import cut, shipped, tidy


def shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(k).isShuffle() for k in range(blocks.size()))


def test_shuffle_files_go_with_their_step(spark):
    shipped(spark)
    before = shuffle_files(tidy(spark))
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = cut(counts)
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    # Rows can be asked for again.
    assert [len(counts.collect()) for _ in range(3)] == [100] * 3 and kept.count() == 100
