"""Positions inside groups of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.session import cut


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    Rows are range-partitioned by group *and* order, so a huge group spreads over
    many tasks: each counts its own slice and adds what lies in the slices before.
    ``order`` has to be unique inside a group.
    """
    sliced = cut(
        rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy(*group, "slice").orderBy(*order))
    return (
        sliced.withColumn("inside", inside)
        .join(offsets, [*group, "slice"])
        .withColumn(name, F.col("offset") + F.col("inside"))
        .drop("slice", "inside", "offset")
    )
