"""Connected components of a graph that is given as its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each end of the edges ``a, b``: the smallest node that can be reached.

    Per round a node takes the smallest component of its neighbours and then the one
    that this stands for by now, so long chains shorten by half. Each round
    is written; the last one changes nothing.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = cut(edges.filter("a <> b").select(ends.alias("e")).select("e.a", "e.b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").withColumn("taken", F.least("component", "near"))
        known = taken.select(F.col("node").alias("taken"), F.col("taken").alias("further"))
        moved = cut(taken.join(known, "taken").select("node", F.least("taken", "further").alias("component"), F.col("component").alias("before")))
        labels = moved.drop("before")
        if moved.filter("component <> before").isEmpty():
            return labels
