"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in links (a, b): component is the smallest id reachable.

    Each round takes the least label over a node's neighbours and then the label of that label
    (pointer jumping), so rounds grow with the logarithm of a component's diameter.  Labels stay on
    the cluster; only the number of changed rows reaches the driver.
    """
    both = kept(spark, links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = kept(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("component").alias("jumped"))
        step = kept(spark, least.join(jump, "least", "left").select("id", F.coalesce("jumped", "least").alias("component"), (F.coalesce("jumped", "least") != F.col("component")).alias("moved")), "labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels
