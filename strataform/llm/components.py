"""Connected components of an edge table, by least labels and pointer jumping.

Nothing is collected: each round joins tables of two ids and cuts its lineage; only the number of labels that changed
comes to the driver. Keys with very many rows are left to adaptive execution, which splits skewed joins, and least labels
are combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns v and root, the least id of its component, for every id that has an edge to another."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("far"))
        step = cut_lineage(step.join(jump, "next").select("v", "root", F.least("next", "far").alias("next")))
        changed = step.where("root <> next").limit(1).count()
        labels = step.select("v", F.col("next").alias("root"))
        if not changed:
            return labels
