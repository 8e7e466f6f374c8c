"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialised


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (columns a, b) that isn't its component's smallest; root is the smallest.

    Each step is written to the shared folder, so lineage stays short and nothing but two numbers reaches the driver. A vertex
    with any number of neighbours is reduced by a partial minimum and then joined, never gathered.
    """
    star = materialised(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).where("v <> root").distinct(), "edges")
    state = None
    while True:
        # large star: all larger neighbours of a vertex go to its smallest neighbour
        both = star.union(star.select(F.col("root"), F.col("v")))
        least = both.groupBy("v").agg(F.min("root").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(least, "v").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        # small star: the smaller neighbours of a vertex, and itself, go to the smallest
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).union(low.select("v", F.col("m").alias("root")))
        star = materialised(small.where("v <> root").distinct(), "edges")
        now = star.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return star
        state = now
