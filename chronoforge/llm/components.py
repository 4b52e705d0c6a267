"""Connected components of links that no single machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written


def _least(edges: DataFrame) -> DataFrame:
    """For each u its least neighbour or itself, beside each of its edges; sums per task come first."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return edges.join(least, "u")  # a table beside a plain shuffle: the edges of a hub can be split


def components(links: DataFrame) -> DataFrame:
    """links(a, b), numbers -> node, label (the least node of its component), for every node that has a link.

    Each round links all larger neighbours of a node to its least one, then all smaller ones; the
    rounds end when no edge changes, after about log2 of the longest path.
    """
    with temporary(links.sparkSession):
        edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
        edges = written(edges, "cc")
        before = None
        while True:
            now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before or not now[0]:
                break
            before = now
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            small = _least(large).select("u", "v", "m")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            edges = written(small.filter("u > v").distinct(), "cc")
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        return written(labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "cc-labels", outlive=True)
