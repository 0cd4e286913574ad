"""Connected components of a graph of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import delete, new_table, splittable, stored, written


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node of each node's component: (node, component).

    ``links`` has the columns a and b. Nodes without a link are left out. Each round points every
    node's larger neighbours, then its smaller ones, at the smallest node it knows, until
    all point straight at their component's; the rounds grow with the logarithm of a component's diameter. A round's table goes
    once the next one's is written.
    """
    spark = links.sparkSession
    folder = new_table(spark)
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        # As many rows as edges at most, so that the equal ones may go on.
        large = both.filter("b > a").join(splittable(smallest, "a"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(splittable(lower, "a"), "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("x"))
            .select("x.*")
            .filter("a <> b")
            .distinct()
        )
        last, folder = folder, new_table(spark)
        edges = written(small, folder)
        delete(spark, last)
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    found = stored(edges.unionByName(roots).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    delete(spark, folder)
    return found


def merged_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) with more ``links`` (a, b) between their nodes or new ones: (node, component).

    Only the components that the links touch take part in the rounds.
    """
    known = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    ends = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
    found = connected_components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = splittable(found.withColumnRenamed("component", "now"), "node").withColumnRenamed("node", "component")
    old = components.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stored(old.unionByName(found.join(components, "node", "left_anti").select("node", "component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node at most, and none points at a node that points on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    # A leaf has one row; a centre has rows of 0 only.
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).filter("out > 1 OR (out = 1 AND least = 0)").isEmpty()
