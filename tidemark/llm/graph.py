"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: A node with more than a share of 1 / HOT of all edges, and more than HOT, is hot; so at most 2 * HOT nodes are.
HOT = 1_000


def _with_least(edges: DataFrame, ends: DataFrame, count: int) -> DataFrame:
    """`edges` (u, v) with _m, the smallest v of their u in `ends`. What belongs to hot nodes is joined where it lies."""
    least = ends.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_in"))
    hot, other = (least.filter(c).select("u", "_m") for c in (F.col("_in") > max(HOT, count // HOT), F.col("_in") <= max(HOT, count // HOT)))
    if count <= HOT or not hot.limit(1).count():
        return edges.join(least.select("u", "_m"), "u")
    return edges.join(F.broadcast(hot), "u").unionByName(edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(other, "u"))


def least_ids(reach: DataFrame, classes: DataFrame, salts: int) -> DataFrame:
    """(_rep, component): for each class of `reach` (node, component), the smallest _least of the classes in its component.

    Classes have a _rep of their own each, and _least, their smallest id, which several may have in common.
    `salts` copies of each component's row meet its classes, as one component may hold many.
    """
    named = stored(reach.withColumnRenamed("node", "_rep").join(classes.select("_rep", "_least"), "_rep"), "components")
    least = named.groupBy("component").agg(F.min("_least").alias("_component")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("_rep"), F.lit(salts)).cast("int"))
    return salted.join(least, ["component", "_salt"]).select("_rep", F.col("_component").alias("component"))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach. Nodes without edges have no row.

    Each round joins edges with the smallest neighbour of their ends and is written to the shared folder;
    rounds go on until the edges stay the same. Only a count and a checksum come to the driver.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = stored(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    was = None
    while True:
        checksum = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if checksum == was or not checksum[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        was = checksum
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour, or to itself.
        nearest = _with_least(both.filter(F.col("v") > F.col("u")), both, checksum[0])
        large = nearest.select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        # Small star: every smaller neighbour of a node, and the node, go to the smallest.
        small = _with_least(large, large, checksum[0])
        linked = small.select(F.col("v").alias("u"), F.col("_m").alias("v")).filter(F.col("u") != F.col("v")).unionByName(small.select("u", F.col("_m").alias("v")))
        now = stored(linked.distinct(), "edges")
