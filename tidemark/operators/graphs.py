"""Graphs and hierarchies as edge tables: neighbours, reachable nodes, shortest paths, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import checkpointed, written
from ..functions.scalars import div

# Edges have columns src and dst, and kind and weight where an operator says so.


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str | None = None, direction: str = "both") -> DataFrame:
    """(node, neighbour, kind) of `nodes` (column node) by edges that leave them (out), reach them (in), or both."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "kind")
    into = e.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "kind")
    chosen = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return chosen.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def subgraph(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges with both ends among `nodes`."""
    e = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    wanted = nodes.select("node").distinct()
    return e.join(wanted.withColumnRenamed("node", "src"), "src", "left_semi").join(wanted.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree."""
    n = nodes.agg(F.count_distinct("node").alias("nodes")).withColumn("_one", F.lit(1))
    m = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("_one", F.lit(1))
    out = n.join(m, "_one").drop("_one")
    return out.withColumns({"density": div(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1), 0.0), "mean_degree": div(2 * F.col("edges"), F.col("nodes"), 0.0)})


def distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, depth, previous): what each source (column node) reaches in at most `most` steps, breadth first.

    Of several predecessors at the same depth the smallest is taken. Each step joins the last step's nodes with the
    edges and drops nodes seen before; it is checkpointed, and steps end early when nothing new is reached.
    """
    e = edges.select("src", "dst").distinct()
    front = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("previous")).distinct()
    seen = front = checkpointed(front)
    for depth in range(1, most + 1):
        step = front.join(e, front["node"] == e["src"]).groupBy("source", F.col("dst").alias("_next")).agg(F.min("node").alias("previous"))
        new = step.join(seen.select(F.col("source").alias("_s"), F.col("node").alias("_n")), (F.col("source") == F.col("_s")) & (F.col("_next") == F.col("_n")), "left_anti")
        front = checkpointed(new.select("source", F.col("_next").alias("node"), F.lit(depth).alias("depth"), "previous"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Each round takes every node to the smallest label among its neighbours and then to that label's own, so rounds grow
    with the logarithm of a component's length for chains as well; each is written. Labels are aggregated
    before they are shuffled, so a node with very many edges costs one row for each task.
    """
    both = edges.select("src", "dst").filter("src <> dst")
    both = written(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "_near").alias("_low"))
        above = labels.select(F.col("node").alias("_low"), F.col("component").alias("_above"))
        moved = written(lower.join(above, "_low", "left").select("node", F.col("component").alias("_was"), F.least("_low", F.coalesce("_above", "_low")).alias("component")))
        labels = moved.drop("_was")
        if moved.filter("_was <> component").isEmpty():
            return labels


def path(edges: DataFrame, source, target, most: int = 5) -> DataFrame:
    """(position, node): one shortest path of at most `most` nodes; no rows if there is none."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    found = distances(edges, spark.createDataFrame([(source,)], f"node {kind}"), most - 1)
    back = {r["node"]: r["previous"] for r in found.filter(F.col("depth") > 0).join(_on_path(found, target), "node", "left_semi").collect()}
    nodes, at = [], target if target == source or target in back else None
    while at is not None:
        nodes.append(at)
        at = back.get(at)
    return spark.createDataFrame(list(enumerate(reversed(nodes))), f"position int, node {kind}")


def _on_path(found: DataFrame, target) -> DataFrame:
    """The nodes on the way back from the target: one for each depth."""
    nodes = step = found.filter(F.col("node") == target).select("node", "previous", "depth")
    for _ in range((found.agg(F.max("depth")).first() or [0])[0] or 0):
        step = found.select("node", "previous", "depth").join(step.select(F.col("previous").alias("_p")), F.col("node") == F.col("_p"), "left_semi")
        nodes = nodes.unionByName(step)
    return nodes.select("node").distinct()


def ancestors(parents: DataFrame, most: int = 20) -> DataFrame:
    """(node, ancestor, depth) of a hierarchy (node, parent): the closure, by doubling joins checkpointed each step."""
    step = parents.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    known = front = checkpointed(step)
    for _ in range(most - 1):
        longer = front.join(parents.select(F.col("node").alias("_n"), "parent"), front["ancestor"] == F.col("_n")).filter(F.col("parent").isNotNull())
        new = longer.groupBy("node", F.col("parent").alias("_a")).agg(F.min(F.col("depth") + 1).alias("depth")).withColumnRenamed("_a", "ancestor")
        front = checkpointed(new.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def descendants(parents: DataFrame, most: int = 20) -> DataFrame:
    return ancestors(parents, most).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def subtypes(parents: DataFrame, of, most: int = 20) -> DataFrame:
    """Nodes that have `of` among their ancestors, and itself."""
    spark, kind = parents.sparkSession, parents.schema["node"].dataType.simpleString()
    return ancestors(parents, most).filter(F.col("ancestor") == of).select("node").unionByName(spark.createDataFrame([(of,)], f"node {kind}")).distinct()


def correlation_edges(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """Edges (src, dst, kind, strength, weight) of pairs (a, b, r) with |r| above `least`; the sign chooses the kind."""
    r = F.col("r")
    return pairs.filter(F.abs(r) > least).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.when(r > 0, "CORRELATES_WITH").otherwise("OPPOSITE_OF").alias("kind"), band(F.abs(r)).alias("strength"), F.abs(r).alias("weight"),
    )


def band(weight: Column) -> Column:
    return F.when(weight > 0.8, "strong").when(weight > 0.6, "moderate").otherwise("weak")
