"""A Merkle manifest of a table, with a proof for every row, by higher-order functions over blocks of ordered leaves.

Leaves are placed in order within their group, and `WIDTH` consecutive ones are a block: an array in one row.
Within a block, sequence, transform, slice and aggregate collapse level after level. The blocks' roots are nodes
in order again, so the same step runs on them until each group has one root, and then on the groups' roots. Proofs
come down the same way: a node's path is what it meets in its own block, followed by the path of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nodes that are hashed together, levels that a block collapses, and so the nodes of a block.
ARITY, DEPTH = 2, 10
WIDTH = ARITY**DEPTH


def digest(*parts: Column) -> Column:
    """The lowercase hexadecimal sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def fold(node: Column, path: Column) -> Column:
    """The root that `node` and the siblings of `path` give."""
    return F.aggregate(path, node, lambda at, step: digest(step["left"], at, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with _pos, the place within their group _g, from 0, and _n, the group's rows.

    Rows are dealt by ranges of the order, so a group of any size is spread over tasks; what lies before a range
    comes from a table of one row for each range and group.
    """
    by = ["_g", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    here = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}).drop("_tie"), "placed")
    runs = here.groupBy("_g", "_part").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(runs.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_n")), "shifts")
    return here.join(shifts, ["_g", "_part"]).withColumn("_pos", F.col("_m") + F.col("_shift")).drop("_part", "_m", "_shift")


def _level(nodes: Column) -> Column:
    """The next level: each run of ARITY nodes, the last one maybe shorter, becomes its digest."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, ARITY), ""), 256))


def _steps(depth: Column) -> Column:
    """1 to depth; an empty array for none."""
    return F.slice(F.sequence(F.lit(0), depth), F.lit(2), depth)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(_g, _block, _n, _items, _levels) of nodes (_g, _pos, _n, _node, _with): the last level of each block is one node.

    A group of several blocks collapses DEPTH levels in each of them, also in the last, shorter one.
    """
    items = F.array_sort(F.collect_list(F.struct("_pos", "_node", "_with")))
    blocks = nodes.groupBy("_g", F.floor(F.col("_pos") / WIDTH).alias("_block")).agg(F.max("_n").alias("_n"), items.alias("_items"))
    powers = F.array(*[F.lit(ARITY**k) for k in range(DEPTH)])
    depth = F.size(F.filter(powers, lambda w: w < F.col("_n")))
    first = F.array(F.transform("_items", lambda x: x["_node"]))
    return blocks.withColumn("_levels", F.aggregate(_steps(depth), first, lambda levels, _: F.concat(levels, F.array(_level(F.element_at(levels, -1))))))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round, until every group is one block."""
    rounds = []
    while True:
        blocks = stored(_blocks(nodes), "blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("_n")).first()[0] or 0) <= WIDTH:
            return rounds
        root = F.element_at(F.element_at("_levels", -1), 1)
        nodes = blocks.select("_g", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / WIDTH).alias("_n"), root.alias("_node"), F.lit(None).cast("int").alias("_with"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(_g, _pos, _node, _with, _path, and the further columns of `above`) of the first round's nodes; `above` (_g, _pos, _path, ...) is of the last round's blocks."""
    carried = [c for c in above.columns if c not in ("_g", "_pos", "_path")]
    powers = F.array(*[F.lit(ARITY**k) for k in range(DEPTH + 1)])

    def own_path(i: Column) -> Column:
        def step(k: Column) -> Column:
            nodes = F.get(F.col("_levels"), k - 1)
            at = F.floor(i / F.get(powers, k - 1)).cast("int")
            low = at - at % ARITY
            return F.struct(F.array_join(F.slice(nodes, low + 1, at - low), "").alias("left"), F.array_join(F.slice(nodes, at + 2, low + ARITY - 1 - at), "").alias("right"))

        return F.transform(_steps(F.size("_levels") - 1), step)

    for blocks in reversed(rounds):
        both = blocks.join(above.withColumnsRenamed({"_pos": "_block", "_path": "_above"}), ["_g", "_block"])
        opened = F.transform("_items", lambda x, i: F.struct(x["_pos"].alias("_pos"), x["_node"].alias("_node"), x["_with"].alias("_with"), F.concat(own_path(i), F.col("_above")).alias("_path")))
        above = both.select("_g", *carried, F.inline(opened))
        if blocks is not rounds[0]:
            above = above.drop("_node", "_with")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", order_col: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """Per row of `docs`: `order_col`, leaf, subroot, root and path, plus the columns named in `also`.

    A leaf is the digest of `fields`. Within each value of `group_col`, null being one, leaves ascend by `order_col`
    (nulls first; rows that share it by their leaves, so that repeated rows give one tree), and every ARITY
    consecutive nodes become their digest until one is left, the subroot; a lone node at the end of a level is
    hashed alone, a lone leaf is its own subroot. Subroots in the order of their groups, null first, by bytes, give
    the root likewise. `path` has for each level the siblings to the left and to the right, joined: `fold(leaf,
    path)` is the root, `proof(path)` a digest of the path. Empty texts are values of no bytes, texts of any
    length are hashed whole. Further columns do not matter. An empty table gives an empty one.
    """
    also = also or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    carried = F.struct(F.col(order_col).alias("_0"), *[c.alias(f"_{k}") for k, c in enumerate(also.values(), 1)])
    leaves = stored(docs.select(group.alias("_g"), F.col(order_col).alias("_order"), leaf(*[F.col(c) for c in fields]).alias("_node"), carried.alias("_with")), "leaves")
    rounds = _climb(_placed(leaves, ["_order", "_node"]))
    subroots = rounds[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_with"), F.element_at(F.element_at("_levels", -1), 1).alias("_node"))
    tops = _climb(_placed(subroots, ["_with"]))
    root = F.element_at(F.element_at("_levels", -1), 1)
    start = tops[-1].select("_g", F.lit(0).cast("long").alias("_pos"), F.array().cast("array<struct<left:string,right:string>>").alias("_path"), root.alias("_root"))
    groups = _descend(tops, start).select(F.col("_with").alias("_g"), F.lit(0).cast("long").alias("_pos"), "_path", F.col("_node").alias("_subroot"), "_root")
    rows = _descend(rounds, stored(groups, "groups"))
    return rows.select(F.col("_with._0").alias(order_col), F.col("_node").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"), *[F.col(f"_with._{k}").alias(c) for k, c in enumerate(also, 1)])
