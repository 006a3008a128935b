"""Merkle manifest of a dataset by butterfly exchange.

Rows become leaves, in order within their group (language); every ``fanout`` consecutive nodes become one of the level
above, group roots likewise become the root. The leaves of a group are cut into blocks of 512, and
each block hashes its own subtree. Then the blocks exchange roots in rounds, as in a butterfly network: the members of up
to ``fanout`` neighbouring nodes send each other their node's digest, each to its opposite numbers, and all of them hash
the common parent for themselves. So after the last round every block holds the root and the siblings of all its
ancestors, and nothing has to be handed down the tree.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

FANOUT = 8
#: Levels of the tree that one block holds: 512 leaves for a fanout of 8.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: So many groups are sent to all tasks with the exchange over groups; more are joined.
MANY_GROUPS = 10_000

_SIDES = "array<struct<before:array<string>,after:array<string>>>"


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 (lowercase hex) of values one after the other: ``-`` for null, else the bytes of its text, ``:`` and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _height(n: Column, fanout: int) -> Column:
    """Levels above ``n`` nodes until one is left: the digits of n - 1."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, fanout))).otherwise(0)


def _hashed(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _ranked(docs: DataFrame, leaf: Column, claim: Column, key_col: str, group_col: str) -> DataFrame:
    """``(part, tree, at, key, leaf, claim)``: rows in order over range partitions, ``at`` counting each partition's."""
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))  # null comes first, then bytewise
    rows = docs.select(tree.alias("tree"), F.col(key_col).cast("long").alias("key"), leaf.alias("leaf"), claim.cast("string").alias("claim"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))  # written once: ranges are cut from a sample, which reads everything
    order = ["tree", "key", "leaf", "row"]
    placed = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return checkpointed(placed).select(F.shiftright("place", 33).alias("part"), "tree", F.col("place").bitwiseAND((1 << 33) - 1).alias("at"), "key", "leaf", "claim")


def _trees(counts: DataFrame, size: int) -> DataFrame:
    """``(tree, number, n, first, behind)``: each group's place in order, its leaves and the range of its blocks. There is a
    row for each group, so the order is one task's work."""
    trees = counts.groupBy("tree").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / size))
    order = Window.orderBy("tree")
    behind = F.sum("blocks").over(order)
    return trees.select("tree", (F.row_number().over(order) - 1).alias("number"), "n", (behind - F.col("blocks")).alias("first"), behind.alias("behind"))


def _blocks(ranked: DataFrame, fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """The blocks ``(block, number, first, behind, rows, levels)`` with their own levels of the tree, and the groups.

    ``levels[0]`` are the leaves of the block; its last level is one node. A group of one block ends at its root, all
    others have every level of a full block, however few leaves are left for the last one."""
    size = fanout**block_levels
    counts = ranked.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("at").alias("from"))  # partitions + groups
    trees = checkpointed(_trees(counts, size))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("shift", before - F.col("from")).drop("n", "from").join(trees, "tree")
    rows = ranked.join(offsets, ["part", "tree"]).withColumn("position", F.col("at") + F.col("shift"))
    block = F.col("first") + F.call_function("div", F.col("position"), F.lit(size))
    grouped = rows.groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("position") % size).alias("at"), "key", "leaf", "claim"))).alias("rows"),
        *(F.first(c).alias(c) for c in ("number", "first", "behind", "n")),
    )
    up = F.when(F.col("behind") - F.col("first") > 1, block_levels).otherwise(_height(F.col("n"), fanout))
    steps = F.when(up > 0, F.sequence(F.lit(1), up)).otherwise(F.array().cast("array<int>"))

    def grown(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.call_function("div", F.size(last) - 1, F.lit(fanout)).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda i: _hashed(F.slice(last, i * fanout + 1, F.lit(fanout))))))

    levels = F.aggregate(steps, F.array(F.transform("rows", lambda x: x["leaf"])), grown)
    return checkpointed(grouped.select("block", "number", "first", "behind", "rows", levels.alias("levels"))), trees


def _exchanged(state: DataFrame, children: Column, own: Column, active: Column) -> DataFrame:
    """One round. ``children`` are the ranges of blocks ``(lo, hi)`` under the sibling nodes, ``own`` is the block's among
    them. Member q of a node sends the node's digest to the members q, q + size of its own node, ... of each sibling, so
    every block hears from each sibling once, also where nodes have different numbers of blocks; to itself it sends its
    state. ``state(block, root, sides, ...)`` comes back one level up."""
    rest = [c for c in state.columns if c not in ("block", "root")]
    mine = F.get(children, own)
    told = F.transform(children, lambda c: F.when(c["lo"] + F.col("block") - mine["lo"] < c["hi"], F.sequence(c["lo"] + F.col("block") - mine["lo"], c["hi"] - 1, mine["hi"] - mine["lo"])).otherwise(F.array().cast("array<long>")))
    to = F.when(active, F.flatten(told)).otherwise(F.array("block"))
    sent = state.select("*", own.alias("child"), active.alias("active")).withColumn("to", F.explode(to))
    kept = F.when(F.col("to") == F.col("block"), F.struct(*rest, "child", "active"))
    heard = sent.select("to", F.struct("child", "root").alias("node"), kept.alias("kept")).groupBy(F.col("to").alias("block")).agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.first("kept", ignorenulls=True).alias("kept"))
    roots = lambda keep: F.transform(F.filter("nodes", keep), lambda x: x["root"])
    child = F.col("kept.child")
    side = F.struct(roots(lambda x: x["child"] < child).alias("before"), roots(lambda x: x["child"] > child).alias("after"))
    parent = F.when(F.col("kept.active"), _hashed(F.transform("nodes", lambda x: x["root"]))).otherwise(F.get("nodes", F.lit(0))["root"])
    sides = F.when(F.col("kept.active"), F.concat("kept.sides", F.array(side))).otherwise(F.col("kept.sides"))
    return heard.select("block", parent.alias("root"), *(sides.alias(c) if c == "sides" else F.col(f"kept.{c}").alias(c) for c in rest))


def _butterfly(blocks: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """``(block, subroot, root, sides)``: the digests of each block's group and of everything, and the siblings of all its
    ancestors from the block's root upwards. Rounds are as many as levels above the blocks: first those within groups,
    whose ranges follow from the block's number, then those over groups."""
    most, groups = trees.agg(F.max(F.col("behind") - F.col("first")), F.count("*")).first()
    state = blocks.select("block", F.get(F.element_at("levels", -1), F.lit(0)).alias("root"), "number", "first", "behind", F.array().cast(_SIDES).alias("sides"))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    size = 1
    while size < (most or 0):
        inside = F.col("block") - F.col("first")
        low = F.col("first") + div(inside, size * fanout) * (size * fanout)
        high = F.least(low + size * fanout, F.col("behind"))
        children = F.transform(F.sequence(low, high - 1, F.lit(size).cast("long")), lambda c: F.struct(c.alias("lo"), F.least(c + size, high).alias("hi")))
        state = _exchanged(state, children, (div(inside, size) % fanout).cast("int"), F.col("behind") - F.col("first") > size)
        size *= fanout
    state = state.withColumn("subroot", F.col("root"))
    size = 1
    while size < groups:
        nodes = trees.groupBy(div(F.col("number"), size).alias("node")).agg(F.min("first").alias("lo"), F.max("behind").alias("hi"))
        runs = nodes.groupBy(div(F.col("node"), fanout).alias("run")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("children"))
        runs = F.broadcast(runs) if groups <= MANY_GROUPS else runs
        joined = state.withColumn("run", div(F.col("number"), size * fanout)).join(runs, "run").drop("run")
        state = _exchanged(joined, F.col("children"), (div(F.col("number"), size) % fanout).cast("int"), F.lit(True)).drop("children")
        size *= fanout
    return state.select("block", "subroot", "root", "sides")


def build_manifest(docs: DataFrame, fields: Iterable[str] = FIELDS, key_col: str = "doc_id", group_col: str = "lang", claim: Column | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``(key, leaf, subroot, root, proof, claim)`` for every row of ``docs``.

    ``leaf`` digests ``fields``; ``proof`` lists, level by level up to the root, the siblings before and after
    the row's ancestor (both empty where it is alone); ``claim`` (any text, here a digest to verify) is passed through.
    Leaves stand by key, nulls first; rows with one key stand by their digests, so repeated rows are leaves side by side.
    Null groups are a group of their own, before all others. Extra columns are ignored. An empty table has an empty
    manifest.

    Texts are read once. Leaves are written three times to the checkpoint folder (digests, in order, in blocks). A task
    holds one partition of leaves to sort, and some blocks of ``fanout ** block_levels`` leaves (512); a round moves up to ``fanout`` digests a block.
    """
    if not 2 <= fanout <= 36:
        raise ValueError("fanout must be 2 to 36")
    leaf = leaf_digest(F.col(c) for c in fields)
    ranked = _ranked(docs, leaf, F.lit(None) if claim is None else claim, key_col, group_col)
    blocks, trees = _blocks(ranked, fanout, block_levels)
    whole = blocks.select("block", "rows", "levels").join(_butterfly(blocks, trees, fanout), "block")

    def sides(i: Column) -> Column:
        def of(level: Column, l: Column) -> Column:  # noqa: E741
            at = F.floor(i / F.pow(F.lit(float(fanout)), l)).cast("int")
            start = at - at % fanout
            return F.struct(F.slice(level, start + 1, at - start).alias("before"), F.slice(level, at + 2, start + fanout - at - 1).alias("after"))

        return F.concat(F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), of), F.col("sides"))

    rows = F.transform("rows", lambda x: F.struct(x["key"].alias("key"), x["leaf"].alias("leaf"), sides(x["at"]).alias("proof"), x["claim"].alias("claim")))
    return whole.select(F.explode(rows).alias("x"), "subroot", "root").select("x.key", "x.leaf", "subroot", "root", "x.proof", "x.claim")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), ""), 256)
