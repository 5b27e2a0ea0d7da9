"""Merkle manifest of a dataset: leaves per group, subtree roots by butterfly exchange, and a proof for every row.

Rows are dealt into aligned blocks of `fanout ** levels` consecutive leaves of
a group, which hash up to their own root by themselves. Then blocks swap roots
round by round: in round r, the `fanout` blocks whose numbers differ in digit r
alone give one another the nodes that they stand under, and each hashes the
parent for itself. After the last round every block knows its whole upper proof
and the root, so nothing is sent down the tree again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.common import checkpoint

#: A side of a run: the hashes of its other nodes, left and right of the own one.
SIDE = "struct<before:string,after:string>"


def leaf_hash(*columns: Column | str) -> Column:
    """SHA-256 (lowercase hex) of the values one after the other: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parents(nodes: Column, fanout: int) -> Column:
    """The hashes of runs of `fanout` nodes; the last run may be shorter."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _side(nodes: Column, at: Column, fanout: int) -> Column:
    """What stands before and after the node at a place, in its run."""
    first = F.floor(at / fanout).cast("int") * fanout
    before = F.slice(nodes, first + 1, at - first)
    after = F.slice(nodes, at + 2, first + fanout - 1 - at)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def fold(node: Column, sides: Column) -> Column:
    """The root that a node and its proof lead to."""
    return F.aggregate(sides, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings_hash(sides: Column) -> Column:
    """SHA-256 of all hashes of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `place`, the number from 0 of a row in its group, and `n`, the size of the group.

    Rows are sorted by ranges, which cut a group however large it is, and are
    numbered within a range; ranges are added up by one small row for each range
    and group. They are written first, as ranges are drawn by lot.
    """
    ranged = checkpoint(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_group"), F.col("_range").alias("_part"), (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    joined = ranged.join(parts, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_group", "_part", "_shift")


def butterfly(blocks: DataFrame, group: str, fanout: int) -> DataFrame:
    """(group, block, top, sides) from (group, block, blocks, node): each block's way up to the root of its group.

    `blocks` is how many a group has, numbered from 0. Where the block to swap
    with would be past the end, one that stands under the same node is asked
    instead. A round is one join of a small row a block, and is written, so that
    plans stay short and a lost executor costs one round.
    """
    now = checkpoint(blocks.select(group, "block", "blocks", F.col("node").alias("top"), F.array().cast(f"array<{SIDE}>").alias("sides")))
    most = now.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        span = width * fanout
        own = now.withColumn("_first", F.floor(F.col("block") / span) * span).withColumn("_within", F.col("block") % width)
        # The nodes of the own run of this round, by the block that is asked for each.
        asked = F.filter(F.sequence(F.col("_first"), F.col("_first") + span - width, F.lit(width)), lambda s: s < F.col("blocks"))
        partners = own.where(F.col("blocks") > width).select(group, "block", F.posexplode(F.transform(asked, lambda s: s + F.col("_within") % F.least(F.lit(width), F.col("blocks") - s))).alias("_child", "_partner"))
        told = now.select(F.col(group).alias("_group"), F.col("block").alias("_told"), F.col("top").alias("_node"))
        swapped = partners.join(told, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_partner") == F.col("_told")))
        runs = swapped.groupBy(F.col(group).alias("_group"), F.col("block").alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_child", "_node"))), lambda x: x["_node"]).alias("_run"))
        met = own.join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")), "left")
        child = F.floor((F.col("block") - F.col("_first")) / width).cast("int")
        now = checkpoint(
            met.select(
                group, "block", "blocks",
                F.when(F.col("_run").isNull(), F.col("top")).otherwise(F.sha2(F.array_join("_run", ""), 256)).alias("top"),
                F.when(F.col("_run").isNull(), F.col("sides")).otherwise(F.concat("sides", F.array(_side(F.col("_run"), child, fanout)))).alias("sides"),
            )
        )
        width = span
    return now.select(group, "block", "top", "sides")


def merkle_manifest(leaves: DataFrame, *, group: str = "lang", key: str = "doc_id", leaf: str = "leaf", carry: tuple[str, ...] = (), fanout: int = 2, levels: int = 10) -> DataFrame:
    """(group, key, leaf, carry..., subroot, root, sides): every row's leaf with the roots above it and its proof from leaf to root.

    In a group, leaves ascend by key (null first), rows of one key by their
    leaf. Every `fanout` consecutive nodes become the hash of their run (the last
    run may hold fewer, even one) until one remains; a lone leaf is its group's
    root. The roots of groups, in the order of their names (null first, by
    UTF-8 bytes), are the leaves of one more such tree. Repeated rows are leaves
    of their own. No rows give no rows. Columns other than those named are left out.

    A task holds a block of `fanout ** levels` leaves.
    """
    each = fanout**levels
    rows = _placed(leaves.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(leaf).alias("_leaf"), F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(None).alias("_carry")), "_g", ["_k", "_leaf"])
    dealt = rows.groupBy("_g", F.floor(F.col("place") / each).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.col("_k").alias("k"), F.col("_leaf").alias("leaf"), F.col("_carry").alias("carry")))).alias("rows")
    )
    heights = [F.transform("rows", lambda r: r["leaf"])]
    dealt = checkpoint(dealt.withColumn("blocks", F.floor((F.col("n") - 1) / each) + 1).withColumn("h0", heights[0]))
    tall = dealt
    for i in range(levels):  # a group of one block stops at its root, others hash up to the block's height
        nodes = F.col(f"h{i}")
        ended = (F.col("blocks") == 1) & (F.size(nodes) == 1)
        tall = tall.withColumn(f"h{i + 1}", F.when(~ended, _parents(nodes, fanout)).otherwise(nodes))
    upper = butterfly(tall.select("_g", "block", "blocks", F.col(f"h{levels}")[0].alias("node")), "_g", fanout)
    # The roots of groups are few rows beside the leaves; they are numbered like these and each is a block of its own.
    roots = upper.where("block = 0").select("_g", F.col("top").alias("subroot")).withColumn("_all", F.lit(True))
    roots = checkpoint(_placed(roots, "_all", ["_g", "subroot"]))
    crown = butterfly(roots.select("_all", F.col("place").alias("block"), F.col("n").alias("blocks"), F.col("subroot").alias("node")), "_all", fanout)
    crown = roots.join(crown.select(F.col("block").alias("place"), F.col("top").alias("root"), F.col("sides").alias("_crown")), "place").select(F.col("_g").alias("_name"), "subroot", "root", "_crown")
    above = upper.join(crown, F.col("_g").eqNullSafe(F.col("_name"))).select(F.col("_g").alias("_group"), F.col("block").alias("_block"), "subroot", "root", F.concat("sides", "_crown").alias("_above"))
    whole = tall.join(above, F.col("_g").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
    at = lambda i: F.floor(F.col("_at") / fanout**i).cast("int")
    ended = lambda i: (F.col("blocks") == 1) & (F.size(f"h{i}") == 1)
    own = F.filter(F.array(*[F.when(~ended(i), _side(F.col(f"h{i}"), at(i), fanout)) for i in range(levels)]), lambda s: s.isNotNull())
    out = whole.select("*", F.posexplode("rows").alias("_at", "_row"))
    return out.select(F.col("_g").alias(group), F.col("_row.k").alias(key), F.col("_row.leaf").alias(leaf), *[F.col(f"_row.carry.{c}").alias(c) for c in carry], "subroot", "root", F.concat(own, "_above").alias("sides"))
