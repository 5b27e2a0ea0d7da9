"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualispark.llm.common import checkpoint, components, with_facts

#: Rows that the splits below a node are fitted on, about; all rows are routed through them.
FIT_ROWS = 8192
TREES = 8
#: A node with more rows is split further.
LEAF_ROWS = 512
MAX_SPILL = 0.3
#: Rows of a node that are routed together, and of a leaf that are compared together.
ROUTED = 20_000
BLOCK = 1024
#: A vector with more copies than this, and than one in HOT_SHARE of all rows, is not dealt to one task.
HOT_COPIES = 10_000
HOT_SHARE = 1000
#: Rounds of splitting; each divides nodes some hundred times over.
ROUNDS = 40


class Splits:
    """Splits below a node as arrays: seed and threshold of each; children below zero are leaves. Directions follow from the seeds."""

    def __init__(self, points: np.ndarray, leaf: float, margin: float, seed: int) -> None:
        self.seeds: list[int] = []
        self.thresholds: list[float] = []
        self.children: list[list[int]] = []
        self.leaves: list[bool] = []  # whether a leaf is as small as asked for
        self.margin = margin
        self._grow(points, leaf, np.random.default_rng(seed), 0)

    def _grow(self, points: np.ndarray, leaf: float, rng: np.random.Generator, depth: int) -> int:
        split = self._split(points, rng) if len(points) > leaf and depth < 40 else None
        if split is None:
            self.leaves.append(len(points) <= leaf or depth >= 40)
            return -len(self.leaves)
        seed, threshold, at = split
        node = len(self.children)
        self.seeds.append(seed)
        self.thresholds.append(threshold)
        self.children.append([0, 0])
        self.children[node] = [
            self._grow(points[at <= threshold + self.margin], leaf, rng, depth + 1),
            self._grow(points[at >= threshold - self.margin], leaf, rng, depth + 1),
        ]
        return node

    def _split(self, points: np.ndarray, rng: np.random.Generator):
        """Of a few random splits the one that spills least; none if all spill too much (a tight cluster)."""
        best = None
        for _ in range(6):
            seed = int(rng.integers(1 << 62))
            at = points @ direction(seed, points.shape[1])
            threshold = float(np.quantile(at, rng.uniform(0.3, 0.7)))
            spill = float(np.mean(np.abs(at - threshold) <= self.margin))
            if best is None or spill < best[0]:
                best = (spill, seed, threshold, at)
        return best[1:] if best and best[0] <= MAX_SPILL else None

    def leaves_of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a row near a split is in the leaves of both sides."""
        rows, found = [], []
        todo = [(0 if self.children else -1, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                found.append(np.full(len(at), -node - 1, dtype=np.int64))
                continue
            place = points[at] @ direction(self.seeds[node], points.shape[1])
            left, right = self.children[node]
            todo.append((left, at[place <= self.thresholds[node] + self.margin]))
            todo.append((right, at[place >= self.thresholds[node] - self.margin]))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64),) * 2


def direction(seed: int, size: int) -> np.ndarray:
    """A random unit vector."""
    out = np.random.default_rng(seed).normal(size=size)
    return out / np.linalg.norm(out)


def units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision; scaled by the largest component first, so that no square over- or underflows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _fitting(cosine: float, leaf_rows: int):
    """For a node: splits fitted on its sample. Pairs at the given cosine differ along a random direction by chord / sqrt(dim) on average; that is the spill."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        points = units(table.column("v"))
        node, count = table.column("node")[0].as_py(), table.column("count")[0].as_py()
        margin = np.sqrt(2 - 2 * cosine) / np.sqrt(points.shape[1]) / 2
        splits = Splits(points, max(24.0, leaf_rows * len(points) / count), float(margin), node & (1 << 62) - 1)
        parts = [pa.array([x], kind) for x, kind in ((node, pa.int64()), (splits.seeds, pa.list_(pa.int64())), (splits.thresholds, pa.list_(pa.float64())), ([c for two in splits.children for c in two], pa.list_(pa.int64())), (splits.leaves, pa.list_(pa.bool_())), (splits.margin, pa.float64()))]
        return pa.Table.from_arrays(parts, names=["node", "seeds", "thresholds", "children", "leaves", "margin"])

    return run


def _routing(table: pa.Table, fitted: pa.Table) -> pa.Table:
    """(id, node, settled) of a node's rows: the leaves of its splits that they are in. A leaf that could not be split is settled."""
    own = fitted.to_pylist()[0] if fitted.num_rows and table.num_rows else None
    if own is None:
        return pa.table({"id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "settled": pa.array([], pa.bool_())})
    splits = Splits.__new__(Splits)
    splits.seeds, splits.thresholds, splits.leaves, splits.margin = (own[k] for k in ("seeds", "thresholds", "leaves", "margin"))
    splits.children = [own["children"][k : k + 2] for k in range(0, len(own["children"]), 2)]
    rows, leaf = splits.leaves_of(units(table.column("v")))
    with np.errstate(over="ignore"):
        name = (np.int64(own["node"]) * np.int64(6364136223846793005) + leaf + 1) * np.int64(3935559000370003845)
    return pa.table({"id": table.column("id").to_numpy()[rows], "node": name ^ (name >> 29), "settled": ~np.array(splits.leaves, dtype=bool)[leaf]})


def _leaves(classes: DataFrame, cosine: float, trees: int, fit_rows: int, leaf_rows: int, routed: int) -> DataFrame:
    """(id, node): the leaves of every vector. Nodes of more than `leaf_rows` rows are split round by round."""
    group = F.xxhash64("label", F.size("v"))
    at = classes.select("id", group.alias("node"))
    sizes = at.groupBy("node").agg(F.count("*").alias("count"))
    # A group that is one leaf needs one tree only.
    tree = F.explode(F.sequence(F.lit(0), F.when(F.col("count") > leaf_rows, trees - 1).otherwise(0)))
    at = checkpoint(at.join(sizes, "node").select("id", "node", tree.alias("tree")).select("id", F.xxhash64("node", "tree").alias("node"), F.lit(False).alias("settled")))
    done = None
    for turn in range(ROUNDS):
        sizes = at.where("not settled").groupBy("node").agg(F.count("*").alias("count")).where(F.col("count") > (leaf_rows if turn < ROUNDS - 1 else 1 << 62))
        sizes = checkpoint(sizes.withColumn("chunks", F.ceil(F.col("count") / routed).cast("int")))
        small = at.join(sizes.select("node"), "node", "left_anti").select("id", "node")
        done = small if done is None else done.unionByName(small)
        if sizes.isEmpty():
            return done
        members = at.join(sizes, "node").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        sample = members.where(F.pmod(F.xxhash64("id", "node"), F.col("count")) < fit_rows).join(classes.select("id", "v"), "id")
        fitted = sample.select("id", "v", "node", "count").groupBy("node").applyInArrow(
            _fitting(cosine, leaf_rows), "node long, seeds array<long>, thresholds array<double>, children array<long>, leaves array<boolean>, margin double"
        )
        copies = fitted.join(sizes.select("node", "chunks"), "node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        at = checkpoint(
            members.join(classes.select("id", "v"), "id")
            .select("id", "v", "node", "chunk")
            .groupBy("node", "chunk")
            .cogroup(copies.groupBy("node", "chunk"))
            .applyInArrow(_routing, "id long, node long, settled boolean")
        )
    raise AssertionError("the last round leaves nothing to split")


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one that it reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        chunk = table.column("chunk").to_numpy()
        leaf, one, two = (table.column(k)[0].as_py() for k in ("node", "one", "two"))
        v = units(table.column("v"))
        lists = table.column("nodes").combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        others = lists.flatten().to_numpy()
        row, others = row[others < leaf], others[others < leaf]
        names, at, often = np.unique(others, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often > 1)  # leaves before this one that two of its rows are in
        number = np.full(len(names), -1)
        number[shared] = np.arange(len(shared))
        member = np.zeros((len(ids), max(1, len(shared))), dtype=np.float32)
        held = number[at] >= 0
        member[row[held], number[at][held]] = 1
        links = np.zeros(len(ids), dtype=np.int64)
        left, right = [], []
        for start in range(0, len(ids), BLOCK):
            b = slice(start, start + BLOCK)
            near = v[b] @ v.T >= cosine
            near &= np.arange(len(ids))[b, None] != np.arange(len(ids))[None, :]
            if one != two:
                near &= chunk[b, None] != chunk[None, :]
            i, j = np.nonzero(near)
            left.append(i + start)
            right.append(j)
            near &= ~(member[b] @ member.T > 0)
            links[b] = near @ copies
        root = ids[_least(len(ids), np.concatenate(left), np.concatenate(right))]
        keep = (links > 0) | (root != ids)
        return pa.table({"id": ids[keep], "links": links[keep], "root": root[keep]})

    return run


def near_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.98,
    trees: int = TREES,
    fit_rows: int = FIT_ROWS,
    leaf_rows: int = LEAF_ROWS,
    routed: int = ROUTED,
    block: int = 4096,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors of one label with cosine similarity `cosine` or more.

    Equal vectors of a label are a class with one representative. Vectors of one
    label and length are compared among themselves. Each tree splits at random
    quantiles along random directions, and rows within the spill margin of a
    split go to both sides. Splits are fitted on about `fit_rows` rows of a node
    (those of smallest hash) until leaves hold `leaf_rows` rows; every row is
    routed through them, and nodes that still hold more are split again in the
    next round, so leaves, and with them the comparisons of a vector, do not grow
    with the table. A node that any split would cut through a tight cluster stays
    a leaf. Rounds shuffle ids, nodes and the vectors of crowded nodes only.

    Vectors are compared within leaves by blocked matrix products in double
    precision, scaled so that all finite magnitudes are alike. A pair is counted
    in the first leaf that its vectors share, so links are counted without
    listing pairs; leaves of over `block` rows are dealt out as pairs of chunks.
    Components come from a spanning forest of each leaf.

    Vectors that are null, empty, zero, or hold null or non-finite components, and
    those with a null label, link with nothing. Rows with a null id are left out;
    ids must be unique integers. Other columns are not read.
    """
    kind = vectors.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>")
    given = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    sound = (
        F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    good = given.where(F.coalesce(sound, F.lit(False)))
    classes = checkpoint(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    leaves = checkpoint(_leaves(classes, cosine, trees, fit_rows, leaf_rows, routed))
    key = ["node"]
    crowded = leaves.groupBy(*key).count().where(f"count > {block}").select(*key, F.ceil(F.col("count") / block).cast("int").alias("chunks"))
    lone = leaves.groupBy(*key).count().where("count = 1").select(*key)
    nodes = leaves.join(lone, key, "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    dealt = (
        classes.select("id", "copies", "v")
        .join(nodes, "id")
        .withColumn("node", F.explode("nodes"))
        .join(crowded, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("one", F.least("chunk", "other"))
        .withColumn("two", F.greatest("chunk", "other"))
    )
    found = checkpoint(
        dealt.select("id", "copies", "v", "nodes", "node", "one", "two", "chunk")
        .groupBy("node", "one", "two")
        .applyInArrow(_compare(cosine), "id long, links long, root long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = (
        classes.join(links, "id", "left")
        .join(joined, "id", "left")
        .select("label", "v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    limit = max(HOT_COPIES, (classes.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    told = with_facts(good, linked, ["label", "v"], "copies", limit).select("id", "n_links", "component_id")
    alone = given.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    return told.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component_id").cast("long").alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
    )
