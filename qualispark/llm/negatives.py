"""Hard-negative mining by exact integer inner products, several candidates to a multiplication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.common import checkpoint

#: Bytes of anchors that meet all candidates in one scan, and products of a tile.
ANCHOR_BYTES = 16_000_000
TILE = 2_000_000
#: Bits of a wide integer: floats hold these exactly, and Python's integers as many as are wanted.
NARROW, WIDE = 53, 512
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole_components(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of doubles: as int64 where all fit 31 bits, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not values.size or np.abs(scaled).max() < 1 << 31:
        return scaled.astype(np.int64)
    exact = [math.floor(s) if math.isfinite(s) else int(x) * scale for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(values.shape)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) as int64; those beyond 64 bits count as its ends.

    All components are biased to start at zero. So many candidates as fit share
    one wide integer, each with a field of its own that holds any biased product
    without a carry; one multiplication for each component of an anchor serves
    all of them. Fields are cut out of the sums, and what the bias has added is
    taken off. Where the integers stay below 2 ** 53 the products of a tile are
    one product of matrices of doubles, which is exact; others are Python's.
    """
    (m, width), n = anchors.shape, len(candidates)
    if not m or not n or not width:
        return np.zeros((m, n), dtype=np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    a, c = anchors - low_a, candidates - low_c
    field = (max(int(x) for x in a.sum(axis=1)) * int(c.max())).bit_length() or 1
    narrow = field <= NARROW and a.dtype != object and c.dtype != object
    each = (NARROW if narrow else max(WIDE, field)) // field
    groups = -(-n // each)
    padded = np.zeros((groups * each, width), dtype=c.dtype if narrow else object)
    padded[:n] = c
    packed = padded[:groups]
    for k in range(1, each):
        packed = packed + (padded[k * groups : (k + 1) * groups] << (field * k))
    if narrow:
        sums = (a.astype(np.float64) @ packed.astype(np.float64).T).astype(np.int64)
    else:
        sums = np.dot(a.astype(object), packed.T)
    mask = (1 << field) - 1
    found = np.concatenate([(sums >> (field * k)) & mask for k in range(each)], axis=1)[:, :n]
    kind = np.int64 if narrow else object
    exact = found + low_c * a.sum(axis=1).astype(kind)[:, None] + low_a * c.sum(axis=1).astype(kind)[None, :] + width * low_a * low_c
    return exact if narrow else np.clip(exact, LOW, HIGH).astype(np.int64)


def _first(owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each owner's rows the places of the first `most`: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, owners))
    sorted_owners = owners[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_owners[1:] != sorted_owners[:-1]])) if len(order) else np.empty(0, np.int64)
    within = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[within < most]


class Best:
    """The first rows of each owner so far."""

    def __init__(self, owners: int, most: int) -> None:
        self.most = most
        self.rows = [np.empty(0, dtype=np.int64) for _ in range(3)]
        self.floor = np.full(owners, LOW, dtype=np.int64)

    def add(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(self.rows, (owners, scores, ids), strict=True)]
        keep = _first(*merged, self.most)
        self.rows = [x[keep] for x in merged]
        # An owner with `most` rows takes no more below the last of them.
        owners, counts = np.unique(self.rows[0], return_counts=True)
        last = np.cumsum(counts) - 1
        full = counts == self.most
        self.floor[owners[full]] = self.rows[1][last[full]]


def _tiles(batch: pa.RecordBatch, anchors: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, labels, components) of the candidates that have the length of an anchor, a few at a time."""
    vectors = batch.column(2)
    sizes = np.asarray(vectors.value_lengths())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for width in np.unique(sizes).tolist():
        if width not in anchors:
            continue
        rows = np.flatnonzero(sizes == width)
        rows = rows[np.argsort(labels[rows], kind="stable")]
        step = max(16, TILE // len(anchors[width]))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            values = flat[starts[part][:, None] + np.arange(width)] if width else np.empty((len(part), 0))
            yield width, ids[part], labels[part], whole_components(values)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of other labels that score almost as high as a positive.

    A score is the integer inner product of floor(256 * x) of an anchor's and a
    row's components, exact; beyond 64 bits it counts as the last number that
    fits. Higher scores come first, ties by smaller id. An anchor's positives
    are its first `positives` rows of the same label; rows of the anchor's own
    id are no positives, and none if their label differs. For each, `negatives`
    rows of other labels follow that score at least `percent` % of the positive
    and at most as much. Only vectors of the anchor's length are compared. Rows
    with a null id, a null label, a null vector or components that are null or not finite
    take no part; anchors that repeat give their rows again. Empty tables give
    no rows, and other columns are left out.

    `anchors` is the query set, in the same columns; it meets `vectors` in
    blocks of bounded bytes, each of which is sent to the tasks of two scans,
    one for positives and one for the negatives of these. A task keeps the first
    few rows of each anchor, so what is shuffled grows with anchors and tasks,
    not with pairs.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        own = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(vector))
        return own.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    rows = clean(vectors)
    # Anchors are numbered and cut into blocks by their bytes; no block is larger than a longest vector and the bound.
    queries = checkpoint(clean(anchors).withColumn("n", F.monotonically_increasing_id()))
    sizes = queries.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("v") * 8 + 64).alias("bytes"))
    earlier = F.coalesce(F.sum("bytes").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("p", earlier.alias("shift"))
    own = F.sum(F.size("v") * 8 + 64).over(Window.partitionBy("p").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    blocks = checkpoint(queries.withColumn("p", F.spark_partition_id()).withColumn("upto", own).join(shift, "p").select("id", "label", "v", F.floor((F.col("upto") + F.col("shift")) / ANCHOR_BYTES).alias("block")))
    many = blocks.agg(F.max("block")).first()[0]
    if many is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = [_of_block(rows, blocks.where(F.col("block") == b), positives, negatives, percent) for b in range(many + 1)]
    while len(out) > 1:
        out = [out[i].unionByName(out[i + 1]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
    return out[0]


def _of_block(rows: DataFrame, block: DataFrame, positives: int, negatives: int, percent: int) -> DataFrame:
    """`hard_negatives` for one block of anchors."""
    spark = rows.sparkSession
    held = block.select("id", "label", "v").toArrow()  # bounded by ANCHOR_BYTES
    ids, labels = (held.column(c).to_numpy() for c in ("id", "label"))
    listed = held.column("v").to_pylist()
    lengths = np.array([len(v) for v in listed])
    numbers = {w: np.flatnonzero(lengths == w) for w in np.unique(lengths).tolist()}
    parts = {w: whole_components(np.array([listed[i] for i in own], dtype=np.float64).reshape(len(own), w)) for w, own in numbers.items()}
    sent = spark.sparkContext.broadcast((ids, labels, numbers, parts))

    def of_same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, own, vectors = sent.value
        best = Best(len(anchor_ids), positives)
        for batch in batches:
            for width, row_ids, row_labels, components in _tiles(batch, vectors):
                for name in np.unique(row_labels).tolist():
                    mine = np.flatnonzero(anchor_labels[own[width]] == name)
                    theirs = np.flatnonzero(row_labels == name)
                    if len(mine):
                        scores = products(vectors[width][mine], components[theirs])
                        owners = own[width][mine]
                        i, j = np.nonzero((scores >= best.floor[owners][:, None]) & (anchor_ids[owners][:, None] != row_ids[theirs][None, :]))
                        best.add(owners[i], scores[i, j], row_ids[theirs][j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows], ["anchor", "score", "id"])

    schema = "anchor long, score long, id long"
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    found = rows.mapInArrow(of_same_label, schema).withColumn("place", place("anchor")).where(F.col("place") <= positives)
    chosen = checkpoint(found)
    table = chosen.toArrow()  # at most `positives` rows for each anchor of the block
    owner, score, positive, at = (table.column(c).to_numpy() for c in ("anchor", "score", "id", "place"))
    order = np.lexsort((at, owner))
    owner, score, positive = owner[order], score[order], positive[order]
    least = np.array([min(max(-(-percent * s // 100), LOW), HIGH) for s in score.tolist()], dtype=np.int64)
    goals = spark.sparkContext.broadcast((owner, score, least))

    def of_other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, anchor_labels, own, vectors = sent.value
        owners, tops, lows = goals.value
        best = Best(len(owners), negatives)
        first = np.searchsorted(owners, np.arange(len(anchor_labels)))
        count = np.searchsorted(owners, np.arange(len(anchor_labels)), side="right") - first
        for batch in batches:
            for width, row_ids, row_labels, components in _tiles(batch, vectors):
                scores = products(vectors[width], components)
                other = anchor_labels[own[width]][:, None] != row_labels[None, :]
                for k in range(positives):
                    asked = np.flatnonzero(count[own[width]] > k)
                    if len(asked):
                        goal = first[own[width][asked]] + k
                        band = scores[asked]
                        i, j = np.nonzero(other[asked] & (band <= tops[goal][:, None]) & (band >= np.maximum(lows[goal], best.floor[goal])[:, None]))
                        if len(i):
                            best.add(goal[i], band[i, j], row_ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows], ["goal", "score", "id"])

    ranked = rows.mapInArrow(of_other_labels, "goal long, score long, id long").withColumn("rank", place("goal")).where(F.col("rank") <= negatives)
    goal_rows = spark.createDataFrame(pa.table({"goal": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score}))
    return ranked.join(goal_rows, "goal").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
