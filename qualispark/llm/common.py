"""Helpers shared by the operators: checkpoints, vectorised tokens, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that separate words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of a word that the table of random values covers; for each further run of so many it is scaled by a random odd number.
_COVERED = 64
_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(0, 1 << 64, size=(_COVERED, 256), dtype=np.uint64)
_TABLE[:, 65:91] = _TABLE[:, 97:123]  # A-Z have the values of a-z
_TABLE = _TABLE.ravel()

_powers: dict[str, np.ndarray] = {}


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; without one, a folder of our own, on a local master only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    if _powers.get("up", np.empty(0)).size < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _P), ("down", _PINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) one after the other, and where each starts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column, b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about `most` bytes of text (or list entries), or one longer text alone."""
    for batch in batches:
        values = batch.column(batch.schema.names.index(column))
        measured = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        lengths = np.asarray(pc.fill_null(measured, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        ends = np.cumsum(lengths)
        while start < len(lengths):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text buffer, and the index of each text's first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased.

    The hash adds up a random value for each pair of place and byte, so no form
    of a word (such as a repeated or mirrored pattern) makes a collision likelier
    than 2 ** -64.
    """
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(first[-1] + sizes[-1])) - np.repeat(first, sizes)
    letters = data[within + np.repeat(starts, sizes)]
    values = _TABLE[(within & (_COVERED - 1)) << 8 | letters]
    later = np.flatnonzero(within >= _COVERED)
    if len(later):
        values[later] *= mix((within[later] // _COVERED).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; fewer words: the whole run as one."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_P) + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = 0
            for x in hashes[a:b].tolist():
                h = (h * _P + x + 1) & MASK64
            out.append(mix(np.array([h ^ (b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    sizes = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, limit: int) -> DataFrame:
    """`rows` joined with the one row of `facts` for their keys, if any; `count` is the number of rows of a key.

    Facts on over `limit` rows are broadcast, of which there are fewer than the
    rows over `limit`; the rest is joined by a shuffle in which no key is hot.
    """
    hot = facts.where(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(facts.where(F.col(count) <= limit), keys))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component_id) for every vertex of `edges`: the smallest id that it reaches.

    Alternating large-star and small-star steps; each step is written to the
    checkpoint folder, so that plans stay short and a lost executor costs one
    step. Vertices with over a thousandth of all edges, of which there are at
    most two thousand, are joined by a broadcast, so the centre of a star is
    no task of its own. Nothing but counts and a checksum comes to the driver.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    own = checkpoint(own)
    n = own.count()
    seen = None
    for _ in range(rounds):
        both = own.select("u", "v").unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_edges")).withColumn("m", F.least("u", "m"))
        large = with_facts(both.where("v > u"), least, ["u"], "_edges", n // 1000).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = checkpoint(large.where("u <> v").distinct())
        least = low.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_edges"))
        small = with_facts(low, least, ["u"], "_edges", n // 1000).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        own = checkpoint(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = own.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.countDistinct("u")).first()
        n = now[0]
        # With one edge a vertex, all is settled when no root has an edge of its own.
        if tuple(now) == seen or now[0] == now[2] and own.select(F.col("v").alias("u")).distinct().join(own.select("u"), "u", "left_semi").isEmpty():
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return own.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        own.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
