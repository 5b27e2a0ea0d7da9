"""Near-duplicate documents by MinHash with tensored bands and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.common import checkpoint, components, lists, mix, shingle_sets, slices, with_facts

WIDTH = 5
ROWS = 3
MISS = 2e-4
#: Members of a leader that meet in one task for verification, about.
TOGETHER = 5_000
#: Documents, about, on which table keys are counted to tell hot ones, and the share of them (one in so many) that makes a key hot.
PROBED, HOT_SHARE = 20_000, 1_000
#: A key of fewer probed documents is not hot.
HOT_LEAST = 8


def collection_size(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands a collection needs so that a pair at the threshold agrees in one of them but for `miss`."""
    return max(2, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(sets: list[np.ndarray], size: int, rows: int) -> np.ndarray:
    """(texts, 2 * size) keys of the bands of both collections; a set must not be empty."""
    mul, add = _permutations(2 * size * rows)
    least = np.empty((len(sets), 2 * size * rows), dtype=np.uint64)
    for i, s in enumerate(sets):
        low = None
        for at in range(0, len(s), 4096):
            part = (s[at : at + 4096, None] * mul + add).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        least[i] = low
    grouped = mix(least).reshape(len(sets), 2 * size, rows)
    keys = np.zeros((len(sets), 2 * size), dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r] + np.uint64(r + 1))
    return keys


def table_keys(bands: np.ndarray, size: int) -> np.ndarray:
    """(texts, size * size) table keys: one band of the first collection with one of the second."""
    left, right = bands[:, :size, None], bands[:, None, size:]
    number = np.arange(size * size, dtype=np.uint64).reshape(1, size, size)
    return mix(mix(left + number) ^ (right * np.uint64(0xD6E8FEB86659FD93))).reshape(len(bands), size * size)


def shingled(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, digest): the size of each document's shingle set and a 128-bit digest of it (empty set: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from qualispark.llm.common import text_buffer

        for part in slices(batches):
            sets = shingle_sets(*text_buffer(part.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "n_shingles", "digest"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n_shingles long, digest binary"
    )


def _tables(docs: DataFrame, doc_id: str, text: str, width: int, size: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest, bands) of all documents in one pass; bands is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from qualispark.llm.common import text_buffer

        for part in slices(batches):
            sets = shingle_sets(*text_buffer(part.column("text")), width)
            full = [s for s in sets if len(s)]
            bands = band_keys(full, size, rows).view(np.int64) if full else np.empty((0, 2 * size), np.int64)
            rest = iter(bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rest).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n_shingles long, digest binary, bands binary"
    )


def _expanded(signed: DataFrame, size: int, hot: np.ndarray | None = None, *, only: bool = False) -> DataFrame:
    """(key, id): a row per document and table; without the keys of `hot`, or (`only`) of no other key."""
    sent = None if hot is None else signed.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bands = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype=np.uint64).reshape(-1, 2 * size)
                keys = table_keys(bands, size).view(np.int64).ravel()
                ids = np.repeat(part.column("id").to_numpy(), size * size)
                if sent is not None and len(sent.value):
                    found = sent.value[np.minimum(np.searchsorted(sent.value, keys), len(sent.value) - 1)] == keys
                    keys, ids = keys[found == only], ids[found == only]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])

    return signed.select("id", "bands").mapInArrow(run, "key long, id long")


def _hot_keys(reps: DataFrame, size: int, total: int, probed: int = PROBED) -> np.ndarray:
    """Table keys that over one in HOT_SHARE documents have, told by about `probed` documents of small hash.

    At most size * size * HOT_SHARE of them, give or take what the probe is larger than asked for. They only choose
    the way that a key's rows take; the pairs are the same by either.
    """
    cut = int(min(1.0, probed / max(1, total)) * (1 << 62))
    some = reps.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 62)) < F.lit(cut))
    least = max(HOT_LEAST, min(total, probed) // HOT_SHARE)
    return _expanded(some, size).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).select("key").toArrow().column("key").to_numpy()


def _led(reps: DataFrame, size: int, total: int) -> DataFrame:
    """(x, y): the members x of each table bucket with its smallest member y, once.

    Rows of a key meet by one shuffle. Keys that very many documents have take another way: their
    smallest member is found by partial minima, and is sent to the rows, which stay where they are.
    """
    hot = _hot_keys(reps, size, total)
    bounds = F.min("id").alias("y"), F.max("id").alias("_top")
    keys = _expanded(reps, size, hot).repartition("key")
    stars = keys.join(keys.groupBy("key").agg(*bounds).where("y <> _top").select("key", "y"), "key").select(F.col("id").alias("x"), "y")
    if len(hot):
        spread = _expanded(reps, size, hot, only=True)
        least = spread.groupBy("key").agg(*bounds).where("y <> _top").select("key", "y")
        stars = stars.unionByName(spread.join(F.broadcast(least), "key").select(F.col("id").alias("x"), "y").distinct())
    return stars.where("x <> y").distinct()


def _sets(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, shingles): the whole shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from qualispark.llm.common import text_buffer

        for part in slices(batches):
            sets = shingle_sets(*text_buffer(part.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), lists([s.view(np.int64) for s in sets], pa.int64())], ["id", "shingles"]
            )

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, shingles array<long>"
    )


def _verified(pairs: DataFrame, sets: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(x, y, inter, n_x, n_y) for pairs (x, y), from the full sets.

    A document y of very many pairs (fewer than a thousand can have over a
    thousandth of all) is dealt out in chunks, each with a copy of its set.
    """
    limit = max(together, pairs.count() // 1000)
    hot = checkpoint(pairs.groupBy("y").agg(F.count("*").alias("m")).where(F.col("m") > limit).select("y", F.ceil(F.col("m") / together).cast("int").alias("chunks")))
    chunks = F.coalesce("chunks", F.lit(1))
    right = sets.select(F.col("id").alias("y"), F.col("shingles").alias("s_y")).join(F.broadcast(hot), "y", "left")
    return (
        pairs.join(F.broadcast(hot), "y", "left")
        .select("x", "y", F.pmod(F.xxhash64("x"), chunks).cast("int").alias("chunk"))
        .join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("s_x")), "x")
        .join(right.select("y", "s_y", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")), ["y", "chunk"])
        .select(
            "x",
            "y",
            F.size(F.array_intersect("s_x", "s_y")).cast("long").alias("inter"),
            F.size("s_x").cast("long").alias("n_x"),
            F.size("s_y").cast("long").alias("n_y"),
        )
    )


def _mixed(first: DataFrame, joined: DataFrame) -> DataFrame:
    """(m, c, n): members of leaders whose members are in several components, with their component and set size."""
    around = first.select("y", F.col("x").alias("m"), F.col("n_x").alias("n")).unionByName(
        first.select("y", F.col("y").alias("m"), F.col("n_y").alias("n")).distinct()
    )
    around = around.join(joined.select(F.col("id").alias("m"), F.col("component_id").alias("c")), "m", "left").withColumn(
        "c", F.coalesce("c", "m")
    )
    mixed = around.groupBy("y").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("_members")).where("_lo <> _hi").select("y", "_members")
    return with_facts(around, mixed, ["y"], "_members", first.count() // HOT_SHARE).select("m", "c", "n").distinct()


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members of different components that share one of their rarest shingles.

    With all sets in one order, rarest shingle first, two sets at the threshold
    share a shingle among the first n - ceil(n * percent / 100) + 1 of either; and
    after the first one that they share, enough must be left of both.
    Passages that many documents share come last in that order and make no pairs.
    """
    rows = members.join(sets.withColumnRenamed("id", "m"), "m").select("m", "c", "n", F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("_lo"), F.max("c").alias("_hi"))
    ranked = (
        rows.join(common, "s")
        .withColumn("place", F.row_number().over(Window.partitionBy("m").orderBy("df", "s")))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .where("_lo <> _hi")
        .select("s", "m", "c", "n", "place")
    )
    # Sets of alike sizes are in one band or in neighbouring ones.
    ranked = checkpoint(ranked.withColumn("band", F.floor(F.log("n") / (1.001 * math.log(100 / percent))) if percent < 100 else F.lit(0)))
    near = ranked.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    return (
        ranked.alias("p")
        .join(
            near.alias("q"),
            F.expr("p.s = q.s and p.band = q.band and p.m < q.m and p.c <> q.c")
            & F.expr(f"least(p.n, q.n) * 100 >= greatest(p.n, q.n) * {percent}")
            & F.expr(f"(1 + least(p.n - p.place, q.n - q.place)) * {100 + percent} >= (p.n + q.n) * {percent}"),
        )
        .selectExpr("p.m as y", "q.m as x")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 80,
    width: int = WIDTH,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents whose shingle sets are `percent` % alike or more.

    Documents with one and the same set are a class, of which one stands in for
    all. Two collections of m bands of `rows` minhashes each make the keys of
    m * m tables: one band from either, so 2 m bands are computed, not m * m.
    A pair at the threshold is missed by a collection with probability `miss` at
    most. In every table bucket each member is verified, on the full sets,
    against the smallest member only, so large groups of copies cost a row per
    copy. Where this leaves the members of a leader in different components,
    such members are joined on their rarest shingles (an exact prefix filter),
    and pairs across components are verified too.

    Null, empty and blank texts have no shingles: linked with nothing,
    component_id is their own id, kept is true. Texts under `width` words are one
    shingle. Ids must be unique integers; rows with a null id are left out. Other
    columns are not read.
    """
    size = collection_size(percent / 100, rows, miss)
    given = docs.where(F.col(doc_id).isNotNull())
    signed = checkpoint(_tables(given, doc_id, text, width, size, rows))
    classes = checkpoint(
        signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    reps = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    star = _led(reps, size, classes.count())
    sizes = signed.select("id", "n_shingles")
    star = (
        star.join(sizes.select(F.col("id").alias("x"), F.col("n_shingles").alias("n_x")), "x")
        .join(sizes.select(F.col("id").alias("y"), F.col("n_shingles").alias("n_y")), "y")
        .select("x", "y", "n_x", "n_y", (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent).alias("fits"))
    )
    star = checkpoint(star)
    wanted = star.select(F.col("x").alias("id")).unionByName(star.select(F.col("y").alias("id"))).distinct()
    chosen = given.select(F.col(doc_id).cast("long").alias(doc_id), text).join(wanted.withColumnRenamed("id", doc_id), doc_id, "left_semi")
    sets = checkpoint(_sets(chosen, doc_id, text, width))
    linked = F.col("inter") * 100 >= (F.col("n_x") + F.col("n_y") - F.col("inter")) * percent
    # Pairs whose sizes differ too much cannot be linked; such members of a leader may still be linked with one another.
    edges = checkpoint(_verified(star.where("fits").select("x", "y"), sets).where(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = components(edges)

    left_open = checkpoint(_mixed(star, joined))
    pairs = _prefix_pairs(left_open, sets, percent)
    more = checkpoint(_verified(pairs, sets).where(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    if not more.isEmpty():
        joined = components(edges.unionByName(more))
    return (
        signed.join(classes.select("digest", "rep"), "digest", "left")
        .join(joined.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component_id", "rep", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
