"""Language-model scoring by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import mix, text_buffer, word_hashes, words

#: Bytes of text that are counted or scored together.
BLOCK_BYTES = 10_000_000
#: One training text in so many is held out for the mixture weights.
HELD_OUT_OF = 8
#: Steps per octave in which counts and ratios are binned for EM.
STEPS = 4
#: Bits of an n-gram's hash beyond those that number the bytes of the input: two n-grams of several words are taken as one with a chance of 2 ** -22 a piece.
SPARE_BITS = 22
END = np.uint64(0x1B873593CC9E2D51)
START = np.uint64(0x85EBCA6BC2B2AE35)
_NONE = -(1 << 15)
_CODEC = pa.Codec("zstd", compression_level=1)


def grams(data: np.ndarray, offsets: np.ndarray, order: int, width: int = 64) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, n from 1 to `order`, and the index of each text's first token.

    A text is its words and one end; before it stand start symbols. Hashes of
    single tokens have 64 bits, those of longer n-grams `width`.
    """
    texts = len(offsets) - 1
    hashes, counts, at = [np.empty(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    while at < texts:  # texts of about a megabyte at a time, so that what it takes beside the result is bounded
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000, side="right")) - 1)
        part = data[offsets[at] : offsets[stop]]
        starts, ends, first = words(part, offsets[at : stop + 1] - offsets[at])
        hashes.append(word_hashes(part, starts, ends))
        counts.append(np.diff(first))
        at = stop
    token_first = np.cumsum(np.concatenate(counts)) + np.arange(texts + 1)
    tokens = np.empty(int(token_first[-1]), dtype=np.uint64)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[token_first[1:] - 1] = False
    tokens[is_word] = np.concatenate(hashes)
    tokens[~is_word] = END
    out = [tokens]
    place = np.arange(len(tokens)) - np.repeat(token_first[:-1], np.diff(token_first))
    for n in range(2, order + 1):
        before = np.empty_like(tokens)
        k = n - 1
        before[k:] = tokens[:-k] if k else tokens
        before[:k] = START
        before[place < k] = START
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + mix(before + np.uint64(n))))
    return [out[0], *(h >> np.uint64(64 - width) for h in out[1:])], token_first


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; high planes that are zero are left out."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    body = _CODEC.compress(np.ascontiguousarray(raw[:, :width].T).tobytes(), asbytes=True)
    return bytes([width]) + len(values).to_bytes(6, "little") + body


def from_planes(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, dtype=np.uint64)
    width, size = packed[0], int.from_bytes(packed[1:7], "little")
    body = np.frombuffer(_CODEC.decompress(packed[7:], width * size, asbytes=True), dtype=np.uint8).reshape(width, size)
    raw = np.zeros((size, 8), dtype=np.uint8)
    raw[:, :width] = body.T
    return raw.view("<u8").ravel()


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def counting(order: int, bits: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """For a block: the distinct n-grams of its texts with their counts in training texts, cut by the leading bits of the hash."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by("doc_id")
        found, first = grams(*text_buffer(table.column("text")), order, width)
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        rows: list[tuple[int, int, int, bytes, bytes]] = []
        for n, hashes in enumerate(found, start=1):
            distinct, inverse = np.unique(hashes, return_inverse=True)
            counts = np.bincount(inverse[train], minlength=len(distinct)).astype(np.uint64)
            cuts = np.searchsorted(distinct >> np.uint64((64 if n == 1 else width) - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(distinct)])
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[bucket], cuts[bucket + 1]
                rows.append((block, n, bucket, planes(_gaps(distinct[a:b])), planes(counts[a:b])))
        names = ["block", "n", "bucket", "grams", "counts"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def totalling(held_blocks: int, which: str) -> Callable[[pa.Table], pa.Table]:
    """For a bucket of hashes: what all blocks together have counted, sent back to each block in the order of its n-grams.

    `which`: "kept" counts without the held-out training texts (only held-out
    blocks get an answer), "all" with them, "sizes" only the number of distinct
    training tokens and of training tokens, both ways.
    """

    def run(table: pa.Table) -> pa.Table:
        if which == "sizes" and table.column("n")[0].as_py() != 1:
            return pa.table([pa.array([], pa.int64())] * 4, names=["distinct_kept", "kept", "distinct_all", "total"])
        blocks = table.column("block").to_pylist()
        own = [np.cumsum(from_planes(g), dtype=np.uint64) for g in table.column("grams").to_pylist()]
        counts = [from_planes(c) for c in table.column("counts").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(own), return_inverse=True)
        weight = np.concatenate(counts).astype(np.float64)
        held = np.repeat(np.array(blocks) < held_blocks, [len(o) for o in own])
        kept = np.bincount(inverse, weights=np.where(held, 0, weight), minlength=len(distinct)).astype(np.uint64)
        every = np.bincount(inverse, weights=weight, minlength=len(distinct)).astype(np.uint64)
        n, bucket = table.column("n")[0].as_py(), table.column("bucket")[0].as_py()
        if which == "sizes":
            return pa.table({"distinct_kept": [int((kept > 0).sum())], "kept": [int(kept.sum())], "distinct_all": [int((every > 0).sum())], "total": [int(every.sum())]})
        chosen = kept if which == "kept" else every
        ends = np.cumsum([len(o) for o in own])
        rows = [(b, n, bucket, planes(chosen[inverse[e - len(o) : e]])) for b, o, e in zip(blocks, own, ends.tolist(), strict=True) if which == "all" or b < held_blocks]
        kinds = [("block", pa.int32()), ("n", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary())]
        return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[x for x, _ in kinds])

    return run


def _looked_up(table: pa.Table, answers: pa.Table, order: int, width: int) -> tuple[pa.Table, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The block's texts in order, the first token of each, and by n the counts of each token's n-gram and of its context."""
    table = table.sort_by("doc_id")
    found, first = grams(*text_buffer(table.column("text")), order, width)
    answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
    numbers = answers.column("n").to_numpy()
    counts, ends_count = [], 0
    for n, hashes in enumerate(found, start=1):
        distinct, inverse = np.unique(hashes, return_inverse=True)
        mine = answers.filter(pa.array(numbers == n)).column("counts").to_pylist()
        values = np.concatenate([from_planes(x) for x in mine]) if mine else np.empty(0, dtype=np.uint64)
        if len(values) != len(distinct):
            raise RuntimeError(f"{len(values)} counts for {len(distinct)} n-grams of a block")
        if n == 1:
            at = np.searchsorted(distinct, END)
            ends_count = int(values[at]) if at < len(distinct) and distinct[at] == END else 0
        counts.append(values[inverse].astype(np.float64))
    contexts = []
    opening = np.zeros(len(found[0]), dtype=bool)
    opening[first[:-1]] = True
    for n in range(2, order + 1):
        before = np.empty_like(counts[n - 2])
        before[1:] = counts[n - 2][:-1]
        before[opening] = ends_count  # all start symbols: as often as there are training texts
        contexts.append(before)
    return table, first, counts, contexts


def bucket_of(contexts: list[np.ndarray], size: int) -> np.ndarray:
    """Frequency bucket of each token: octaves of the count of its longest context that training has seen, and that context's length."""
    out = np.zeros(size, dtype=np.int64)
    for length, c in enumerate(contexts, start=1):
        seen = c > 0
        out[seen] = length * 64 + 1 + np.floor(np.log2(c[seen])).astype(np.int64)
    return out


def _bins(values: np.ndarray, steps: int) -> np.ndarray:
    out = np.full(len(values), _NONE, dtype=np.int64)
    out[values > 0] = np.rint(np.log2(values[values > 0]) * steps).astype(np.int64)
    return out


def observing(order: int, width: int, steps: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a held-out block: how often each combination of bucket, n-gram ratios and token count occurs in its training texts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", *[f"q{n}" for n in range(1, order + 1)], "tokens"]
        if table.num_rows == 0:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        table, first, counts, contexts = _looked_up(table, answers, order, width)
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        columns = [bucket_of(contexts, len(train)), _bins(counts[0], steps)]
        for c, before in zip(counts[1:], contexts, strict=True):
            columns.append(_bins(np.divide(c, before, out=np.zeros_like(c), where=before > 0), steps))
        rows = np.stack(columns, axis=1)[train]
        combined, tokens = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.empty(0, np.int64))
        return pa.table([*[pa.array(combined[:, i]) for i in range(order + 1)], pa.array(tokens)], names=names)

    return run


def maximise(order: int, steps: int, rounds: int = 60) -> Callable[[pa.Table], pa.Table]:
    """Expectation-maximisation of the mixture weights of one bucket on its binned held-out counts.

    The estimates of contexts longer than the bucket's have no weight.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, kept, distinct = (table.column(k)[0].as_py() for k in ("bucket", "kept", "distinct_kept"))
        tokens = table.column("tokens").to_numpy().astype(np.float64)
        q = [table.column(f"q{n}").to_numpy().astype(np.float64) for n in range(1, order + 1)]
        p = np.zeros((len(tokens), order + 1))
        p[:, 0] = 1.0 / (distinct + 1)
        p[:, 1] = np.where(q[0] > _NONE, np.exp2(q[0] / steps) / max(1, kept), 0)
        for n in range(2, order + 1):
            p[:, n] = np.where(q[n - 1] > _NONE, np.minimum(1.0, np.exp2(q[n - 1] / steps)), 0)
        weights = np.zeros(order + 1)
        weights[: bucket // 64 + 2] = 1.0 / (bucket // 64 + 2)
        for _ in range(rounds):
            share = p * weights
            share *= (tokens / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            weights = share.sum(axis=0)
            weights /= weights.sum()
        return pa.table({"bucket": [bucket], "tokens": [float(tokens.sum())], "weights": [weights.tolist()]})

    return run


def settling(order: int, strength: float = 5.0) -> Callable[[pa.Table], pa.Table]:
    """The weights of every bucket there can be: as learnt, with `strength` tokens' worth of those of all buckets together.

    A row for each bucket that held-out texts have (`order` * 64 at most) and one of sizes come in.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size = next(r for r in rows if r["total"] is not None)
        learnt = {r["bucket"]: (r["tokens"], np.array(r["weights"])) for r in rows if r["total"] is None}
        pooled = sum((t * w for t, w in learnt.values()), np.full(order + 1, 1.0))
        known, found = [], []
        for length in range(order):
            prior = pooled.copy()
            prior[length + 2 :] = 0  # no ratio of an unseen context
            prior = 0.999 * prior / prior.sum()
            prior[: length + 2] += 0.001 / (length + 2)
            for name in range(length * 64 + 1, length * 64 + 65) if length else [0]:
                tokens, weights = learnt.get(name, (0.0, prior))
                known.append(name)
                found += ((tokens * weights + strength * prior) / (tokens + strength)).tolist()
        return pa.table({"key": [0], "buckets": [known], "weights": [found], "total": [size["total"]], "distinct": [size["distinct_all"]]})

    return run


def scoring(order: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block: the score of each text by the mixture, and by the smoothed frequencies of its tokens alone."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [table.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if table.num_rows == 0:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        model = next(r for r in answers.select(["n", "buckets", "weights", "total", "distinct"]).filter(pa.array(answers.column("n").to_numpy() == 0)).to_pylist())
        table, first, counts, contexts = _looked_up(table, answers.filter(pa.array(answers.column("n").to_numpy() > 0)).select(["n", "bucket", "counts"]), order, width)
        total, distinct = model["total"], model["distinct"]
        weights = np.zeros((order * 64 + 1, order + 1))
        weights[model["buckets"]] = np.array(model["weights"]).reshape(-1, order + 1)
        mixed = weights[bucket_of(contexts, len(counts[0]))]
        p = mixed[:, 0] / (distinct + 1) + mixed[:, 1] * counts[0] / max(1, total)
        for n in range(2, order + 1):
            before = contexts[n - 2]
            p += mixed[:, n] * np.divide(counts[n - 1], before, out=np.zeros(len(p)), where=before > 0)
        base = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token
        return pa.table(
            [table.column("doc_id"), *(pa.array(x) for x in (np.diff(first).astype(np.int64), add((counts[0] > 0).astype(np.int64)), np.full(len(first) - 1, total, dtype=np.int64), add(base), add(np.log10(p))))],
            names=names,
        )

    return run


def score_texts(
    docs: DataFrame,
    train: str = "train",
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = 2,
    block_bytes: int = BLOCK_BYTES,
    held_out_of: int = HELD_OUT_OF,
    steps: int = STEPS,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of all texts.

    Texts with a true `train` column are learnt from. Their n-grams up to `order`
    are counted; one text in `held_out_of` (by hash) is held out, and by EM on the
    held-out counts the weights of the n-gram estimates (and of the uniform one)
    are learnt for each octave of the context's frequency. Scores then use the
    counts of all training texts.

    Texts are dealt into blocks by hash. A block sends its distinct n-grams with
    their counts, packed and cut by the leading bits of their hash; each range of
    hashes is added up on its own and answers every block in the block's own
    order. So a frequent n-gram is one number per block, and no task holds more
    than a block or a range. EM runs for each frequency bucket on its own, on
    held-out counts that are binned and added up before; only the weights of at
    most `order` * 64 buckets meet in one task. Single tokens are told apart by
    64-bit hashes, longer n-grams by as many bits as number the bytes of the
    input and SPARE_BITS more (64 at most).

    Null text is empty (its end token alone); a null `train` is false. Ids must be
    unique and not null; rows with a null id are left out. Without training
    texts the mixture is the uniform estimate. Other columns are not read.
    """
    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(train).cast("boolean"), F.lit(False)).alias("train"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held_blocks = max(1, math.ceil(size / held_out_of / block_bytes))
    other_blocks = max(1, math.ceil(size * (1 - 1 / held_out_of) / block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, size / block_bytes))))
    width = min(64, math.ceil(math.log2(size + 2)) + SPARE_BITS)
    kind = docs.schema[doc_id].dataType.simpleString()
    is_held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(held_out_of)) == 0
    block = F.when(is_held, F.pmod(F.xxhash64("doc_id"), F.lit(held_blocks))).otherwise(held_blocks + F.pmod(F.xxhash64("doc_id"), F.lit(other_blocks)))
    dealt = given.withColumn("block", block.cast("int"))
    counted = dealt.groupBy("block").applyInArrow(counting(order, bits, width), "block int, n int, bucket long, grams binary, counts binary")
    ranges = counted.groupBy("n", "bucket")
    answer = "block int, n int, bucket long, counts binary"
    ratios = [f"q{n}" for n in range(1, order + 1)]
    observed = (
        dealt.where(F.col("block") < held_blocks)
        .groupBy("block")
        .cogroup(ranges.applyInArrow(totalling(held_blocks, "kept"), answer).groupBy("block"))
        .applyInArrow(observing(order, width, steps), ", ".join(["bucket long", *[f"{q} long" for q in ratios], "tokens long"]))
        .groupBy("bucket", *ratios)
        .agg(F.sum("tokens").alias("tokens"))
    )
    sizes = (
        ranges.applyInArrow(totalling(held_blocks, "sizes"), "distinct_kept long, kept long, distinct_all long, total long")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct_kept", "kept", "distinct_all", "total")])
    )
    learnt = observed.crossJoin(F.broadcast(sizes)).groupBy("bucket").applyInArrow(maximise(order, steps), "bucket long, tokens double, weights array<double>")  # one row of sizes
    model = (
        learnt.unionByName(sizes.select("total", "distinct_all"), allowMissingColumns=True)
        .groupBy(F.lit(0).cast("long").alias("key"))
        .applyInArrow(settling(order), "key long, buckets array<long>, weights array<double>, total long, distinct long")
    )
    to_all = dealt.sparkSession.range(held_blocks + other_blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("key"))
    answers = ranges.applyInArrow(totalling(held_blocks, "all"), answer).unionByName(
        to_all.join(model, "key").select("block", F.lit(0).alias("n"), "buckets", "weights", "total", "distinct"), allowMissingColumns=True
    )
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(scoring(order, width), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
