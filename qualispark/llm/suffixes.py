"""Removal of long repeated byte strings: blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.anchors import digests, spans
from qualispark.llm.common import checkpoint, slices, text_buffer, with_facts

LENGTH = 200
GRAIN = 32
#: Period of the difference cover: ties of so many bytes go by sample ranks.
PERIOD = 64
#: Bytes that are indexed at a time, and a task's share of the text.
CHUNK = 2_000_000
BUCKET_BYTES = 12_000_000
#: Different spans of one anchor that are sorted together, at most; windows of anchors with more are counted one by one.
MOST_KINDS = 10_000
#: Anchors with more spans than this, and with more than one in HOT_SHARE of all spans, are hot: fewer than HOT_SHARE can be.
HOT_SPANS = 50_000
HOT_SHARE = 100_000
KEY = ["anchor", "whole", "rest"]


def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues such that any two places meet them at one distance, and that distance for each pair of residues."""
    step = math.isqrt(period - 1) + 1
    cover = sorted({*range(step), *((k * step + step - 1) % period for k in range(-(-period // step)))})
    inside = np.zeros(period, dtype=bool)
    inside[cover] = True
    shift = np.full((period, period), -1, dtype=np.int64)
    residue = np.arange(period)
    for d in range(period):
        both = inside[(residue + d) % period]
        shift = np.where((shift < 0) & both[:, None] & both[None, :], d, shift)
    if (shift < 0).any():
        raise ValueError("not a difference cover")
    return np.array(cover), shift


def words_at(data: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros stand after the end."""
    padded = np.concatenate([data, np.zeros(extra + 8, dtype=np.uint8)])
    n = len(data) + extra
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + n]
    return out


def refine(words: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort places by their next `depth` words: the order, and for each slot the first slot of its group of equals."""
    order = np.argsort(words[places], kind="stable")
    slot = np.arange(len(places))
    value = words[places[order]]
    new = np.ones(len(places), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    head = np.maximum.accumulate(np.where(new, slot, 0))
    for j in range(1, depth):
        same = head[1:] == head[:-1]
        tied = np.zeros(len(places), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value, group = words[places[order[at]] + 8 * j], head[at]
        by = np.lexsort((value, group))
        order[at] = order[at][by]
        value = value[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
    return order, head


def merge_ties(items: np.ndarray, head: np.ndarray, less) -> np.ndarray:
    """Merge sort of every group of slots at once, by a vectorised comparison."""
    items = items.copy()
    sizes = np.bincount(head, minlength=len(items))[head]
    slot = np.arange(len(items))
    width = 1
    while len(items) and width < sizes.max():
        at = slot[sizes > width]
        local = at - head[at]
        base = at - local % (2 * width)
        left = local % (2 * width) < width
        x = at[left]
        middle, stop = base[left] + width, np.minimum(base[left] + 2 * width, head[x] + sizes[x])
        lo, hi = np.minimum(middle, stop), stop.copy()
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) >> 1
            below = less(items[mid], items[x[todo]])
            lo[todo] = np.where(below, mid + 1, lo[todo])
            hi[todo] = np.where(below, hi[todo], mid)
        far = base[left] * np.int64(len(items) + 1)  # counts may only grow within a run, also where equal strings compare unevenly
        target = x + np.maximum.accumulate(far + lo - np.minimum(middle, stop)) - far
        taken = np.zeros(len(items), dtype=bool)
        taken[target] = True
        merged = items.copy()
        merged[target] = items[x]
        merged[at[~taken[at]]] = items[at[~left]]
        items = merged
        width *= 2
    return items


def repeated(data: np.ndarray, places: np.ndarray, length: int = LENGTH, period: int = PERIOD) -> np.ndarray:
    """Which of the places start a string of `length` bytes that another of the places starts too.

    The places are sorted by their first `period` bytes. Longer ties go by the
    ranks of the difference cover's samples, which are sorted once before: two
    tied places are compared by the samples at the distance where both have one.
    Equal strings end up side by side and are compared byte for byte.
    """
    depth = -(-length // 8)
    words = words_at(data, length + 2 * period + 8)
    cover, shift = difference_cover(period)
    samples = (np.arange(0, len(data) + period, period)[:, None] + cover[None, :]).ravel()
    samples = samples[samples < len(data) + period]
    order, head = refine(words, samples, depth)
    rank = np.zeros(len(data) + 2 * period, dtype=np.int64)
    rank[samples[order]] = head
    order, head = refine(words, places, period // 8)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = places[a], places[b]
        d = shift[i % period, j % period]
        return rank[i + d] < rank[j + d]

    order = merge_ties(order, head, less)
    pair = np.flatnonzero(head[1:] == head[:-1])
    mask = np.uint64(0xFFFFFFFFFFFFFFFF << (8 * (depth * 8 - length)) & 0xFFFFFFFFFFFFFFFF)
    for j in range(period // 8, depth):
        one, two = words[places[order[pair]] + 8 * j], words[places[order[pair + 1]] + 8 * j]
        if j == depth - 1:
            one, two = one & mask, two & mask
        pair = pair[one == two]
    out = np.zeros(len(places), dtype=bool)
    out[order[pair]] = True
    out[order[pair + 1]] = True
    return out


def _found_spans(docs: DataFrame, length: int, grain: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            text, first, last, anchor, whole, rest = spans(*text_buffer(part.column("text")), length, grain)
            ids = part.column("id").to_numpy()[text] if len(text) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rest.view(np.int64))],
                ["id", "first", "last", *KEY],
            )

    return docs.mapInArrow(run, "id long, first int, last int, anchor long, whole long, rest long")


def _anchors(docs: DataFrame, length: int, grain: int) -> DataFrame:
    """The anchor of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            anchor = spans(*text_buffer(part.column("text")), length, grain, digest=False)[3]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def _cut_out(listed: DataFrame, length: int) -> DataFrame:
    """The bytes of the spans of each document that are to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            rows = []
            for i, text, own in zip(part.column("id").to_pylist(), part.column("text"), part.column("spans").to_pylist(), strict=True):
                if own and (own := [w for w in own if w["cut"] == 1]):
                    raw = text.as_py().encode()
                    rows += [(i, w["first"], w["anchor"], w["n"], raw[w["first"] : w["last"] + length]) for w in own]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "first", "anchor", "n", "raw"])

    return listed.mapInArrow(run, "id long, first int, anchor long, n long, raw binary")


def _windows(listed: DataFrame, length: int) -> DataFrame:
    """Every window of the spans of each document whose anchors are not sorted, by a digest of its bytes. Spans stand for their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            for i, text, own in zip(part.column("id").to_pylist(), part.column("text"), part.column("spans").to_pylist(), strict=True):
                own = [w for w in own or [] if w["cut"] == 2]
                data = np.frombuffer(text.as_py().encode() if own else b"", dtype=np.uint8)
                for w in own:
                    at = np.arange(w["first"], w["last"] + 1)
                    one, two = digests(data[w["first"] : w["last"] + length], at - w["first"], at - w["first"] + length)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), w["n"])), pa.array(one), pa.array(two)], ["id", "at", "n", "one", "two"])

    return listed.mapInArrow(run, "id long, at int, n long, one long, two long")


def _hot(rows: DataFrame, key: str, least: int) -> tuple[DataFrame, int]:
    """The hot values of a key (fewer than HOT_SHARE), and the number of rows that make a value hot."""
    counts = rows.groupBy(key).agg(F.count("*").alias("m"))
    heavy = checkpoint(counts.groupBy(F.when(F.col("m") > least, F.col(key)).alias(key)).agg(F.sum("m").alias("m")))
    limit = max(least, (heavy.agg(F.sum("m")).first()[0] or 0) // HOT_SHARE)
    return heavy.where(F.col(key).isNotNull() & (F.col("m") > limit)).select(key), limit


def _told(found: DataFrame, anchors: DataFrame, least: int) -> DataFrame:
    """Spans with `n`, the copies of the whole span, `kinds`, the different spans of its anchor, and `one`, whether it stands for its copies."""
    hot, limit = _hot(anchors, "anchor", least)
    cold = found.join(F.broadcast(hot), "anchor", "left_anti")
    alike = Window.partitionBy(*KEY)
    told = (
        cold.repartition("anchor")
        .withColumn("n", F.count("*").over(alike))
        .withColumn("turn", F.row_number().over(alike.orderBy("id", "first")))
        .withColumn("kinds", F.sum(F.when(F.col("turn") == 1, 1).otherwise(0)).over(Window.partitionBy("anchor")))
        .withColumn("one", F.col("turn") == 1)
    )
    columns = ["id", "first", "last", "anchor", "n", "kinds", "one"]
    warm = checkpoint(found.join(F.broadcast(hot), "anchor"))
    kinds = warm.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("id", "first")).alias("lead"))
    facts = checkpoint(kinds.join(F.broadcast(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))), "anchor"))
    counted = with_facts(warm, facts, KEY, "n", limit)
    return told.select(*columns).unionByName(counted.withColumn("one", F.col("lead") == F.struct("id", "first")).select(*columns))


def _resolved(length: int, period: int, chunk: int):
    """For a bucket of anchors: the windows of its spans that another span has too, chunk after chunk of whole anchors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("id", "ascending"), ("first", "ascending")])
        anchors = table.column("anchor").to_numpy()
        sizes = np.array([len(r) for r in table.column("raw").to_pylist()], dtype=np.int64)
        ids, firsts, copies = (table.column(k).to_numpy() for k in ("id", "first", "n"))
        change = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        ends = np.cumsum(sizes)
        out_id, out_first, out_last = [], [], []
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + chunk, side="right"))
            later = change[change > start]
            inside = later[later <= stop]
            stop = int(inside[-1]) if len(inside) else (int(later[0]) if len(later) else len(sizes))
            if ends[-1] - before <= chunk:
                stop = len(sizes)
            data = np.frombuffer(b"".join(table.column("raw").slice(start, stop - start).to_pylist()), dtype=np.uint8)
            size = sizes[start:stop]
            count = size - length + 1
            begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(size)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit = repeated(data, begin[owner] + within, length, period) & (copies[start:stop][owner] == 1)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.append(True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
                a, b = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
                own = owner[a] + start
                out_id.append(ids[own])
                out_first.append(firsts[own] + within[a])
                out_last.append(firsts[own] + within[b])
            start = stop
        empty = np.empty(0, dtype=np.int64)
        return pa.table(
            {
                "id": pa.array(np.concatenate([empty, *out_id]), pa.int64()),
                "first": pa.array(np.concatenate([empty, *out_first]), pa.int32()),
                "last": pa.array(np.concatenate([empty, *out_last]), pa.int32()),
            }
        )

    return run


def removed_runs(firsts: np.ndarray, lasts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by windows that start at first to last."""
    order = np.argsort(firsts, kind="stable")
    start, end = firsts[order], lasts[order] + length
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _without(joined: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), most=2_000_000):
                data, offsets = text_buffer(part.column("text"))
                rows = []
                for k, (i, hits) in enumerate(zip(part.column("id").to_pylist(), part.column("hits").to_pylist(), strict=True)):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    starts, ends = ([], [])
                    if hits:
                        s, e = removed_runs(np.array([h["first"] for h in hits]), np.array([h["last"] for h in hits]), length)
                        starts, ends = s.tolist(), e.tolist()
                    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
                    rows.append((i, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)], kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def remove_repeats(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    grain: int = GRAIN,
    period: int = PERIOD,
    bucket_bytes: int = BUCKET_BYTES,
    chunk: int = CHUNK,
    most_kinds: int = MOST_KINDS,
    hot_spans: int = HOT_SPANS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): texts without the bytes covered by a string of `length` bytes that also starts elsewhere.

    Suffixes are bucketed by a content anchor: the least hash of `grain` bytes in
    the next `length` bytes. Equal strings have equal anchors at equal distances.
    Neighbouring suffixes with one anchor are a span of text, and a span whose
    anchor occurs nowhere else cannot repeat. Spans that are equal as a whole (by
    a 128-bit digest) are counted, those of hot anchors by partial aggregation, and one stands for all;
    of those that differ but share an anchor, one of each is cut out and sent to
    its anchor's bucket, where suffixes are sorted a chunk of anchors at a time
    (`repeated`). An anchor with over `most_kinds` different spans is not sorted
    in one place: its windows are counted by their digests, so memory is bounded
    by the chunk or `most_kinds` spans, whatever repeats.

    `removed` are maximal byte runs, `kept` the other bytes as they stand. Null
    text is empty. Ids must be unique integers; rows with a null id are left out.
    Strings do not cross texts. Other columns are not read.
    """
    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    long_ = given.where(F.octet_length("text") >= length)
    # Of use: spans that repeat as a whole, and one of each kind where an anchor has several.
    cut = F.when(F.col("one") & (F.col("kinds") > 1), F.when(F.col("kinds") > most_kinds, 2).otherwise(1)).otherwise(0)
    by_text = (
        _told(_found_spans(long_, length, grain), _anchors(long_, length, grain), hot_spans)
        .withColumn("cut", cut)
        .where("n > 1 or cut > 0")
        .groupBy("id")
        .agg(F.collect_list(F.struct("first", "last", "anchor", "n", "cut")).alias("spans"))
    )
    by_text = checkpoint(by_text)
    listed = given.join(by_text.hint("merge"), "id", "left")  # at every size the one shuffle of the texts, which both uses share
    sorted_ = (
        _cut_out(listed, length)
        .withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_resolved(length, period, chunk), "id long, first int, last int")
    )
    windows = checkpoint(_windows(listed, length))
    again = checkpoint(windows.groupBy("one", "two").agg(F.count("*").alias("m")).where("m > 1"))
    hit = with_facts(windows.where("n = 1"), again, ["one", "two"], "m", max(hot_spans, windows.count() // HOT_SHARE))
    sorted_ = sorted_.unionByName(hit.select("id", F.col("at").alias("first"), F.col("at").alias("last")))
    partly = sorted_.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("partly"))
    whole = F.transform(F.filter("spans", lambda w: w["n"] > 1), lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last")))
    none = F.array().cast("array<struct<first:int,last:int>>")
    hits = listed.join(partly.hint("merge"), "id", "left").select("id", "text", F.concat(F.coalesce(whole, none), F.coalesce("partly", none)).alias("hits"))
    return _without(hits, length)
