"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualispark.llm.common import checkpoint, slices

#: Characters of an item for each error that a match may have.
CHARS_PER_ERROR = 20
#: Characters of benchmark text that one scan of the documents carries to the tasks, at most.
BLOCK_CHARS = 8_000_000


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their offsets; with that many errors one of them must be untouched."""
    cuts = [round(i * len(item) / (errors + 1)) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def distance(length: int, mask: dict[str, int], text: str) -> int:
    """The least edit distance between a pattern (its length and masks) and any substring of `text`."""
    full = (1 << length) - 1
    high = 1 << (length - 1)
    up, down, now, least = full, 0, length, length
    for c in text:
        eq = mask.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(across | up))
        fall = up & across
        if rise & high:
            now += 1
        elif fall & high:
            now -= 1
            least = min(least, now)
        rise = (rise << 1) & full
        eq |= down
        up = ((fall << 1) & full) | (full & ~(eq | rise))
        down = rise & eq
    return least


class Matcher:
    """Finds the items within their error budgets in a text."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int) -> None:
        self.items = [(i, t, len(t) // chars_per_error) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, errors) in enumerate(self.items):
            for at, piece in pieces(t, errors):
                places[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of every item that some substring of the normalised text matches."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                starts[k].add(end + 1 - n - at)
        out = []
        for k, places in starts.items():
            item, pattern, errors = self.items[k]
            if pattern in text:
                out.append((item, 0))
                continue
            if not errors:
                continue
            least, last = errors + 1, None
            spans: list[list[int]] = []
            for at in sorted(places):
                a, b = max(0, at - errors), at + len(pattern) + errors
                if last is not None and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
                last = b
            if k not in self.masks:
                self.masks[k] = masks(pattern)
            for a, b in spans:
                least = min(least, distance(len(pattern), self.masks[k], text[a:b]))
            if least <= errors:
                out.append((item, least))
        return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    chars_per_error: int = CHARS_PER_ERROR,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """`docs` with `matches`: the benchmark items in each document as array<struct<item_id, distance>>, by item_id.

    Texts are compared in lower case with white space collapsed. An item of n
    characters allows e = n // `chars_per_error` errors. It is split into e + 1
    pieces; an Aho-Corasick pass over each whole document finds exact pieces, and
    the spans that they point to are verified with Myers' bit vectors. The size
    of the benchmark is measured first: over `block_chars` characters it is dealt
    into blocks by hash. Each block is a scan of its own, of which the matches of
    distinct contaminated texts are written to the checkpoint folder; so the
    driver and a task hold one block at a time.

    Null and empty texts match nothing; null and blank items, and items with a
    null id, are never matched; equal items are all reported. All other columns
    stay, a column `matches` is replaced; without a match it is empty, not null.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")
    ).where(F.length(F.trim("t")) > 0).distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    given = docs.drop("matches")

    def block(number: int) -> list[tuple[int, str]]:
        own = [(r["i"], normalise(r["t"])) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number).collect()]
        return sorted((i, t) for i, t in own if t)

    if blocks == 1:
        return _matched(given, text, block(0), chars_per_error, "matches")
    named = "_key"
    while named in given.columns:
        named += "_"
    found = None
    for number in range(blocks):
        scanned = _matched(given.select(F.col(text).alias("_text")), "_text", block(number), chars_per_error, "_some").where(F.size("_some") > 0)
        scanned = checkpoint(scanned.select(F.sha2("_text", 256).alias(named), "_some").distinct())
        found = scanned if found is None else found.unionByName(scanned)
    merged = found.groupBy(named).agg(F.array_sort(F.flatten(F.collect_list("_some"))).alias("matches"))
    none = F.array().cast(merged.schema["matches"].dataType)
    return given.join(merged, F.sha2(text, 256) == F.col(named), "left").drop(named).withColumn("matches", F.coalesce("matches", none))


def _matched(docs: DataFrame, text: str, items: list[tuple[int, str]], chars_per_error: int, out: str) -> DataFrame:
    """`docs` with the column `out`: the matches of a block of items."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, chars_per_error) if items else None
        for part in slices(batches, text, most=1_000_000):
            texts = part.column(part.schema.names.index(text)).to_pylist()
            got = [sorted(matcher.found(normalise(t))) if matcher and t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[{"item_id": i, "distance": d} for i, d in g] for g in got], kind)], schema.names)

    return docs.mapInArrow(run, schema)
