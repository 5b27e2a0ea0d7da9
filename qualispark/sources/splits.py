"""Large JSON documents and quoted TSV files, read split by split.

Spark cuts a file anywhere. What a piece of it means depends on what stands
before: whether a quotation is open, how deep brackets are nested. So each split
is first summed up for every way in which it may begin; the summaries of a
file, one small row a split, are put in order and give the way in which each
split does begin; then splits are read, and what crosses a border is put
together. Files are read by Spark's own text reader, from any store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, QUOTE = (np.isin(np.arange(256), list(c)) for c in (b"{[", b"}]", b'"'))
BETWEEN = b", \t\r\n"


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, value, size): what stands between two `end`s, in the order of the file within a split. A file has a 64-bit number and its bytes."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(file, block, rows) of batches, cut where another split begins."""
    for batch in batches:
        if batch.num_rows:
            file, block = (batch.column(i).to_numpy() for i in (0, 1))
            edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                yield int(file[a]), int(block[a]), batch.slice(a, b - a)


# --- JSON --------------------------------------------------------------------


def _letters(rows: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """The bytes of pieces with their closing braces, and the same with what a backslash escapes blanked."""
    values = rows.column(2).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    text = np.insert(data, offsets[1:] - offsets[0], ord("}")).tobytes()
    plain = text.replace(b"\\\\", b"  ").replace(b'\\"', b"  ") if b"\\" in text else text
    return text, np.frombuffer(plain, dtype=np.uint8)


class _Scan:
    """Brackets outside quotations, for a way to begin."""

    def __init__(self, quoted: bool, depth: int = 0) -> None:
        self.quoted, self.depth = quoted, depth

    def feed(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of brackets, and the depth that each stands at: that of an opening one before it, of a closing one after it."""
        inside = (np.cumsum(QUOTE[letters]) + self.quoted) & 1
        at = np.flatnonzero((OPEN[letters] | CLOSE[letters]) & (inside == 0))
        step = np.where(OPEN[letters[at]], 1, -1)
        after = self.depth + np.cumsum(step)
        if len(inside):
            self.quoted = bool(inside[-1])
        if len(after):
            self.depth = int(after[-1])
        return at, np.where(step > 0, after - 1, after)


LEVEL = "struct<level:int,head:bigint,opened:boolean,list:boolean,tail:bigint,lists:bigint>"
SUMMARY = f"file long, block long, quoted boolean, quoted_after boolean, net int, levels array<{LEVEL}>, bytes long, blank boolean, size long"


_LEVEL = pa.struct([("level", pa.int32()), ("head", pa.int64()), ("opened", pa.bool_()), ("list", pa.bool_()), ("tail", pa.int64()), ("lists", pa.int64())])
_SUMMARY = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("quoted", pa.bool_()), ("quoted_after", pa.bool_()), ("net", pa.int32()), ("levels", pa.list_(_LEVEL)), ("bytes", pa.int64()), ("blank", pa.bool_()), ("size", pa.int64())])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split and way to begin.

    Of each level: the containers one level deeper before one opens at it (they
    belong to one that was open before) and after the last that opens,
    whether that one is a list, and how many lists open.
    """
    own: dict[tuple[int, int], list] = {}
    for file, block, rows in _runs(batches):
        scans, levels, about = own.setdefault((file, block), [[_Scan(False), _Scan(True)], [{}, {}], {"bytes": 0}])
        text, letters = _letters(rows)
        about |= {"bytes": about["bytes"] + len(text), "blank": not rows.column(2)[-1].as_py().strip(), "size": rows.column(3)[-1].as_py()}
        for scan, found in zip(scans, levels, strict=True):
            at, depths = scan.feed(letters)
            opening = OPEN[letters[at]]
            kinds, depths = letters[at][opening], depths[opening]
            for level in np.unique(np.concatenate([depths, depths - 1])).tolist():
                head, opened, lists_last, tail, lists = found.get(level, (0, False, False, 0, 0))
                opens = np.flatnonzero(depths == level)
                deeper = np.flatnonzero(depths == level + 1)
                if len(opens):
                    before = int(np.searchsorted(deeper, opens[0]))
                    after = len(deeper) - int(np.searchsorted(deeper, opens[-1]))
                    head, tail = (head, after) if opened else (head + before, after)
                    opened, lists_last, lists = True, bool(kinds[opens[-1]] == ord("[")), lists + int((kinds[opens] == ord("[")).sum())
                elif opened:
                    tail += len(deeper)
                else:
                    head += len(deeper)
                found[level] = (head, opened, lists_last, tail, lists)
    names = ("level", "head", "opened", "list", "tail", "lists")
    rows = [
        {"file": file, "block": block, "quoted": q, "quoted_after": scans[q].quoted, "net": scans[q].depth, "levels": [dict(zip(names, (n, *x), strict=True)) for n, x in levels[q].items()], **about}
        for (file, block), (scans, levels, about) in own.items()
        for q in (False, True)
    ]
    yield pa.RecordBatch.from_pylist(rows, _SUMMARY)


BEGINNING = "file long, block long, quoted boolean, depth int, listed boolean, lists long, objects long, torn boolean"


def _begin(splits: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins: in a quotation or not, how deep, in a list of the root or not, how many such lists were opened before, how many objects the open one has had; `torn`: something stands after the file's last brace."""
    quoted, depth, listed, lists, objects = False, 0, False, 0, 0
    rows = []
    both = {(r.block, bool(r.quoted)): r for r in splits.itertuples()}
    for block in sorted(set(splits["block"])):
        rows.append((splits["file"].iloc[0], block, quoted, depth, listed, lists, objects))
        own = both[block, quoted]
        level = next((x for x in own.levels if x["level"] == 1 - depth), None)
        if level is not None:
            objects += level["head"] * listed
            if level["opened"]:
                listed, objects = bool(level["list"]), int(level["tail"]) * bool(level["list"])
            lists += level["lists"]
        quoted, depth = bool(own.quoted_after), depth + int(own.net)
    # Every piece was given a closing brace, so a last piece that had none makes a byte too many.
    last = both[max(splits["block"]), False]
    torn = bool(not last.blank and splits["bytes"].sum() // 2 > last.size)
    return pd.DataFrame([(*r, torn) for r in rows], columns=["file", "block", "quoted", "depth", "listed", "lists", "objects", "torn"])


PARTS = "file long, list long, pos long, block long, whole boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects in lists of the root, whole or the part in a split; list -1: what stands around them."""
    state: tuple[int, int] | None = None
    scan, listed, lists, objects, ended = _Scan(False), False, 0, 0, False
    open_text: list[bytes] = []
    around: list[bytes] = []
    whole_since = False
    done: list[tuple] = []

    def rest() -> None:
        if state is not None:
            if b"".join(open_text):
                done.append((state[0], lists - 1, objects - 1, state[1], False, b"".join(open_text)))
            if around:
                done.append((state[0], -1, 0, state[1], False, b"".join(around)))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays([*arrays[:5], arrays[5].cast(pa.string())], ["file", "list", "pos", "block", "whole", "text"])

    for file, block, rows in _runs(batches):
        if state != (file, block):
            rest()
            state, open_text, around, whole_since = (file, block), [], [], False
            quoted, depth, listed, lists, objects, torn = (rows.column(i)[0].as_py() for i in range(3, 9))
            scan, ended = _Scan(quoted, depth), depth <= 0 and not quoted and block > 0
            if torn and block == 0:
                around.append(b"?")  # no JSON begins so
        if ended:
            continue
        text, letters = _letters(rows)
        in_object = listed and scan.depth > 2
        at, depths = scan.feed(letters)
        shallow = np.flatnonzero(depths <= 2)
        last = 0  # what stands before is dealt with
        for place, depth in zip(at[shallow].tolist(), depths[shallow].tolist(), strict=True):
            kind = letters[place]
            if depth == 2 and listed:
                if OPEN[kind]:
                    if not in_object:
                        if (gap := text[last:place]).strip(BETWEEN):
                            around.append(gap)
                        last, in_object, objects, whole_since = place, True, objects + 1, True
                elif in_object:
                    open_text.append(text[last : place + 1])
                    done.append((file, lists - 1, objects - 1, block, whole_since, b"".join(open_text)))
                    last, in_object, open_text = place + 1, False, []
            elif depth == 1 and not in_object:
                gap = text[last : place + 1]
                around.append(gap.lstrip(BETWEEN) if listed else gap)
                last = place + 1
                if kind == ord("["):
                    listed, lists, objects = True, lists + 1, 0
                elif OPEN[kind]:
                    listed, objects = False, 0
                else:
                    listed = False
            elif depth == 0 and kind == ord("}"):
                around.append(text[last : place + 1])
                last, ended = len(text), True
                break
        if last < len(text):
            if in_object:
                open_text.append(text[last:])
            elif not listed or text[last:].strip(BETWEEN):
                around.append(text[last:])
        yield flush()
    rest()
    yield flush()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _list_names(skeletons: pd.Series) -> pd.Series:
    """The names of a document's lists in their order; null if it is no JSON object."""

    def names(text: str) -> list[str] | None:
        try:
            root = json.loads(text, object_pairs_hook=tuple)
        except (ValueError, RecursionError):
            return None
        return [k for k, v in root if isinstance(v, list)] if isinstance(root, tuple) else None

    return skeletons.map(names)


def document_lists(spark: SparkSession, path: str, envelope: str, name: str, entry: str, sound: Column, message: str) -> DataFrame:
    """(envelope fields..., pos, entry) of JSON documents, a file each, however large: a row for each object in the document's list `name`.

    `pos` is the place from 0, `entry` its fields. A file that is no JSON object
    or lacks the list, a list that holds other than objects, and an envelope that is not `sound`
    fail the job. Schemas are DDL; members that they do not name are never parsed.
    """
    source = pieces(spark, path, "}")
    begins = source.mapInArrow(_sum_up, SUMMARY).groupBy("file").applyInPandas(_begin, BEGINNING)
    # Streaming past a broadcast keeps the order of pieces; it has a row of 50 bytes for each split.
    known = source.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "value", "quoted", "depth", "listed", "lists", "objects", "torn")
    parts = known.mapInArrow(_cut, PARTS)
    joined = parts.where("not whole").groupBy("file", "list", "pos").agg(_together("").alias("text"))
    fields = T.StructType.fromDDL(envelope)
    read = F.from_json("text", T.StructType([*fields.fields, T.StructField(name, T.ArrayType(T.StringType()))]))
    frames = joined.where("list = -1").select("file", read.alias("_e"), _list_names("text").alias("_names")).select("file", "_names", F.array_position("_names", name).alias("_place"), F.size(f"_e.{name}").alias("_strays"), "_e.*")
    holds = F.coalesce((F.col("_place") > 0) & (F.col("_strays") == 0) & sound, F.lit(False))
    kept = [F.col(f.name) for f in fields.fields]
    frames = frames.select("file", (F.col("_place") - 1).alias("list"), *kept, holds.alias("_sound"))
    refused = F.raise_error(F.lit(message))
    objects = parts.where("whole").select("file", "list", "pos", "text").unionByName(joined.where("list >= 0"))
    found = objects.join(F.broadcast(frames), ["file", "list"])  # a row for each file
    rows = found.select(*kept, F.col("pos").cast("int").alias("pos"), F.when(F.col("_sound") & F.startswith("text", F.lit("{")), F.from_json("text", entry)).otherwise(refused).alias("entry"))
    return rows.unionByName(frames.where("not _sound").select(*kept, F.lit(0).alias("pos"), F.when(F.col("_sound"), F.from_json(F.lit(None), entry)).otherwise(refused).alias("entry")))


def _together(between: str) -> Column:
    """The parts of a thing in the order of their splits."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), between)


# --- TSV ---------------------------------------------------------------------

_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*')
_OPENS = re.compile(r'(?:(?:[^\t"][^\t]*|"[^"]*(?:""[^"]*)*"[^\t]*)?\t)*"[^"]*(?:""[^"]*)*')


def leaves_open(line: str, quoted: bool) -> bool:
    """Whether a line that begins inside a quoted cell or not ends inside one. Only a quotation mark at the start of a cell opens it."""
    if '"' not in line:
        return quoted
    if quoted:
        end = _CLOSED.match(line).end()
        if end == len(line):
            return True
        tab = line.find("\t", end)
        return tab >= 0 and leaves_open(line[tab + 1 :], False)
    return _OPENS.fullmatch(line) is not None


def _sum_up_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and way to begin: the way it ends and how many rows end in it."""
    own: dict[tuple[int, int], list] = {}
    for file, block, rows in _runs(batches):
        ways = own.setdefault((file, block), [[False, 0], [True, 0]])
        for line in rows.column(2).to_pylist():
            for way in ways:
                way[0] = leaves_open(line, way[0])
                way[1] += not way[0]
    yield pa.RecordBatch.from_pylist(
        [{"file": f, "block": b, "quoted": bool(q), "after": ways[q][0], "ends": ways[q][1]} for (f, b), ways in own.items() for q in (0, 1)],
        pa.schema([("file", pa.int64()), ("block", pa.int64()), ("quoted", pa.bool_()), ("after", pa.bool_()), ("ends", pa.int64())]),
    )


def _begin_lines(splits: pd.DataFrame) -> pd.DataFrame:
    quoted, before, rows = False, 0, []
    both = {(r.block, bool(r.quoted)): r for r in splits.itertuples()}
    for block in sorted(set(splits["block"])):
        rows.append((splits["file"].iloc[0], block, quoted, before))
        own = both[block, quoted]
        quoted, before = bool(own.after), before + int(own.ends)
    return pd.DataFrame(rows, columns=["file", "block", "quoted", "before"])


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, quoted, number, began, held = None, False, 0, False, []
    names = ["file", "pos", "block", "whole", "text"]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names)

    def rest() -> list[tuple]:
        return [(*state, False, "\n".join(held))] if held else []

    for file, block, rows in _runs(batches):
        out: list[tuple] = []
        if state is None or state[0] != file or state[2] != block:
            if state is not None:
                out += rest()
            quoted, number = rows.column(3)[0].as_py(), rows.column(4)[0].as_py()
            began, held = not quoted, []
        for line in rows.column(2).to_pylist():
            held.append(line)
            quoted = leaves_open(line, quoted)
            if not quoted:
                out.append((file, number, block, began, "\n".join(held)))
                held, began, number = [], True, number + 1
        state = (file, number, block)
        yield record(out)
    if state is not None:
        yield record(rest())


def tsv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text): the rows of TSV files as text, numbered from 0 in each file; quoted cells may hold tabs and line breaks."""
    source = pieces(spark, path, "\n")
    begins = source.mapInArrow(_sum_up_lines, "file long, block long, quoted boolean, after boolean, ends long").groupBy("file").applyInPandas(_begin_lines, "file long, block long, quoted boolean, before long")
    known = source.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "value", "quoted", "before")
    parts = known.mapInArrow(_cut_lines, "file long, pos long, block long, whole boolean, text string")
    joined = parts.where("not whole").groupBy("file", "pos").agg(_together("\n").alias("text"))
    return parts.where("whole").select("file", "pos", "text").unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))
