"""SentencePiece encoding and decoding: pieces are found by a suffix array, their edges relaxed in order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Set
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualispark.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of spans and their ids that a worker remembers in each of two generations, and pairs of pieces (a power of two).
REMEMBERED = 25_000_000
PAIR_BITS = 21
#: Characters of new spans that are indexed together, and of a span that is cut where no piece can lie across.
INDEXED = 400_000
LONG = 64
#: Bytes of text that a worker encodes at a time: what it holds besides what it remembers is in proportion.
SLICE = 500_000


class Encoder:
    """A BPE vocabulary with byte fallback, for batches of spans.

    Pieces never cross from a letter to a space mark, so a text falls into spans
    (space marks, then other characters) that are encoded once per batch. All new
    spans are concatenated and indexed by a suffix array of their first
    characters; every piece is searched for by bisection, which gives its
    occurrences as one range. The occurrences are edges from their start to
    their end; sorted by position they are relaxed left to right. The last piece
    of the encoding of a prefix is the one edge whose two end pieces stay apart
    when merged by rank (they are 'stable'), so the path kept is that of the
    merge order, not merely a likely one.
    """

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {self.texts[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.rank = {p: (-model.get_score(i)) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        mixed = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if mixed or len(self.bytes) != 256:
            raise ValueError("a vocabulary with byte fallback and space marks at the front of pieces only is needed")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.spans = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        wanted = [p for p in self.ids if set(p) != {SPACE} or len(p) == 1]
        self.piece_ids = np.array([self.ids[p] for p in wanted])
        self.piece_sizes = np.array([len(p) for p in wanted])
        self.piece_points = np.zeros((len(wanted), self.longest), dtype=np.int64)
        for i, p in enumerate(wanted):
            self.piece_points[i, : len(p)] = [ord(c) for c in p]
        self.order = {p: i for i, p in enumerate(sorted(self.ids, key=lambda p: (len(p) > 1, self.rank[p])))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.held = 0
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.pair_keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_stable = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.unknown: dict[str, int] = {}

    def merged(self, span: str) -> list[str]:
        """The pieces of a span by repeated merging, lowest rank first, leftmost among equals; a heap of possible merges keeps long runs cheap."""
        parts: list[str | None] = list(span)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.rank
        heap = [(rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and parts[k] + parts[after[k]] in rank:
                    heappush(heap, (rank[parts[k] + parts[after[k]]], k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece before its last merge; None for single characters and for pieces that merging never makes."""
        if piece not in self.halves:
            found = None
            if len(piece) > 1:
                for i in range(1, len(piece)):
                    a, b = piece[:i], piece[i:]
                    if a in self.order and b in self.order and self._apart(a, b, self.order[piece]) and self._made(a) and self._made(b):
                        found = (a, b)
                        break
            self.halves[piece] = found
        return self.halves[piece]

    def _made(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) is not None

    def _apart(self, a: str, b: str, limit: int | None = None) -> bool:
        """Whether merging the string a + b, in merges of order below `limit`, ends with the two pieces a and b.

        The merges that made the pieces are undone from the latest on; a merge
        across the border that would have come before one of them breaks the pair.
        """
        order, none = self.order, len(self.order)
        bound = none if limit is None else limit
        while True:
            if order.get(a + b, none) < bound:
                return False
            x, y = order.get(a, -1), order.get(b, -1)
            if len(a) > 1 and (x > y or len(b) == 1):
                bound, a = min(bound, x), self._halves(a)[1]
            elif len(b) > 1:
                bound, b = min(bound, y + 1), self._halves(b)[0]
            else:
                return True

    def _codes(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def _packed(self, parts: list[str]) -> bytes:
        return np.array([c for p in parts for c in self._codes(p)], dtype=np.int32).tobytes()

    def _name(self, number: int) -> str:
        return self.texts[number] if number < len(self.texts) else self._unknown_texts[number - len(self.texts)]

    def _stable(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart, by pair; before < 0 is the start of a span."""
        keys = (before.astype(np.int64) + 1) << 32 | piece.astype(np.int64)
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.pair_keys[slots] != keys)
        out = self.pair_stable[slots]
        if len(missing):
            found, at = np.unique(keys[missing], return_inverse=True)
            fresh = np.empty(len(found), dtype=bool)
            for k, key in enumerate(found.tolist()):
                a, b = (key >> 32) - 1, key & 0xFFFFFFFF
                fresh[k] = self._made(self._name(b)) and (a < 0 or self._apart(self._name(a), self._name(b)))
            out[missing] = fresh[at]
            slots = ((found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_keys[slots] = found
            self.pair_stable[slots] = fresh
        return out

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of a piece, by suffix array and bisection."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        letters, ranks = np.unique(points, return_inverse=True)
        bits = int(len(letters)).bit_length()
        per = 63 // bits
        words = -(-self.longest // per)
        padded = np.concatenate([ranks.astype(np.int64) + 1, np.zeros(self.longest + per, dtype=np.int64)])
        n = len(points)
        keys = []
        for w in range(words):
            key = np.zeros(n, dtype=np.int64)
            for k in range(w * per, (w + 1) * per):
                key = key << bits | (padded[k : k + n] if k < self.longest else 0)
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        number = np.zeros(max(0x110000 if int(letters[-1]) > 0xFFFF else 0x10000, int(self.piece_points.max()) + 1), dtype=np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        codes = number[self.piece_points]
        here = ((codes > 0) | (self.piece_points == 0)).all(axis=1)
        if not here.any():
            return (np.empty(0, np.int64),) * 3
        lengths, ids = self.piece_sizes[here], self.piece_ids[here]
        low = np.zeros((len(lengths), words), dtype=np.int64)
        high = np.zeros((len(lengths), words), dtype=np.int64)
        table = np.zeros((len(lengths), words * per), dtype=np.int64)
        table[:, : self.longest] = codes[here]
        table[np.arange(words * per)[None, :] >= lengths[:, None]] = 0
        filled = np.arange(words * per)[None, :] < lengths[:, None]
        for w in range(words):
            for k in range(w * per, (w + 1) * per):
                low[:, w] = low[:, w] << bits | table[:, k]
                high[:, w] = high[:, w] << bits | np.where(filled[:, k], table[:, k], (1 << bits) - 1)
        first, last = self._bisect(keys, low, False), self._bisect(keys, high, True)
        counts = last - first
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        return suffixes[at].astype(np.int32), np.repeat(lengths.astype(np.int32), counts), np.repeat(ids.astype(np.int32), counts)

    @staticmethod
    def _bisect(keys: list[np.ndarray], wanted: np.ndarray, right: bool) -> np.ndarray:
        """Bisection for many keys of several words at once."""
        lo = np.zeros(len(wanted), dtype=np.int64)
        hi = np.full(len(wanted), len(keys[0]), dtype=np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            safe = np.minimum(mid, len(keys[0]) - 1)
            less = np.zeros(len(wanted), dtype=bool)
            same = np.ones(len(wanted), dtype=bool)
            for w, key in enumerate(keys):
                value = key[safe]
                less |= same & (value < wanted[:, w])
                same &= value == wanted[:, w]
            go = open_ & (less | (same & right))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)

    def _relax(self, spans: list[str]) -> None:
        """Encode spans together and remember them."""
        direct = [s for s in spans if s.startswith(SPACE + SPACE)]
        for s in direct:  # runs of space marks have equal ranks; such spans are merged one by one, the run apart from the word's own mark
            self.known[s] = self._long_run(s)
        spans = [s for s in spans if not s.startswith(SPACE + SPACE)]
        if not spans:
            return
        text = " ".join(spans) + " "
        self._unknown_texts = sorted({c for c in set(text) if c not in self.ids and c != " "})
        numbers = {c: len(self.texts) + i for i, c in enumerate(self._unknown_texts)}
        self.pair_drop()
        start, length, piece = self._edges(text)
        if numbers:
            own = [(i, numbers[c]) for i, c in enumerate(text) if c in numbers]
            start = np.concatenate([start, [i for i, _ in own]]).astype(np.int32)
            length = np.concatenate([length, np.ones(len(own), np.int32)])
            piece = np.concatenate([piece, [p for _, p in own]]).astype(np.int32)
        sizes = np.array([len(s) for s in spans])
        begins = np.cumsum(sizes + 1) - sizes - 1
        end = start + length
        offset = end - np.repeat(begins.astype(np.int32), sizes + 1)[start]
        order = np.argsort(offset.astype(np.uint16) if sizes.max() < 1 << 16 else offset, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        last = np.full(len(text) + 1, -2, dtype=np.int32)  # the last piece of the encoding that ends here
        back = np.zeros(len(text) + 1, dtype=np.int32)
        last[begins] = -1
        bounds = np.searchsorted(offset, np.arange(1, sizes.max() + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            before = last[start[a:b]]
            able = np.flatnonzero(before > -2)
            able = able[self._stable(before[able], piece[a:b][able])]
            last[end[a:b][able]] = piece[a:b][able]
            back[end[a:b][able]] = start[a:b][able]
        # Back from the ends of all spans at once; what is passed is the path.
        passed = np.zeros(len(text) + 1, dtype=bool)
        at, stuck = begins + sizes, np.zeros(len(sizes), dtype=bool)
        left = np.arange(len(sizes))
        while len(left):
            lost = last[at] == -2
            stuck[left[lost]] = True
            going = (last[at] >= 0) & ~lost
            at, left = at[going], left[going]
            passed[at] = True
            at = back[at]
        path = np.flatnonzero(passed)
        numbers_out = last[path]
        cuts = np.searchsorted(path, begins + sizes, side="right").tolist()
        flat, many, start_at = numbers_out.tobytes(), len(self.texts), 0
        whole = stuck | (np.bincount(np.searchsorted(begins, path[numbers_out >= many], side="left") - 1, minlength=len(sizes)) > 0)
        for s, stop, odd in zip(spans, cuts, whole.tolist(), strict=True):
            own = flat[4 * start_at : 4 * stop]
            if not odd:
                self.known[s] = own
            else:
                named = numbers_out[start_at:stop].tolist()
                self.known[s] = self._packed(self.merged(s) if all(n < many for n in named) else [self._name(n) for n in named])
            start_at = stop

    def _long_run(self, span: str) -> bytes:
        word = span.lstrip(SPACE)
        if word:
            tail = self._one(SPACE + word)
            first = self.texts[int(np.frombuffer(tail, np.int32, 1)[0])]
            if first.startswith(SPACE) and first != SPACE:
                return self._packed(self.merged(span[: len(span) - len(word) - 1])) + tail
            return self._packed(self.merged(span[: len(span) - len(word)])) + self._one(word)
        return self._packed(self.merged(span))

    def pair_drop(self) -> None:
        """Numbers of unknown characters are of one batch only: forget pairs that hold them."""
        many = len(self.texts)
        stale = ((self.pair_keys >> 32) > many) | ((self.pair_keys & 0xFFFFFFFF) >= many)
        self.pair_keys[stale] = -1

    def encode_spans(self, spans: Set[str]) -> None:
        """Encode the spans that are not remembered yet; those that no batch has asked for lately are forgotten."""
        if self.held > REMEMBERED:
            self.older, self.known, self.held = self.known, {}, 0
        known = self.known
        new = spans - known.keys()
        for s in new & self.older.keys():
            known[s] = self.older.pop(s)
        cut = {s: self._cut(s) for s in new - known.keys() if len(s) > LONG}
        self._learn(new - known.keys() - cut.keys())
        self._learn({p for own in cut.values() for p in own} - known.keys())
        for s, own in cut.items():
            known[s] = b"".join([known[p] for p in own])
        self.held += sum([200 + 2 * len(s) + len(known[s]) for s in new])

    def _learn(self, new: set[str]) -> None:
        part, size = [], 0
        for s in new:
            part.append(s)
            size += len(s) + 1
            if size >= INDEXED:
                self._relax(part)
                part, size = [], 0
        if part:
            self._relax(part)

    def _cut(self, span: str) -> list[str]:
        """A span cut between characters that stand side by side in no piece: no merge crosses there, so the parts have encodings of their own."""
        out, inside, last = [], self.inside, 0
        for i in range(1, len(span)):
            if span[i - 1 : i + 1] not in inside:
                out.append(span[last:i])
                last = i
        return [*out, span[last:]]

    def _one(self, span: str) -> bytes:
        if span not in self.known:
            self._relax([span])
        return self.known[span]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of whole texts; an empty text has none."""
        return [np.frombuffer(own, np.int32).tolist() for own in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Piece ids of whole texts as 32-bit integers. Equal spans of the texts are held once."""
        spans: dict[str, str] = {}
        split = []
        for t in texts:
            own = self.spans.findall(SPACE + t.replace(" ", SPACE)) if t else []
            split.append(list(map(spans.setdefault, own, own)))
        self.encode_spans(spans.keys())
        look = self.known.__getitem__
        return [b"".join(map(look, own)) for own in split]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: byte pieces as bytes, space marks as spaces, the leading mark dropped."""
        texts = self.texts
        if not hasattr(self, "_raw"):
            byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
            self._raw = [byte_of.get(i, t.replace(SPACE, " ").encode()) for i, t in enumerate(texts)]
        raw = self._raw
        found = b"".join([raw[i] for i in ids]).decode("utf-8", errors="replace")
        return found[1:] if found.startswith(" ") else found


_encoders: dict[str, Encoder] = {}


def encoder(path: str = MODEL) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, *, text: str = "text", out: str = "piece_ids", decoded: str | None = None, model: str = MODEL) -> DataFrame:
    """`docs` with the column `out`: the piece ids (array<int>) of each whole text; and, if named, `decoded`: the text of these ids.

    Null text: null ids; empty text: no ids. All other columns stay, columns of
    the new names are replaced. The result
    equals that of the SentencePiece library for BPE models with byte fallback,
    identity normalisation and a dummy prefix.
    """
    docs = docs.drop(out, *([decoded] if decoded else []))
    more = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, *more])
    names = docs.columns
    position = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for part in slices(batches, text, most=SLICE):
            texts = part.column(position).to_pylist()
            got = enc.encode_packed([t or "" for t in texts])
            sizes = np.array([len(g) // 4 for g in got])
            flat = np.frombuffer(b"".join(got), dtype=np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pc.is_null(part.column(position))
            )
            back = [pa.array([None if t is None else enc.decode(np.frombuffer(g, np.int32).tolist()) for t, g in zip(texts, got, strict=True)], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *back], schema.names)
        enc.known, enc.older, enc.held = {}, {}, 0  # the worker lives on; what it holds should not

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, *, ids: str = "piece_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """`encoded` with the column `out` (a column of that name is replaced): the text of the piece ids; null ids: null."""
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    names = encoded.columns
    position = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for part in slices(batches, ids, most=500_000):
            texts = [None if own is None else enc.decode(own) for own in part.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, out])

    return encoded.mapInArrow(run, schema)


def ids_digest(column: str):
    """SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(F.col(column), ","), 256)
