"""BPE encoding and decoding by a deterministic tokenization automaton over bytes."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qualispark.llm.common import slices

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how texts are split into words before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words and their ids that a worker remembers in each of two generations.
REMEMBERED = 32_000_000
#: Words up to these numbers of bytes walk side by side, so many bytes at a time; longer ones walk alone and are not remembered.
WIDTHS = (8, 16, 32, 64)
SIDE_BY_SIDE = 1 << 18
#: Entries of the table of arcs that have been asked for: a power of two, the older one goes where two meet.
TABLE_BITS = 20
#: Characters that are assigned in runs at least this long are told from others at a glance.
LONG_RUN = 300
NEVER = sys.maxsize


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 up."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """A deterministic automaton whose arcs are tokens and whose paths are exactly the tokenizations that merging gives.

    It starts as one state with a loop for each byte. The gadget of a merge
    (a, b) adds, wherever an arc a leads on to an arc b, an arc for the merged
    token past both, and leads a to a copy of its state that has no arc b; so
    after a merge no path spells its pair in two arcs. All arcs of a token lead
    to one state (`to`), so a copy is made once a merge, and none where only a
    leads to that state.

    A state has nearly all arcs, so its row of the table holds those that it
    lacks: `cuts[state]` gives for a token the merge that took its arc away. An
    arc ab exists where a had an arc when ab was made; `spines` lists for each
    token its leftmost parts with the merge by which each had to be there.

    Vocabularies are refused in which a token is made by two merges, or is merged before it is made.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        self.labels = labels
        made = {t for _, _, t in merges}
        self.to = [-1] * len(labels)
        self.cuts: list[dict[int, int]] = [{}]
        self.spines: list[tuple[tuple[int, int], ...]] = [()] * len(labels)
        self.byte_tokens = [-1] * 256
        for t, label in enumerate(labels):
            if len(label) == 1 and t not in made:
                self.to[t] = 0
                self.spines[t] = ((t, NEVER),)
                self.byte_tokens[label[0]] = t
        if -1 in self.byte_tokens:
            raise ValueError("a vocabulary with a token for every byte is needed")
        leading = [sum(s == 0 for s in self.to)]  # the tokens that lead to each state
        for k, (a, b, ab) in enumerate(merges):
            if self.to[a] < 0 or self.to[b] < 0 or self.to[ab] >= 0:
                raise ValueError(f"merge {k} uses a token before it is made, or makes one again")
            if labels[ab] != labels[a] + labels[b]:
                raise ValueError(f"merge {k} does not make its token")
            at, past = self.to[a], self.to[b]
            held = self.has_arc(at, b)
            self.to[ab] = past
            leading[past] += 1
            self.spines[ab] = ((ab, NEVER), (a, k), *self.spines[a][1:])
            if not held:  # the pair never stands in a tokenization, so nor does the token
                self.spines[ab] = ()
            elif leading[at] == 1:
                self.cuts[at][b] = k
            else:
                leading[at] -= 1
                leading.append(1)
                self.to[a] = len(self.cuts)
                self.cuts.append({**self.cuts[at], b: k})
        # A trie of the labels: (node, byte) to node, and the token that ends at a node.
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t, label in enumerate(labels):
            if not self.spines[t]:
                continue
            node = 0
            for byte in label:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.step[key]
            self.ends[node] = t
        self._tabulate()

    def _tabulate(self) -> None:
        """The automaton as arrays, for words side by side."""
        self.size = len(self.labels)
        self.goes = np.zeros((len(self.ends), 256), dtype=np.int32)
        keys = np.fromiter(self.step, dtype=np.int64, count=len(self.step))
        self.goes[keys >> 8, keys & 255] = np.fromiter(self.step.values(), dtype=np.int32, count=len(self.step))
        self.end_of = np.array(self.ends, dtype=np.int32)
        self.to_of = np.array(self.to, dtype=np.int32)
        self.size_of = np.array([len(x) for x in self.labels], dtype=np.int32)
        cut = np.array([(s * self.size + t, k) for s, own in enumerate(self.cuts) for t, k in own.items()], dtype=np.int64).reshape(-1, 2)
        cut = cut[np.argsort(cut[:, 0])]
        self.cut_keys, self.cut_times = np.append(cut[:, 0], NEVER), np.append(cut[:, 1], NEVER)
        depth = max(map(len, self.spines))
        self.parts = np.full((self.size, depth), -1, dtype=np.int64)
        self.needed = np.full((self.size, depth), -1, dtype=np.int64)
        for t, spine in enumerate(self.spines):
            for d, (part, needed) in enumerate(spine):
                self.parts[t, d], self.needed[t, d] = part, needed
        self.asked = np.full(1 << TABLE_BITS, -1, dtype=np.int64)
        self.answers = np.zeros(1 << TABLE_BITS, dtype=np.int32)

    def _lead(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The states that tokens lead to from states, -1 without an arc."""
        keys = states.astype(np.int64) * self.size + tokens
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.answers[slots]
        unknown = np.flatnonzero(self.asked[slots] != keys)
        if len(unknown):
            token, state = tokens[unknown], states[unknown].astype(np.int64)
            lacks = np.zeros(len(unknown), dtype=bool)
            for d in range(self.parts.shape[1]):
                part, needed = self.parts[token, d], self.needed[token, d]
                own = state * self.size + part
                at = np.searchsorted(self.cut_keys, own)
                lacks |= (part >= 0) & (self.cut_keys[at] == own) & (self.cut_times[at] <= needed)
            out[unknown] = np.where(lacks, -1, self.to_of[token])
            self.asked[slots[unknown]], self.answers[slots[unknown]] = keys[unknown], out[unknown]
        return out

    def encode_many(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """As `encode`, for words of up to `width` bytes, a byte of all of them at a time."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letters = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(len(words), width)
        states = np.zeros((len(words), width + 1), dtype=np.int32)
        arcs = np.zeros((len(words), width + 1), dtype=np.int32)
        for i in range(width):
            rows = np.flatnonzero(lengths > i)
            nodes = np.zeros(len(rows), dtype=np.int32)
            for j in range(i, width):
                nodes = self.goes[nodes, letters[rows, j]]
                on = (nodes > 0) & (lengths[rows] > j)
                rows, nodes = rows[on], nodes[on]
                if not len(rows):
                    break
                tokens = self.end_of[nodes]
                own = tokens >= 0
                at, tokens = rows[own], tokens[own]
                found = self._lead(states[at, i], tokens)
                led = found >= 0
                states[at[led], j + 1], arcs[at[led], j + 1] = found[led], tokens[led]
        back = np.zeros((len(words), width), dtype=np.int32)
        left, n = lengths.copy(), np.zeros(len(words), dtype=np.int64)
        rows = np.flatnonzero(left > 0)
        while len(rows):
            tokens = arcs[rows, left[rows]]
            n[rows] += 1
            back[rows, width - n[rows]] = tokens
            left[rows] -= self.size_of[tokens]
            rows = rows[left[rows] > 0]
        return [tuple(own[width - k :]) for own, k in zip(back.tolist(), n.tolist(), strict=True)]

    def has_arc(self, state: int, token: int) -> bool:
        cuts = self.cuts[state]
        if cuts:
            for part, needed in self.spines[token]:
                if part in cuts and cuts[part] <= needed:
                    return False
        return True

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells a word.

        Every place of a word is reached by one path, as every prefix has one
        tokenization; so each place needs one state and the arc that led there,
        and work grows with the length times the tokens that start at a place.
        """
        n = len(word)
        states = [0] * (n + 1)
        arcs = [-1] * (n + 1)
        step, ends = self.step.get, self.ends
        for i in range(n):
            state, node = states[i], 0
            for j in range(i, n):
                node = step(node << 8 | word[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and self.has_arc(state, token):
                    states[j + 1], arcs[j + 1] = self.to[token], token
        out = []
        while n:
            token = arcs[n]
            out.append(token)
            n -= len(self.labels[token])
        return out[::-1]


class Encoder:
    """The tokenizer of a byte-level BPE file: added tokens, splitting, the automaton, and a memory of words."""

    def __init__(self, path: str = MODEL) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain &= spec["normalizer"] is None and spec["post_processor"] is None and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        if not plain:
            raise ValueError("a byte-level BPE without normalizer, prefix space, dropout and fallbacks is needed")
        letters = byte_letters()
        vocabulary = model["vocab"]
        names: dict[int, str] = {i: t for t, i in vocabulary.items()}
        size = 1 + max(*names, *(t["id"] for t in added))
        labels = [bytes(letters[c] for c in names[i]) if i in names else b"" for i in range(size)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.labels = list(labels)
        self.added: dict[str, int] = {}
        for t in added:
            self.added[t["content"]] = t["id"]
            self.labels[t["id"]] = t["content"].encode()
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(SPLIT).findall
        self.path = path
        self.lately = None
        self._library = None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _split(self, text: str) -> list[str]:
        """The words of a text. Where it has characters that are not assigned in Python's table, of which tables of other ages differ, the library splits."""
        if not text.isascii():
            if self.lately is None:
                self.lately = unassigned()
            rare, lately = self.lately
            if rare.search(text) and not lately.isdisjoint(text):
                if self._library is None:
                    from tokenizers import Tokenizer

                    self._library = Tokenizer.from_file(self.path).pre_tokenizer
                return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.words(text)

    def _learn(self, words: set[str]) -> None:
        """Encode and remember words of moderate length that are not remembered; those that no batch has asked for lately are forgotten."""
        if self.held > REMEMBERED:
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older
        by_width: dict[int, list[str]] = {w: [] for w in WIDTHS}
        for word in words - known.keys():
            if word in older:
                known[word] = older.pop(word)
                self.held += 150 + 8 * len(known[word])
                continue
            n = len(word) if word.isascii() else len(word.encode())
            for width in WIDTHS:
                if n <= width:
                    by_width[width].append(word)
                    break
        for width, new in by_width.items():
            for at in range(0, len(new), SIDE_BY_SIDE // width):
                part = new[at : at + SIDE_BY_SIDE // width]
                known.update(zip(part, self.automaton.encode_many([w.encode() for w in part], width), strict=True))
            self.held += (200 + 3 * width) * len(new)

    def _alone(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        return tuple(self.automaton.encode(word.encode())) if ids is None else ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts; an empty text has none."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            split.append([([p], True) if i % 2 else (self._split(p), False) for i, p in enumerate(parts) if p])
        self._learn(set().union(*[words for own in split for words, added in own if not added]))
        out = []
        for own in split:
            ids: list[int] = []
            for words, added in own:
                if added:
                    ids.append(self.added[words[0]])
                else:
                    got = list(map(self.known.get, words))
                    ids.extend(chain.from_iterable(map(self._alone, words) if None in got else got))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other, as text."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", errors="replace")

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0


def unassigned() -> tuple[re.Pattern, frozenset[str]]:
    """The characters without a category in Python's Unicode table, and a pattern that finds all but those that stand in long runs with one."""
    flags = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), dtype=bool, count=0x110000)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], flags, [True]]).astype(np.int8)))
    runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= LONG_RUN]
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in runs) + "]"), frozenset(map(chr, np.flatnonzero(flags).tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str = MODEL) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_bpe(docs: DataFrame, *, text: str = "text", out: str = "token_ids", decoded: str | None = None, model: str = MODEL) -> DataFrame:
    """`docs` with the column `out`: the token ids (array<int>) of each whole text; and, if named, `decoded`: the text of these ids.

    Ids equal those of the tokenizers library without special tokens added;
    added tokens that stand in a text are found there as it does. Null text: null
    ids; empty text: no ids. Rows are judged alone, so repeated rows and ids are
    repeated. All other columns stay, whatever their names; columns of the new
    names are replaced. A row's ids meet in one task, as its text does. `model`
    must be readable by that path on every executor.
    """
    docs = docs.drop(out, *([decoded] if decoded else []))
    more = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, *more])
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for part in slices(batches, text):
            texts = part.column(position).to_pylist()
            got = enc.encode([t or "" for t in texts])
            sizes = np.array([len(g) for g in got])
            flat = np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(sizes.sum()))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pc.is_null(part.column(position))
            )
            back = [pa.array([None if t is None else enc.decode(g) for t, g in zip(texts, got, strict=True)], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *back], schema.names)
        enc.forget()  # the worker lives on; what it holds should not

    return docs.mapInArrow(run, schema)


def decode_bpe(encoded: DataFrame, *, ids: str = "token_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """`encoded` with the column `out` (a column of that name is replaced): the text of the token ids; null ids: null, none: empty.

    Added tokens are written out. Bytes that are not UTF-8, as ids in an odd order give, become U+FFFD.
    """
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    position = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for part in slices(batches, ids, most=500_000):
            texts = [None if own is None else enc.decode(own) for own in part.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
