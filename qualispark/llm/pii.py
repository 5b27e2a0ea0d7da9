"""Personal data: patterns, and a skip-chain conditional random field that carries labels to repeated and similar tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the field is trained on, at most.
FIT_DOCS = 1500
FEATURES = 4096
SURE = 0.9
#: The prior of the skip edges' weight, normal: that repeats are one entity is believed beforehand (20,000 to 1), but a few edges that disagree take it back.
BELIEF, SPREAD = 9.9, 5.0
#: A label that a pattern has found is observed: all others are this far below it.
OBSERVED = 1e4
#: Digits, or characters of a token, from which on a repeat is linked; shorter ones repeat by chance.
LONG = 7
#: Messages have settled when none changes by more than this.
TOLERANCE = 1e-6
#: Rounds of a message after which its step halves.
PATIENCE = 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s,;:!?\"'<>=|\[\]{}]*[0-9@][^\s,;:!?\"'<>=|\[\]{}]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _counted(pattern: re.Pattern, text: str, least: int, most: int, check=None) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if least <= len(digits) <= most and (check is None or check(digits)):
            out.append(m.span())
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as in KINDS, then start: leftmost, not overlapping within a kind."""
    if not _MARK.search(text):
        return []
    found = [_emails(text) if "@" in text else [], _addresses(text), _counted(_CARD, text, 16, 19, luhn), _counted(_PHONE, text, 8, 15) if "+" in text else []]
    return [(kind, a, b) for kind, spans in zip(KINDS, found, strict=True) for a, b in spans]


def _shape(token: str) -> str:
    out = re.sub(r"[A-Za-zÀ-￿]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", out)


def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % FEATURES


_feature_of: dict[str, int] = {}


def _ids(names: list[str]) -> list[int]:
    if len(_feature_of) > 200_000:
        _feature_of.clear()
    out = []
    for n in names:
        if n not in _feature_of:
            _feature_of[n] = _feature(n)
        out.append(_feature_of[n])
    return out


@dataclass
class Graph:
    """The tokens of one text that hold a digit or @, and the edges of the field between them."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    labels: list[int]  # of the patterns; 0 for none
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int]]


def graph(text: str, base: list[tuple[str, int, int]]) -> Graph:
    """Chain edges join tokens with at most two characters between them. Skip edges join long tokens that are equal, equal in their last seven digits or in the part before an @: each to the last one before it, and all to the first of them that a pattern has found, so evidence does not wane with the distance."""
    spans, features, labels, chain, skips = [], [], [], [], []
    inside = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    k, groups = 0, {}
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".()-":
            b -= 1
        while a < b and text[a] in ".()-":
            a += 1
        if b <= a:
            continue
        token = text[a:b]
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        label = next((kind for x, y, kind in inside[k : k + 4] if x < b and y > a), 0)
        digits = re.sub(r"[^0-9]", "", token)
        before = _shape((text[max(0, a - 12) : a].split(" ")[-2:-1] or [""])[0])
        names = [
            "bias",
            f"s:{_shape(token)}|{before}",  # digits mean little without what stands before them
            f"n:{min(len(digits), 20)}|{before}",
            f"a:{'@' not in token and any(c.isalpha() for c in token)}",
            f"l:{len(digits) in range(16, 20) and luhn(digits)}",
            f"i:{bool(re.fullmatch(r'(?:[0-9]{1,3}[.]){3}[0-9]{1,3}', token)) and all(int(p) <= 255 for p in token.split('.'))}",
            f"@:{'@' in token}",
            "p:" + (text[a - 1] if a else "^"),
            "f:" + (text[b] if b < len(text) else "$"),
        ]
        i = len(spans)
        spans.append((a, b))
        features.append(_ids(names))
        labels.append(label)
        if i and a - spans[i - 1][1] <= 2:
            chain.append((i - 1, i))
        keys = {"t" + token.lower()} if len(token) >= LONG else set()
        keys |= {"d" + digits[-LONG:]} if len(digits) >= LONG else set()
        keys |= {"@" + token[: token.index("@")].lower()} if token.find("@") >= 3 else set()
        for key in keys:
            groups.setdefault(key, []).append(i)
    for own in groups.values():
        skips += zip(own, own[1:], strict=False)
        found = next((i for i in own if labels[i]), -1)
        if found >= 0:
            skips += [(min(found, i), max(found, i)) for i in own if i != found]
    return Graph(spans, features, labels, chain, sorted(set(skips)))


@dataclass
class Field:
    """Unary weights by feature and log potentials of chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _unary(weights: np.ndarray, features: list[list[int]]) -> np.ndarray:
    return weights[np.array(features, dtype=np.int64)].sum(axis=1)


def _potential(pairs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log ratio of the joint share of two labels on an edge to the product of their shares, smoothed."""
    n = len(LABELS)
    joint = np.full((n, n), 0.5)
    if len(pairs):
        np.add.at(joint, (labels[pairs[:, 0]], labels[pairs[:, 1]]), 1.0)
        np.add.at(joint, (labels[pairs[:, 1]], labels[pairs[:, 0]]), 1.0)
    joint /= joint.sum()
    own = joint.sum(axis=1)
    return np.log(joint) - np.log(own)[:, None] - np.log(own)[None, :]


def _agreement(pairs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The weight of equal labels on a skip edge, on the diagonal, by pseudo-likelihood.

    It is free: the likelihood of each end's label, given the other's and the
    shares of labels alone, times a wide normal prior is made largest. Tokens'
    own features have no say, as they explain what patterns have found and would
    leave nothing to learn. Without edges the prior stands.
    """
    weight = BELIEF
    if len(pairs):
        given = labels[np.concatenate([pairs[:, 1], pairs[:, 0]])]
        own = labels[np.concatenate([pairs[:, 0], pairs[:, 1]])]
        share = (np.bincount(own, minlength=len(LABELS)) + 0.5) / (len(own) + 0.5 * len(LABELS))
        low, high = -30.0, 30.0
        for _ in range(60):  # the likelihood is concave
            weight = (low + high) / 2
            odds = share[given] * np.exp(weight)
            slope = (own == given).sum() - (odds / (odds + 1 - share[given])).sum() - (weight - BELIEF) / SPREAD**2
            low, high = (weight, high) if slope > 0 else (low, weight)
    return np.eye(len(LABELS)) * weight


def train(graphs: list[Graph], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Piecewise training on the patterns' labels: softmax regression for the tokens, ratios of joint shares for the edges.

    A token that no pattern has found but that a skip edge joins to a found one
    may well be the same entity: it is no example of `none`, and its edges do not
    count.
    """
    open_ = [{i for a, b in g.skips for i, j in ((a, b), (b, a)) if g.labels[j] and not g.labels[i]} for g in graphs]
    features = [f for g, skip in zip(graphs, open_, strict=True) for i, f in enumerate(g.features) if i not in skip]
    weights = np.zeros((FEATURES, len(LABELS)))
    if not features:
        weights[_feature("bias"), 0] = 5.0
        none = np.empty((0, 2), dtype=np.int64)
        return Field(weights, _potential(none, none), _agreement(none, none))
    x = np.array(features, dtype=np.int64)
    y = np.array([v for g, skip in zip(graphs, open_, strict=True) for i, v in enumerate(g.labels) if i not in skip], dtype=np.int64)
    step = np.zeros_like(weights)
    for _ in range(rounds):
        z = weights[x].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad = np.zeros_like(weights)
        np.add.at(grad, x.ravel(), np.repeat(p, x.shape[1], axis=0))
        grad = grad / len(y) + ridge * weights
        step += grad * grad
        weights -= rate * grad / (np.sqrt(step) + 1e-6)
    base = np.cumsum([0] + [len(g.labels) for g in graphs])
    every = np.array([v for g in graphs for v in g.labels], dtype=np.int64)
    edges = lambda name: np.array([(a + o, b + o) for g, o, skip in zip(graphs, base, open_, strict=False) for a, b in getattr(g, name) if a not in skip and b not in skip], dtype=np.int64).reshape(-1, 2)
    return Field(weights, _potential(edges("chain"), every), _agreement(edges("skips"), every))


def marginals(field: Field, graphs: list[Graph], tolerance: float = TOLERANCE) -> np.ndarray:
    """Loopy sum-product messages over the chain and skip edges of many texts at once; what patterns have found is observed.

    Messages are passed until none changes by more than `tolerance`, however long
    a chain of repeats is. Only messages out of tokens whose belief has moved are
    made anew, so a round costs what still moves in it. Messages that circle in a
    loop settle because the step halves with every PATIENCE rounds of a message;
    each message depends on its own text only.
    """
    base = np.cumsum([0] + [len(g.labels) for g in graphs])
    local = _unary(field.unary, [f for g in graphs for f in g.features])
    known = np.array([v for g in graphs for v in g.labels], dtype=np.int64)
    at = np.flatnonzero(known)
    local[at] = -OBSERVED
    local[at, known[at]] = 0
    edges = [(a + o, b + o, 0) for g, o in zip(graphs, base, strict=False) for a, b in g.chain] + [(a + o, b + o, 1) for g, o in zip(graphs, base, strict=False) for a, b in g.skips]
    belief = local
    if edges:
        e = np.array(edges, dtype=np.int64)
        source, target, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2]] * 2)
        reverse = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        tables = np.stack([field.chain, field.skip])
        messages = np.zeros((len(source), len(LABELS)))
        made = np.zeros(len(source), dtype=np.int64)
        outgoing = np.argsort(source, kind="stable")
        first = np.searchsorted(source[outgoing], np.arange(len(local) + 1))
        belief = local.copy()
        active = np.arange(len(source))
        while len(active):
            out = (belief[source[active]] - messages[reverse[active]])[:, :, None] + tables[kind[active]]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0, :]
            new -= new.max(axis=1, keepdims=True)
            change = (new - messages[active]) * np.exp2(-1.0 - made[active] // PATIENCE)[:, None]
            messages[active] += change
            made[active] += 1
            np.add.at(belief, target[active], change)
            moved = active[np.abs(change).max(axis=1) > tolerance]
            nodes = np.unique(target[moved])
            sizes = first[nodes + 1] - first[nodes]
            stirred = outgoing[np.repeat(first[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            active = np.union1d(moved, stirred)
        belief = local.copy()
        np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, g: Graph, p: np.ndarray, sure: float = SURE) -> list[tuple[str, int, int]]:
    """Runs of tokens of one kind that no pattern has found; tokens of a run are joined by chain edges. A run without LONG digits or an @ names nobody."""
    out: list[list] = []
    linked = set(g.chain)
    for i, (a, b) in enumerate(g.spans):
        kind = int(p[i].argmax())
        if kind == 0 or p[i, kind] < sure or g.labels[i]:
            continue
        if out and out[-1][0] == KINDS[kind - 1] and out[-1][3] == i - 1 and (i - 1, i) in linked:
            out[-1][2:] = [b, i]
        else:
            out.append([KINDS[kind - 1], a, b, i])
    return [(k, a, b) for k, a, b, _ in out if "@" in text[a:b] or len(re.sub(r"[^0-9]", "", text[a:b])) >= LONG]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def fit_field(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS, chars: int = 20000) -> Field:
    """A field trained on at most `fit_docs` texts with a digit or @, those of smallest hash and at most `chars` characters."""
    rows = docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= chars)).select(F.xxhash64(F.col(doc_id), F.lit(10)).alias("h"), F.col(doc_id).alias("i"), F.col(text).alias("t"))
    total = rows.count()
    cut = int(min(1.0, 1.2 * fit_docs / max(1, total)) * (1 << 30))
    found = rows.where(F.pmod("h", F.lit(1 << 30)) < cut).orderBy("h", "i").limit(fit_docs).collect()
    return train([graph(r["t"], base_spans(r["t"])) for r in found])


def find_personal_data(docs: DataFrame, field: Field, *, doc_id: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """(doc_id, base, spans): comma-joined kind:start:end of the patterns, and of all spans with those of the field.

    Offsets are code points of the whole text, end exclusive. Null and empty
    texts have no span. Tokens without a digit or @ are `none` by construction,
    so only the others are nodes. A row per row of `docs`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in slices(batches, most=1_000_000):
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                own = [(i, g) for i, t in enumerate(texts) if _MARK.search(t) and (g := graph(t, base[i])).spans]
                every = [list(b) for b in base]
                if own:
                    p = marginals(f, [g for _, g in own])
                    start = 0
                    for i, g in own:
                        every[i] += added_spans(texts[i], g, p[start : start + len(g.spans)], sure)
                        start += len(g.spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([joined(b) for b in base], pa.string()), pa.array([joined(e) for e in every], pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, base string, spans string")
