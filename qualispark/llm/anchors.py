"""Content anchors of byte windows: equal windows have equal anchors at equal distances."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from qualispark.llm.common import _P, mix, powers

_VALUES = np.random.default_rng(77).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of bytes follows."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return total


def run_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end)."""
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_P))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least value in [i, i + width), the leftmost if several agree in their leading bits.

    The low bits of the values give way to the place, so that one running
    minimum finds both.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    bits = np.uint64(max(20, len(values).bit_length()))
    low = (values >> bits) << bits | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[span:], low[:-span])
        span *= 2
    shift = width - span
    if shift:
        low = np.minimum(low[shift : shift + n], low[:n])
    return (low[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def spans(data: np.ndarray, offsets: np.ndarray, length: int, grain: int, digest: bool = True) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` bytes with one anchor: (text, first window, last window, anchor hash, digest of all their bytes as two numbers).

    The anchor of a window is its leftmost run of `grain` bytes of least hash.
    Window places count from the text's first byte; no window crosses texts.
    Runs whose anchors collide only meet in one group; that runs are equal rests
    on a 128-bit digest of their bytes, which is zero unless asked for.
    """
    total = prefix_sums(data)
    n = len(data)
    if n < length:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    at = np.arange(n - grain + 1)
    grains = run_hashes(total, at, at + grain)
    anchor = sliding_argmin(grains, length - grain + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.arange(len(anchor))
    inside = start + length <= offsets[1:][text]
    start, text, anchor = start[inside], text[inside], anchor[inside]
    if not len(start):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b, t = start[first], start[last], text[first]
    return t, a - offsets[:-1][t], b - offsets[:-1][t], grains[anchor[first]], *(digests(data, a, b + length) if digest else (np.zeros(len(a), dtype=np.int64),) * 2)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each run of bytes [start, end), as two columns of numbers."""
    raw = data.tobytes()
    joined = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]
