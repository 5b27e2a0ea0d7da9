"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualispark.llm.common import mix, slices, text_buffer

#: Labelled rows that a model is fitted on, at most, and how many of them are landmarks.
FIT_ROWS = 2000
LANDMARKS = 128
LONGEST = 4
#: n-grams are numbered by hashes of so many bits: two that collide count as one, in texts and landmarks alike.
BITS = 16
#: Texts whose kernel values are one matrix product.
BATCH = 128
RIDGE = 1e-3
_LETTER = regex.compile(r"\p{L}")


def spectrum(data: np.ndarray, a: int, b: int, hashed: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """Ids of the distinct n-grams of bytes a to b (the presence features), n from 1 up."""
    codes = np.concatenate([h[a : max(a, b - n)] for n, h in enumerate(hashed)])
    seen[codes] = True
    ids = np.flatnonzero(seen)
    seen[ids] = False
    return ids


def gram_codes(data: np.ndarray, longest: int, bits: int) -> list[np.ndarray]:
    """For each n the code of the n-gram at every byte; n-grams over a text's end are cut off by `spectrum`."""
    folded = data.copy()
    upper = (folded >= 65) & (folded <= 90)
    folded[upper] += 32
    digits = (folded >= 48) & (folded <= 57)
    folded[digits] = 48
    out, value = [], folded.astype(np.uint32)
    for n in range(1, longest + 1):
        if n > 1:
            value = (value[:-1] << np.uint32(8)) | folded[n - 1 :] if len(value) else value
        code = (value * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - bits)
        out.append(code)
    return out


@dataclass
class Model:
    """Landmark presence rows as a matrix over n-gram ids, and what maps kernel values to class scores."""

    languages: list[str]
    landmarks: np.ndarray  # (ids, landmarks) of 0/1
    sizes: np.ndarray
    weights: np.ndarray  # (landmarks, classes)
    offset: np.ndarray
    longest: int
    bits: int
    _used: np.ndarray | None = None

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel values of texts against the landmarks: shared n-grams over the geometric mean of the set sizes.

        Shared n-grams of a batch of texts are one product of its presence matrix,
        over the n-grams that the batch and any landmark have, with the landmarks'.
        """
        shared = np.zeros((len(sets), self.landmarks.shape[1]), dtype=np.float32)
        column = np.full(len(self.landmarks), -1)
        for at in range(0, len(sets), BATCH):
            batch = sets[at : at + BATCH]
            ids = np.concatenate(batch)
            row = np.repeat(np.arange(len(batch)), [len(s) for s in batch])
            use = self.used[ids]
            ids, row = ids[use], row[use]
            distinct = np.unique(ids)
            column[distinct] = np.arange(len(distinct))
            presence = np.zeros((len(batch), len(distinct)), dtype=np.float32)
            presence[row, column[ids]] = 1
            shared[at : at + BATCH] = presence @ self.landmarks[distinct]
        counts = np.array([max(1, len(s)) for s in sets], dtype=np.float64)
        return shared / np.sqrt(counts[:, None] * self.sizes[None, :])

    @property
    def used(self) -> np.ndarray:
        """Which n-grams any landmark has."""
        if self._used is None:
            self._used = self.landmarks.any(axis=1)
        return self._used

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights + self.offset


def _sets(texts: pa.Array, longest: int, bits: int) -> list[np.ndarray]:
    data, offsets = text_buffer(texts)
    hashed = gram_codes(data, longest, bits)
    seen = np.zeros(1 << bits, dtype=bool)
    return [spectrum(data, a, b, hashed, seen) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def fit(texts: list[str], languages: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE, longest: int = LONGEST, bits: int = BITS) -> Model | None:
    """One-versus-rest kernel ridge regression in the Nyström features of evenly dealt landmarks; None without labels."""
    known = sorted(set(languages))
    if not known:
        return None
    sets = _sets(pa.array(texts, pa.large_string()), longest, bits)
    by = {k: [i for i, x in enumerate(languages) if x == k] for k in known}
    share = max(1, landmarks // len(known))
    chosen = sorted(i for k in known for i in sorted(by[k], key=lambda i: (-len(sets[i]), i))[: 4 * share][:: max(1, min(4, len(by[k]) // share))][:share])
    matrix = np.zeros((1 << bits, len(chosen)), dtype=np.float32)
    for c, i in enumerate(chosen):
        matrix[sets[i], c] = 1
    model = Model(known, matrix, np.array([max(1, len(sets[i])) for i in chosen], dtype=np.float64), np.zeros((len(chosen), len(known))), np.zeros(len(known)), longest, bits)
    kernel = model.kernel(sets)
    values, vectors = np.linalg.eigh(model.kernel([sets[i] for i in chosen]))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel values times this are the Nyström features
    features = kernel @ root
    target = np.where(np.array(languages)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    mean, level = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]), centred.T @ (target - level))
    model.weights = root @ solved
    model.offset = level - mean @ solved
    return model


def sample_labelled(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, chars: int = 20000) -> tuple[list[str], list[str]]:
    """At most `fit_rows` labelled texts, those of smallest hash. Texts of over `chars` characters are not fitted on (they are scored whole)."""
    rows = (
        docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) <= chars))
        .select(F.xxhash64(F.col(doc_id), F.lit(5)).alias("h"), F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    )
    total = rows.count()
    share = min(1.0, 1.2 * fit_rows / max(1, total))
    cut = int(share * (1 << 30))
    found = rows.where(F.pmod("h", F.lit(1 << 30)) < cut).orderBy("h", "i").limit(fit_rows).collect()
    return [r["t"] for r in found], [r["l"] for r in found]


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score of every whole text.

    `score` is the share of the winning class in a softmax of the class scores,
    0 to 1. Null texts and texts without a letter, and all texts without a model:
    `und` and 0. Ties go to the language first in order. All other columns stay;
    columns of the names lang_pred and score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, text, most=1_000_000):
            texts = part.column(part.schema.names.index(text))
            has = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
            names, score = np.full(len(has), "und", dtype=object), np.zeros(len(has))
            if m is not None and has.any():
                got = m.scores(_sets(texts.filter(pa.array(has)), m.longest, m.bits))
                weight = np.exp(4 * (got - got.max(axis=1, keepdims=True)))
                names[has] = np.array(m.languages, dtype=object)[got.argmax(axis=1)]
                score[has] = 1 / weight.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], schema.names)

    return kept.mapInArrow(run, schema)
