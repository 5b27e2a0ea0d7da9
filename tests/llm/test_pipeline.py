"""The stages on a small corpus: what each must drop and keep."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from qualispark.llm.queries import oracle_sql, queries

WORDS = "the of and to in is was for that with on as by at from his her they be this".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "est", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(rng, 40)
    texts = [prose(rng, 80) for _ in range(40)]
    clean = len(texts)
    texts += [texts[0], texts[0] + " more", "1234 !!", None, prose(rng, 30) + " " + item.upper() + " " + prose(rng, 30)]
    texts += [f"footer of all sites\n{prose(rng, 60)}" for _ in range(9)]
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), clean


def test_stages(spark, corpus, tmp_path):
    folder, clean = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(range(54)) - set(kept["language_id"]) == {clean + 2, clean + 3}
    texts = [r.text for i, r in kept["line_dedup"].items() if i >= clean + 5]
    assert sum("footer" in t for t in texts) == 1 and all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["line_dedup"]) - set(kept["minhash_dedup"]) == {clean, clean + 1}
    assert set(kept["minhash_dedup"]) - set(kept["decontaminate"]) == {clean + 4}
    assert set(kept["sentencepiece"]) == set(kept["decontaminate"]) >= set(range(clean))
    assert all(r.round_trip and len(r.piece_ids) == r.n_pieces for r in kept["sentencepiece"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(kept["sentencepiece"])


def plain_pipeline(rows, items):
    """All stages on small input in plain Python: {doc_id: text} of the rows that reach the encoder, one labelled language given."""
    docs = {i: (t, source) for i, t, _, source, _ in rows if t is not None and any(c.isalpha() for c in t)}
    sites, first = {}, {}
    for i in sorted(docs):
        t, source = docs[i]
        for line in t.split("\n"):
            if line.strip(" ") and source is not None:
                sites.setdefault(line, set()).add(source)
                first.setdefault(line, i)
    texts = {}
    for i, (t, _) in docs.items():
        seen, kept, removed = set(), [], 0
        for line in t.split("\n"):
            if len(sites.get(line, ())) >= 5 and (first[line] != i or line in seen):
                removed += 1
            else:
                kept.append(line)
            seen.add(line)
        if not removed or "".join(kept).strip(" "):
            texts[i] = "\n".join(kept)
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = {i: new if r == old else r for i, r in root.items()}
    texts = {i: t for i, t in texts.items() if root[i] == i}

    def within(item, text):
        row = [0] * (len(text) + 1)
        for k, p in enumerate(item, 1):
            last, row[0] = row[0], k
            for j, c in enumerate(text, 1):
                last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
        return min(row) <= len(item) // 20

    clean = lambda t: " ".join(t.lower().split())
    return {i: t for i, t in texts.items() if not any(within(clean(x), clean(t)) for x in items)}


def test_all_rows_equal_brute_force(spark, tmp_path):
    import sentencepiece

    from qualispark.llm.pieces import MODEL

    rng = random.Random(44)
    item = prose(rng, 12)
    texts = [prose(rng, rng.randrange(3, 60)) for _ in range(30)]
    texts += [texts[0], texts[1] + " x", "12 34", None, "", prose(rng, 9) + "  " + item.replace("e", "3", 2).upper() + " end", item]
    texts += [f"all sites say this\n{prose(rng, 8)}\nall sites say this" for _ in range(7)] + ["all sites say this"]
    rows = [(100 - 2 * i, t, "en", f"s{i % 6}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = plain_pipeline(rows, [item])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 20 < len(expected) < len(rows) - 5
    assert {i: r.piece_ids for i, r in got.items()} == {i: library.encode(t) for i, t in expected.items()}
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got.values())


def test_stages_on_odd_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(45)
    text = prose(rng, 30)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", None, 1), (None, text, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "c", 0), (5, "z" * 40_000, "en", "c", 1)]
    odd = spark.createDataFrame(rows, kinds).select("*", *[F.lit(7).alias(c) for c in ("kept", "matches", "score", "lines_removed", "_gone", "decoded")])
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        ids[name] = sorted((r.doc_id for r in stage(spark, odd, str(tmp_path)).collect()), key=str)
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    every = [1, 1, 2, 3, 4, 5, None]
    assert ids == {"language_id": [1, 1, 2, 5, None], "line_dedup": every, "minhash_dedup": [1, 1, 3, 4, 5, None], "decontaminate": every, "sentencepiece": every}


def test_registry():
    names = queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
