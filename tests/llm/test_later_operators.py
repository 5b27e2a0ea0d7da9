"""Merkle manifest, hard negatives and the tokenization automaton against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from qualispark.llm import minhash, queries
from qualispark.llm.automaton import MODEL, Automaton, Encoder, decode_bpe, encode_bpe
from qualispark.llm.common import components
from qualispark.llm.merkle import fold, leaf_hash, merkle_manifest, siblings_hash
from qualispark.llm.negatives import HIGH, LOW, hard_negatives, products, whole_components

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows, fanout=2):
    """Rows of (doc_id, source, lang, n_chars, text) by plain recursion."""
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(trees[g], key=lambda x: x[:3]) for g in names}
    built = {g: levels([x[2] for x in trees[g]]) for g in names}
    crown = levels([built[g][-1][0] for g in names])
    for place, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(trees[g]):
            sides = []
            for tree, at in ((built[g], i), (crown, place)):
                for nodes in tree[:-1]:
                    first = at // fanout * fanout
                    sides.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
                    at //= fanout
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if changed else own
            for before, after in sides:
                folded = digest(before + folded + after)
            yield r[0], own, built[g][-1][0], crown[-1][0], digest("".join(a + b for a, b in sides)), folded, folded == crown[-1][0]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize(("fanout", "levels"), [(2, 0), (2, 2), (3, 1), (2, 10)])
def test_merkle_equals_recursion(spark, fanout, levels):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "a", "é"]), rng.choice([None, "de", "en", "é", "zz"]), rng.choice([None, 3]), rng.choice(["x", "y\n", "", None])) for _ in range(90)]
    rows += [(i, "s", "big", 1, "t" * (20_000 if i == 5 else 1)) for i in range(45)] + [(1, "s", "one", 1, "t")] + [(7, "s", "big", 1, "twice")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = df.select("doc_id", "lang", leaf_hash("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), F.when(tampered, leaf_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text")).alias("block"), F.lit(1).alias("_g"), F.lit(2).alias("sides"))
    tree = merkle_manifest(leaves, carry=("block",), fanout=fanout, levels=levels)
    got = tree.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("sides")), fold(F.coalesce("block", "leaf"), F.col("sides")).alias("f"), F.col("f") == F.col("root"))
    assert ordered(got.collect()) == ordered(manifest(rows, fanout))


def test_merkle_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, None, "a")], "doc_id long, lang string, leaf string")
    assert merkle_manifest(df.limit(0)).count() == 0
    r = merkle_manifest(df).first()
    assert (r.subroot, r.root, r.sides) == ("a", "a", [])


def mined(rows, anchors, positives=5, negatives=5):
    """Rows of (id, label, vector) by plain loops."""
    ok = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])
    whole = lambda v: [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]
    rows, anchors = ([(i, g, whole(v)) for i, g, v in filter(ok, t)] for t in (rows, anchors))
    for a, g, v in anchors:
        near = sorted(((-max(min(sum(x * y for x, y in zip(v, w, strict=True)), HIGH), LOW), i, h) for i, h, w in rows if len(w) == len(v)))
        for p, i, _ in [x for x in near if x[2] == g and x[1] != a][:positives]:
            band = [x for x in near if x[2] != g and -80 * p <= -100 * x[0] <= -100 * p][:negatives]
            for rank, (n, j, _) in enumerate(band, 1):
                yield a, i, rank, j, -p, -n


def test_hard_negatives_equal_loops(spark):
    rng = random.Random(8)
    vector = lambda n: [rng.choice([0.5, 0.25, rng.random(), -0.1]) for _ in range(n)]
    rows = [(i, rng.choice([None, 0, 1, 1, 1, 2]), vector(6)) for i in range(200)]
    rows += [(300 + i, i % 2, vector(3)) for i in range(20)] + [(400, 1, []), (401, 0, []), (500, 1, None), (501, 1, [0.1, None]), (502, 1, [float("nan")] * 6), (503, 1, [float("inf")] * 6), (None, 1, vector(6))]
    rows += [rows[100], rows[7], (600, 2, [0.5] * 6), (601, 0, [0.5] * 6), (602, 2, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0)).repartition(6)
    got = hard_negatives(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0]))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives(df.limit(0), df).count() == 0 and hard_negatives(df, df.limit(0)).count() == 0


def test_hard_negatives_in_blocks_and_beyond_64_bits(spark, monkeypatch):
    monkeypatch.setattr("qualispark.llm.negatives.ANCHOR_BYTES", 500)
    rows = [(i, i % 3, [math.sin(i * k + 1) * (1e200 if i % 10 == 0 else 1e9) for k in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = hard_negatives(df, df.where("vec_id % 7 = 0"), positives=2, negatives=3)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, rows[::7], 2, 3))


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (0.01, 1, 1 << 24, 1 << 45, 10**80):
        a, c = (whole_components(rng.normal(size=(n, 9)) * float(size)) for n in (7, 23))
        wanted = np.clip(np.dot(a.astype(object), c.astype(object).T), LOW, HIGH).astype(np.int64)
        assert (products(a, c) == wanted).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def test_automaton_equals_merging():
    """On small alphabets, where pairs overlap and repeat."""
    rng = random.Random(2)
    for _ in range(40):
        labels, merges, used = [bytes([b]) for b in range(256)], [], set()
        while len(merges) < 12:
            a, b = (rng.choice([97, 98, 99, *range(256, len(labels))]) for _ in range(2))
            if (joined := labels[a] + labels[b]) not in used and len(joined) < 12:
                used.add(joined)
                merges.append((a, b, len(labels)))
                labels.append(joined)
        automaton = Automaton(labels, merges)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24))) for _ in range(60)]
        for word, side in zip(words, automaton.encode_many(words, 32), strict=True):
            parts = list(word)
            for a, b, ab in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [ab]
                    i += 1
            assert automaton.encode(word) == parts == list(side)


def test_automaton_refuses_odd_vocabularies():
    labels = [bytes([b]) for b in range(256)]
    for more, merges in (([b"aa", b"aaa"], [(256, 97, 257)]), ([b"ab", b"abc", b"bc"], [(97, 98, 256), (98, 99, 258), (256, 99, 257), (97, 258, 257)])):
        with pytest.raises(ValueError, match="merge"):
            Automaton(labels + more, merges)
    with pytest.raises(ValueError, match="every byte"):
        Automaton(labels[:-1], [])


def test_automaton_equals_the_library(spark, library):
    rng = random.Random(5)
    some = ["a", "b", "the", "ing", "ation", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "中文字", "🙂", "!!", "----", "<|endoftext|>", "<|endof", "\u0085", " ", "\x1c", "՘", "　", "꟒", "\U00010940", "\0"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(2000)]
    texts += ["".join(chr(rng.randrange(0x20, 0xD800)) for _ in range(20)) for _ in range(300)] + ["".join(chr(rng.randrange(0xE000, 0x110000)) for _ in range(20)) for _ in range(300)]
    texts += ["中" * 30_000, "a" * 30_000, "ab cd " * 9_000, None, "", " ", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token_ids", F.lit("replaced")).withColumn("n", F.lit(1)).repartition(3)
    encoded = encode_bpe(df, decoded="back")
    got = {r.doc_id: r for r in decode_bpe(encoded).collect()}
    assert len(got) == len(texts) and encoded.columns == ["doc_id", "text", "n", "token_ids", "back"]
    for i, t in enumerate(texts):
        if t is None:
            assert (got[i].token_ids, got[i].back, got[i].decoded) == (None, None, None)
        else:
            assert got[i].token_ids == library.encode(t, add_special_tokens=False).ids, repr(t)
            assert got[i].back == got[i].decoded == library.decode(got[i].token_ids, skip_special_tokens=False)
    assert encode_bpe(df.limit(0)).count() == 0
    odd = spark.createDataFrame([([50256, 128],), ([],), (None,)], "token_ids array<int>")
    assert [r.decoded for r in decode_bpe(odd).collect()] == [library.decode([50256, 128], skip_special_tokens=False), "", None]


def test_words_are_forgotten_by_bytes(monkeypatch):
    encoder = Encoder()
    monkeypatch.setattr("qualispark.llm.automaton.REMEMBERED", 10_000)
    words = [f" w{i}x" for i in range(3000)]
    for at in range(0, 3000, 30):
        encoder.encode(["".join(words[at : at + 30])])
    assert len(encoder.known) + len(encoder.older) < 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert ordered(got.select(*names).collect()) == ordered(expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bpe_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_bpe_automaton(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_boilerplate_in_proportion_to_lines(spark):
    from qualispark.llm.line_dedup import remove_boilerplate

    lines = [f"line {i}" for i in range(4000)]
    rows = [(d, f"s{d}", "\n".join([*lines, "", f"own {d}", *lines[:5]])) for d in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in remove_boilerplate(df).collect()}
    assert got[0].text == "\n".join([*lines, "", "own 0"]) and got[0].lines_removed == 5
    assert all(got[d].text == f"\nown {d}" and (got[d].lines_total, got[d].lines_removed) == (4007, 4005) for d in range(1, 6))


def test_benchmark_in_blocks_with_clashing_names(spark):
    from qualispark.llm.decontaminate import contaminated

    items = spark.createDataFrame([(i, f"the quick brown fox number {i} jumps over the lazy dog {i * 7919}") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + (f"the quick brown fox number {i} jumps over the lazy dog {i * 7919}" if i < 3 else "nothing"), "k", "s") for i in range(5)] + [(9, None, "k", "s")], "doc_id long, text string, _key string, _key_ string")
    for chars in (60, 10**6):
        got = contaminated(docs, items, block_chars=chars)
        assert got.columns == ["doc_id", "text", "_key", "_key_", "matches"]
        assert {r.doc_id: [m.item_id for m in r.matches if m.distance == 0] for r in got.collect()} == {0: [0], 1: [1], 2: [2], 3: [], 4: [], 9: []}


def test_long_spans_are_cut_where_no_piece_crosses(monkeypatch):
    import time

    import sentencepiece

    from qualispark.llm import pieces

    library, own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder()
    rng = random.Random(3)
    common = sorted(p for p in own.ids if "一" <= p[0] <= "鿿")
    began = time.time()
    text = "".join(rng.choice(common) for _ in range(333_000))
    assert own.encode([text])[0] == library.encode(text) and time.time() - began < 20
    monkeypatch.setattr(pieces, "REMEMBERED", 100_000)
    for _ in range(40):
        texts = ["".join(rng.choice([*common, "a", "the", " ", "   ", "\n", "é", "🙂", "ing", "=", "1"]) for _ in range(rng.randrange(400))) for _ in range(20)]
        assert own.encode(texts) == [library.encode(t) for t in texts]
    assert own.held < 1_000_000


def test_weight_of_repeats_is_learnt():
    from qualispark.llm import pii

    labels = np.array([1, 1, 2, 2, 0, 0] * 40 + [1, 2] * 60)
    alike = np.array([(i, i + 1) for i in range(0, 240, 2)])
    unlike = np.array([(i, i + 1) for i in range(240, 360, 2)])
    weight = lambda pairs: float(pii._agreement(pairs, labels)[0, 0])
    assert weight(alike[:0]) == pii.BELIEF
    assert 5 < weight(alike) and weight(np.concatenate([alike, unlike])) < 3 and weight(unlike) < 0
    assert weight(np.concatenate([alike, unlike[:1]])) < weight(alike)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_stars_and_chains(spark, seed):
    rng = np.random.default_rng(seed)
    star = [(5, 10_000 + i) for i in range(3000)]  # one vertex with most of all edges
    chain = [(50_000 + i, 50_001 + i) for i in range(40)]
    loose = [(int(a), int(b)) for a, b in rng.integers(20_000, 20_400, (260, 2))]
    tied = [(10_007, 20_000), (60_000, 60_000), (10_007, 20_000)]  # the star meets the rest; a loop and a repeated edge
    edges = star + chain + loose + tied
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    alone = {v for v in root if all(a == b or v not in (a, b) for a, b in edges)}
    assert got == {v: find(v) for v in root if v not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_table_keys_take_another_way_with_the_same_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i in range(80) for k in [rng.randrange(120)]]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(40)]
    size = minhash.collection_size(0.85)
    signed = minhash.checkpoint(minhash._tables(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, size, minhash.ROWS))
    assert len(minhash._hot_keys(signed, size, len(rows))) > 10
    split = sorted(minhash._led(signed, size, len(rows)).collect())
    monkeypatch.setattr(minhash, "HOT_LEAST", 10_000)
    assert len(minhash._hot_keys(signed, size, len(rows))) == 0
    assert split == sorted(minhash._led(signed, size, len(rows)).collect())
    assert {x for x, _ in split} == set(range(1, 80))
