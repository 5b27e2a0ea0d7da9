"""The corpus operators against brute force, and on empty, null, long and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualispark.llm.chat import expand_conversations, read_loss, read_turns
from qualispark.llm.decontaminate import contaminated, distance, masks, normalise, pieces
from qualispark.llm.forest import near_vectors
from qualispark.llm.interpolation import score_texts
from qualispark.llm.language import fit, identify
from qualispark.llm.line_dedup import remove_boilerplate
from qualispark.llm.minhash import _verified, collection_size, near_duplicates
from qualispark.llm.pieces import MODEL, Encoder, decode_documents, encode_documents
from qualispark.llm.pii import FEATURES, Field, _feature, added_spans, base_spans, find_personal_data, graph, marginals, train
from qualispark.llm.suffixes import difference_cover, remove_repeats, repeated

WORDS = "the of and to in is was for that with on as by at from his her they be this".split()
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "est"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = texts[7].split()
    texts += [None, "", "   ", "\n", "x", texts[3], texts[3], " ".join([*near[:30], "changed", *near[31:]]), prose(rng, 9000), "É🙂 " * 50]
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + "\n" + passage + "\nlast line " + str(i) for i in range(8)]
    return [(i * 3, t, "en", f"s{i % 7}", 0, "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("order", [2, 3])
def test_interpolation_base_is_exact_and_the_mixture_helps(spark, docs, rows, order):
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    got = {r.doc_id: r for r in score_texts(marked, order=order, block_bytes=9000, held_out_of=3).collect()}
    learnt = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(t for i, text, *_ in rows if i in learnt for t in [*tokens(text), None])
    total = sum(counts.values())
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        own = [*tokens(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert math.isfinite(got[i].score) and got[i].score < 0
    assert sum(got[i].score for i in learnt) > sum(got[i].base_score for i in learnt)


def test_interpolation_does_not_depend_on_blocks(docs, empty):
    marked = docs.withColumn("train", F.lit(True))
    one, many = ({r.doc_id: r.score for r in score_texts(marked, block_bytes=b).collect()} for b in (10**9, 5000))
    assert all(one[i] == pytest.approx(many[i], rel=1e-9) for i in one)
    assert score_texts(empty.withColumn("train", F.lit(True))).count() == 0
    assert score_texts(docs.withColumn("train", F.lit(None).cast("boolean"))).where("n_known > 0").count() == 0


def test_the_mixture_equals_a_plain_one(docs, rows):
    """Deleted interpolation in plain Python, with counts and ratios as they are rather than binned."""
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    held = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).select("doc_id").collect()}
    learnt = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    grams = {i: [tuple(own[k + 3 - n : k + 3]) for k in range(len(own) - 2) for n in (1, 2, 3)] for i, t, *_ in rows for own in [["<s>", "<s>", *tokens(t), None]]}
    every, kept = (Counter(g for i in ids for g in grams[i]) for ids in (learnt, learnt - held))
    distinct = {k: len({g for g in c if len(g) == 1}) for k, c in (("every", every), ("kept", kept))}

    def estimates(gram, counts, types):
        total = sum(v for g, v in counts.items() if len(g) == 1)
        ends = counts[(None,)]
        out, length, octave = [1 / (types + 1), counts[gram[-1:]] / max(1, total)], 0, 0
        for n in (2, 3):
            before = gram[3 - n : 2]
            c = ends if set(before) == {"<s>"} else counts[before]
            out.append(counts[gram[3 - n :]] / c if c else 0.0)
            if c:
                length, octave = n - 1, int(math.log2(c))
        return out, (length, octave)

    seen = defaultdict(list)
    for i in learnt & held:
        for gram in grams[i][2::3]:
            p, bucket = estimates(gram, kept, distinct["kept"])
            seen[bucket].append(p)
    weights = {}
    for (length, octave), ps in seen.items():
        p, w = np.array(ps), np.array([1 / (length + 2) if k < length + 2 else 0.0 for k in range(4)])
        for _ in range(60):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) / len(p)
        weights[length, octave] = (len(p), w)
    pooled = sum((n * w for n, w in weights.values()), np.full(4, 1.0))
    got = {r.doc_id: r.score for r in score_texts(marked, order=3, held_out_of=3, block_bytes=9000, steps=128).collect()}
    for i, *_ in rows:
        score = 0.0
        for gram in grams[i][2::3]:
            p, (length, octave) = estimates(gram, every, distinct["every"])
            prior = np.where(np.arange(4) < length + 2, pooled, 0)
            prior = 0.999 * prior / prior.sum() + np.where(np.arange(4) < length + 2, 0.001 / (length + 2), 0)
            n, w = weights.get((length, octave), (0, prior))
            score += math.log10(np.dot(p, (n * w + 5 * prior) / (n + 5)))
        assert got[i] == pytest.approx(score, rel=5e-3)


def thue_morse(n, a, b):
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


def test_words_that_mirror_each_other_stay_apart(spark):
    texts = [" ".join(thue_morse(n, *ab) for n in (1024, 4096)) for ab in ("ab", "ba")]
    texts += [f"{texts[0]} {x} y z" for x in "uv"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(df.withColumn("train", F.col("doc_id") != 1), order=3).collect()}
    assert (got[0].n_known, got[1].n_known) == (3, 1)
    near = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert all(r.kept and r.n_shingles == 1 for r in near.values())


def test_the_scoring_query_reads_trigrams(spark, docs, tmp_path):
    from qualispark.llm.queries import op1_lm_score

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in op1_lm_score(spark, str(tmp_path)).collect()}
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    two, three = ({r.doc_id: r.score for r in score_texts(marked, order=n).collect()} for n in (2, 3))
    assert all(got[i] == pytest.approx(three[i], rel=1e-9) for i in three)
    assert any(got[i] != pytest.approx(two[i], rel=1e-3) for i in two)


@pytest.mark.skipif(not __import__("os").path.exists(MODEL), reason="no vocabulary")
def test_pieces_equal_the_library_and_go_round(docs, empty):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    letters = list("abcdeth  \n\t▁é你🙂<0x>/.,THE ing\x00")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)] + ["", " ", " " * 40 + "x", "a" * 3000, " " * 100_000, "x" + " " * 50_001 + "y z", "\n" * 9000 + "=-" * 500]
    encoder = Encoder()
    got = encoder.encode(texts)
    assert got == [reference.encode(t) for t in texts]
    assert [encoder.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]
    out = decode_documents(encode_documents(docs)).collect()
    assert all(r.decoded == r.text for r in out) and any(r.piece_ids is None for r in out)
    assert encode_documents(empty, decoded="d").count() == 0


def test_lines(spark, docs, empty):
    got = {r.doc_id: r for r in remove_boilerplate(docs, min_sites=5).collect()}
    source = {r.doc_id: r for r in docs.collect()}
    sites = defaultdict(set)
    first = {}
    for i in sorted(source):
        for line in (source[i].text or "").split("\n"):
            if line.strip(" "):
                sites[line].add(source[i].source)
                first.setdefault(line, i)
    for i, r in source.items():
        seen, kept = set(), []
        for line in (r.text or "").split("\n"):
            spread = line.strip(" ") != "" and len(sites[line]) >= 5
            if not spread or (first[line] == i and line not in seen):
                kept.append(line)
            seen.add(line)
        assert (got[i].text or "") == "\n".join(kept)
        assert got[i].note == "n"
    assert sum(r.lines_removed for r in got.values()) > 0
    assert remove_boilerplate(empty).count() == 0
    odd = spark.createDataFrame([(None, "a\nb", "en", None, 0, ""), (1, "a\nb", "en", None, 0, "")], SCHEMA)
    assert {r.text for r in remove_boilerplate(odd, min_sites=1).collect()} == {"a\nb"}


def test_sketches_and_exact_counts_agree(spark):
    rows = [(i, f"line {n}", "en", f"site{i % n}", 0, "") for n in range(1, 40) for i in range(n * 1000, n * 1000 + n)]
    df = spark.createDataFrame(rows, SCHEMA)
    removed = {r.text.split()[-1] for r in df.join(remove_boilerplate(df, min_sites=20, lg_k=6, band=0.6).where("lines_removed > 0").select("doc_id"), "doc_id").collect()}
    assert removed == {str(n) for n in range(20, 40)}


def shingles(text, width=5):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, percent):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, rows, empty, percent):
    rng = random.Random(9)
    base = prose(rng, 150).split()
    more = []
    for k in range(60):  # a chain of copies with one to four changes, few of which are near the first one
        copy = list(base)
        for _ in range(1 + k % 4):
            copy[rng.randrange(150)] = f"edit{k}"
        more.append((1000 + k, " ".join(copy), "en", "s", 0, ""))
    every = [*rows, *more]
    sets, expected = linked(every, percent)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(every, SCHEMA).repartition(4), percent=percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in sets}
    assert near_duplicates(empty).count() == 0


def test_a_leader_of_many_is_verified_in_chunks(spark):
    sets = spark.createDataFrame([(i, list(range(i % 7, 20 + i % 7))) for i in range(60)], "id long, shingles array<long>")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 50)] + [(i, 51) for i in range(52, 60)], "x long, y long")
    for together in (4, 1000):
        got = sorted(tuple(r) for r in _verified(pairs, sets, together).select("x", "y", "inter", "n_x", "n_y").collect())
        assert got == [(x, y, 20 - abs(x % 7 - y % 7), 20, 20) for x, y in sorted((r.x, r.y) for r in pairs.collect())]


def test_collections_are_of_the_square_roots_size():
    m = collection_size(0.85)
    assert (1 - 0.85**3) ** m <= 2e-4 and m * m > 50


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(150):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        assert distance(len(p), masks(p), t) == edit(p, t)


def test_contamination(spark, empty):
    rng = random.Random(3)
    items = [prose(rng, 30) for _ in range(6)] + ["", None, "tiny"]
    texts = [prose(rng, 40)]
    for k, item in enumerate(items[:6]):
        limit = len(normalise(item)) // 20
        for errors in (0, limit, limit + 4):
            chars = list(item)
            for at in rng.sample(range(5, len(chars) - 5), errors):
                chars[at] = "#"
            texts.append(prose(rng, 15) + "\n " + "".join(chars).upper() + "  " + prose(rng, k))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "n") for i, t in enumerate([*texts, None, ""])], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, items[0])], "item_id long, text string")
    expected = {}
    for i, t in enumerate([*texts, "", ""]):
        found = [(k, edit(normalise(x), normalise(t))) for k, x in [*enumerate(items), (9, items[0])] if x]
        expected[i] = [(k, d) for k, d in found if d <= len(normalise(items[k % 9])) // 20]
    for block in (10**6, 300):
        got = {r.doc_id: [(m.item_id, m.distance) for m in r.matches] for r in contaminated(docs, bench, block_chars=block).collect()}
        assert got == expected
    assert sum(map(len, expected.values())) >= 12
    assert contaminated(empty, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).where("size(matches) > 0").count() == 0
    assert "".join(p for _, p in pieces("abcdefg", 2)) == "abcdefg"


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    made = [(centres[i % 40] + 0.03 * rng.normal(size=16) * (i % 3)) for i in range(600)]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 2)) for i, v in enumerate(made)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] * 16, 0), (704, rows[0][1], None), (705, [1.0], 0), (706, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    v = np.array([r[1] for r in rows[:600]] + [rows[0][1]])
    label = np.array([r[2] for r in rows[:600]] + [0])
    n = np.linalg.norm(v, axis=1)
    near = ((v @ v.T) / (n[:, None] * n[None, :]) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    for block, leaf, fit, routed in ((4096, 200, 8192, 20000), (16, 60, 120, 50)):
        got = {r.vec_id: r for r in near_vectors(df, block=block, leaf_rows=leaf, fit_rows=fit, routed=routed).collect()}
        found = sum(got[i].n_links for i in [*range(600), 706])
        assert found <= near.sum() and found >= 0.99 * near.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in (700, 701, 702, 703, 704, 705))
        assert got[706].component_id == got[0].component_id
    assert near_vectors(df.limit(0)).count() == 0


def test_forest_links_vectors_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", rng.normal(size=16).tolist()) for i in range(40)]
    short = [rng.normal(size=8) for _ in range(10)]
    rows += [(100 + i, "a", v.tolist()) for i, v in enumerate(short)]
    rows += [(400, "a", [1e-200, 0.0, 0.0]), (401, "a", [2e-200, 0.0, 0.0]), (402, "a", [1e200, 1e200, 0.0]), (403, "a", [1e200, 1.0001e200, 0.0]), (404, "c", [1.0, 2.0]), (405, "c", [1.0, 2.0])]
    rows += [(200, "a", short[0].tolist()), (201, "a", (short[1] * 3 + 1e-3).tolist()), (202, "b", short[2].tolist()), (300, "a", [1.0, 2.0, 3.0])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.n_links} == {100, 200, 101, 201, *range(400, 406)}
    assert [(got[i].component_id, got[i].kept) for i in (200, 201)] == [(100, False), (101, False)]


def test_difference_cover_and_sorted_repeats():
    for period in (16, 64, 133):
        cover, shift = difference_cover(period)
        inside = set(cover.tolist())
        assert all((i + shift[i, j]) % period in inside and (j + shift[i, j]) % period in inside for i in range(period) for j in range(period))
    rng = np.random.default_rng(8)
    for length in (200, 130):
        part = rng.integers(97, 99, 700).astype(np.uint8)
        data = np.concatenate([part, part[100:500], rng.integers(97, 99, 300).astype(np.uint8), part[90:430], np.full(500, 97, np.uint8)])
        places = np.arange(len(data) - length + 1)
        strings = [data[i : i + length].tobytes() for i in places]
        counts = Counter(strings)
        assert repeated(data, places, length).tolist() == [counts[s] > 1 for s in strings]


def test_suffixes(spark, rows, empty):
    every = [*rows, (9001, "ab" * 400, "en", "s", 0, ""), (9002, "é" * 300, "fr", "s", 0, "")]
    for chunk, kinds, hot in ((10**7, 10**4, 10**4), (5000, 3, 3)):
        got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(every, SCHEMA).repartition(4), bucket_bytes=20000, chunk=chunk, most_kinds=kinds, hot_spans=hot).collect()}
        seen = Counter(raw[k : k + 200] for _, t, *_ in every for raw in [(t or "").encode()] for k in range(len(raw) - 199))
        for i, t, *_ in every:
            raw = (t or "").encode()
            gone = bytearray(len(raw))
            for k in range(len(raw) - 199):
                if seen[raw[k : k + 200]] > 1:
                    gone[k : k + 200] = b"\1" * 200
            runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
            assert (got[i].n_bytes, got[i].n_removed, len(got[i].removed)) == (len(raw), sum(gone), runs)
            assert got[i].kept == bytes(b for b, g in zip(raw, gone) if not g)
    assert remove_repeats(empty).count() == 0


def test_chat(spark):
    odd = ["<|im_end|>", "\\<|", "a\\|b", "<\\|", "\\", "line\nline", "", None, "<", "<|im_start|>assistant\n"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\", None]), rng.choice(odd)) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (99, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = expand_conversations(df)
    out = made.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv_id, r.example)):
        by[r.conv_id].append(r)
    for c in {r[0] for r in rows} - {None}:
        own = [(r or "", x or "") for cc, _, r, x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in by[c][-1].turns] == own and by[c][-1].is_last
        assert "".join(r.loss for r in by[c]) == "".join(x for r, x in own if r == "assistant")
        replies = [k for k, (r, _) in enumerate(own) if r == "assistant"]
        assert [len(r.turns) - 1 for r in by[c]] == replies + ([len(own) - 1] if len(own) - 1 not in replies else [])
    assert None not in by and expand_conversations(df.limit(0)).count() == 0


def test_the_chat_query_equals_its_sql_on_backslashes(spark, tmp_path):
    import duckdb

    from qualispark.llm.queries import OP8_SQL, op8_chat_format

    rows = [(1, 0, "user", "a\\b<|c"), (1, 1, "assistant", "a\\b\\\\c<|im_end|>"), (2, 0, "assistant", "\\<|"), (2, 1, "sys\\tem", None), (3, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op8_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(OP8_SQL)
    names = [d[0] for d in expected.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(expected.fetchall())


def test_language(spark, empty):
    rng = random.Random(7)
    vocabulary = {"en": WORDS, "de": "der die und nicht ist zu ein für auf schön über straße".split(), "fr": "le la est pas où très été aux des une leçon".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randrange(5, 60))), k) for i, k in ((i, sorted(vocabulary)[i % 3]) for i in range(300))]
    model = fit([t for _, t, _ in rows[:150]], [k for _, _, k in rows[:150]], landmarks=24)
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "en"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[150:]) >= 145
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert identify(df, fit([], [])).where("lang_pred <> 'und'").count() == 0
    assert {r.lang_pred for r in identify(df, fit(["a b", "a b"], ["b", "a"])).where("doc_id < 9").collect()} == {"a"}  # ties
    assert identify(empty, model).count() == 0


def test_language_scores_equal_plain_ones(spark):
    """Kernel, landmark features and ridge regression from sets of n-grams, one pair at a time."""
    rng = random.Random(8)
    vocabulary = {"en": WORDS, "de": "der die und nicht ist zu ein für auf schön über straße".split()}
    rows = [(k, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randrange(3, 40)))) for k in ("en", "de") for _ in range(150)]
    texts, languages = [t for _, t in rows], [k for k, _ in rows]
    learnt = [*range(25), *range(150, 175)]
    model = fit([texts[i] for i in learnt], [languages[i] for i in learnt], landmarks=50)  # all are landmarks

    def spectrum(text):
        raw = bytes(48 if 48 <= c <= 57 else c for c in text.translate(LOWER).encode())
        return {raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)}

    sets = [spectrum(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    gram = np.array([[kernel(sets[i], sets[j]) for j in learnt] for i in learnt])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values[-1]
    features = np.array([[kernel(s, sets[j]) for j in learnt] for s in sets]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    target = np.array([[1.0 if x == k else -1.0 for k in ("de", "en")] for x in languages])[learnt]
    mean, level = features[learnt].mean(axis=0), target.mean(axis=0)
    centred = features[learnt] - mean
    solved = np.linalg.solve(centred.T @ centred + 1e-3 * len(learnt) * np.eye(centred.shape[1]), centred.T @ (target - level))
    scores = (features - mean) @ solved + level
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    for i, row in enumerate(scores):
        assert got[i].lang_pred == ("de", "en")[int(row.argmax())]
        assert got[i].score == pytest.approx(1 / np.exp(4 * (row - row.max())).sum(), abs=0.02)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def test_patterns_equal_plain_ones():
    rng = random.Random(11)
    bits = ["a@b.com", "@", "x.y@z-1.org_q@w.e", "1.2.3.4", "255.255.255.256", "1.2.3.4.5.6.7.8", "001.2.3.4", "4041894974608795", "4041-8949 7460-8795", "+1 (988) 555-2485", "+", "12 ", "-", " ", ".", "é", "🙂", "word", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("a" * 200_000 + "@") == [] and base_spans("7" * 200_000) == []


def test_field_carries_labels_and_leaves_others(spark, empty):
    rng = random.Random(13)
    phone = lambda: f"{rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}"
    texts = []
    for _ in range(200):
        p = phone()
        texts.append(f"word +1-{p} then {prose(rng, 6)} call {p} or id b{rng.randrange(10**6)} in {rng.randrange(1990, 2030)}")
    field = train([graph(t, base_spans(t)) for t in texts])
    probe = "say +1-321-555-9876 and later 321-555-9876 but not b777 in 2001"
    g = graph(probe, base_spans(probe))
    p = marginals(field, [g])
    assert p.shape == (len(g.spans), 5) and np.allclose(p.sum(axis=1), 1)
    alone = "later 321-555-9876 again"
    repeated_token = [i for i, (a, b) in enumerate(g.spans) if probe[a:b] == "321-555-9876"][0]
    single = graph(alone, [])
    assert p[repeated_token, 4] > marginals(field, [single])[0, 4]
    df = spark.createDataFrame([(1, probe), (2, None), (3, ""), (4, "no digits")], "doc_id long, text string")
    got = {r.doc_id: r for r in find_personal_data(df, field).collect()}
    assert got[1].base == "phone:4:19" and got[1].spans.startswith("phone:4:19")
    assert [got[i].spans for i in (2, 3, 4)] == ["", "", ""]
    assert find_personal_data(empty, field).count() == 0


def numbers(rng):
    """Texts with a phone, an e-mail address and a card that the patterns find, and numbers that are none of these."""
    out = []
    for k in range(300):
        p = f"{rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}"
        card = f"4{rng.randrange(10**14, 10**15)}"
        card += next(d for d in "0123456789" if plain_luhn(card + d))
        said = [f"ring +1-{p} now", f"mail joe.{k}@host{k % 9}.example.com please", f"pay {card} today", f"in {rng.randrange(1990, 2030)} the {rng.randrange(10**6, 10**7)} and b{rng.randrange(10**6)}"]
        out.append(" ".join(said[rng.randrange(4)] + " " + prose(rng, 5) for _ in range(3)))
    return out


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_every_far_repeat_in_another_form_is_added(spark):
    field = train([graph(t, base_spans(t)) for t in numbers(random.Random(17))])
    forms = [("ring +1-321-555-9876 now", "321-555-9876", "phone"), ("pay 4737097684299439 today", "4737.0976.8429.9439", "card"), ("mail joe.77@host1.example.com please", "joe.77@host1", "email"), ("at 233.233.171.252 then", "233-233-171-252", "ip")]
    for first, again, kind in forms:
        text = first + f" and later {again}" * 40
        base = base_spans(text)
        g = graph(text, base)
        assert [k for k, *_ in base] == [kind]
        assert [(k, text[a:b]) for k, a, b in added_spans(text, g, marginals(field, [g]))] == [(kind, again)] * 40
        lone = f"and later {again} of 743 and 1234567"
        g = graph(lone, base_spans(lone))
        assert all(k != "phone" for k, *_ in added_spans(lone, g, marginals(field, [g])))
    df = spark.createDataFrame([(1, forms[0][0] + " so 321-555-9876"), (1, forms[0][0])], "doc_id long, text string")
    got = sorted((r.doc_id, r.base, r.spans) for r in find_personal_data(df, field).collect())
    assert got == [(1, "phone:5:20", "phone:5:20"), (1, "phone:5:20", "phone:5:20,phone:28:40")]


def test_messages_give_the_marginals_of_small_graphs():
    """Against the sum over all labellings; what is observed cuts loops, so messages are exact here."""
    rng = np.random.default_rng(3)
    chain, skip = rng.normal(size=(5, 5)), np.eye(5) * 2.5
    chain = chain + chain.T
    weights = np.zeros((FEATURES, 5))
    weights[:] = rng.normal(size=(FEATURES, 5)) * 0.4
    field = Field(weights, chain, skip)
    text = "say +1-321-555-9876, 5551234567 x 321-555-9876, 17 y 321.555.9876"
    g = graph(text, base_spans(text))
    assert 4 <= len(g.spans) <= 6 and len(g.skips) > 2 and g.chain and sum(map(bool, g.labels)) == 1
    local = weights[np.array(g.features)].sum(axis=1)
    total = np.zeros((len(g.spans), 5))
    import itertools

    for labels in itertools.product(range(5), repeat=len(g.spans)):
        if any(seen and seen != got for seen, got in zip(g.labels, labels)):
            continue
        energy = sum(0 if seen else local[i, k] for i, (seen, k) in enumerate(zip(g.labels, labels)))
        energy += sum(chain[labels[a], labels[b]] for a, b in g.chain) + sum(skip[labels[a], labels[b]] for a, b in g.skips)
        for i, k in enumerate(labels):
            total[i, k] += math.exp(energy)
    assert np.allclose(marginals(field, [g]), total / total.sum(axis=1, keepdims=True), atol=1e-4)
    other = graph("call 555-1234567 or 1-555-1234567, 12 13", [])
    assert np.allclose(marginals(field, [other, g])[len(other.spans) :], marginals(field, [g]), atol=1e-6)


def test_hashes_do_not_collide():
    from qualispark.llm.common import text_buffer, word_hashes, words

    import pyarrow as pa

    texts = [f"w{i} W{i}" for i in range(20000)]
    data, offsets = text_buffer(pa.array(texts))
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends).reshape(-1, 2)
    assert (h[:, 0] == h[:, 1]).all() and len(set(h[:, 0].tolist())) == 20000
    assert hashlib.sha256(b"").hexdigest()


CLASHING = ["n_tokens", "score", "base_score", "piece_ids", "decoded", "lines_total", "lines_removed", "n_shingles", "component_id", "kept", "matches", "removed", "lang_pred", "base", "spans", "id", "block", "train_tokens", "digest", "bands"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, null, empty, blank and long texts, ties, and columns that are named like results."""
    rng = random.Random(30)
    texts = [prose(rng, 30), None, "", " \n", prose(rng, 30), prose(rng, 30), "mail a.b@c.de and +1-321-555-9876", "x" * 30_000, prose(rng, 4000)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s9"), (None, None, None, None), rows[4], rows[5], (50, texts[5], "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHING]).repartition(3)


def test_odd_rows_have_a_defined_result(spark, odd):
    every, named = odd.count(), odd.where("doc_id is not null").count()
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    given = rows(odd)
    model = fit([prose(random.Random(1), 20)], ["en"])
    field = train([])
    assert rows(encode_documents(odd)) == given and rows(identify(odd, model)) == given
    assert rows(contaminated(odd, spark.createDataFrame([(None, "x y z"), (1, None), (2, "no such item")], "item_id long, text string"))) == given
    assert decode_documents(encode_documents(odd)).where("not (decoded <=> text)").count() == 0
    assert find_personal_data(odd, field).count() == every
    assert [c for c in remove_boilerplate(odd).columns if c.startswith("_")] == []
    lines = remove_boilerplate(odd.dropDuplicates(["doc_id", "text"]), min_sites=2)
    assert lines.where("doc_id is null").count() == 2 and lines.where("text is null").count() == 2
    once = odd.dropDuplicates(["doc_id"]).where("doc_id is not null")
    for made in (score_texts(once.withColumn("train", F.lit(True))), near_duplicates(once), remove_repeats(once)):
        assert sorted(r.doc_id for r in made.select("doc_id").collect()) == [*range(9), 50]
    # Rows of one id and text are counted as often as they stand, and each has a result.
    assert score_texts(odd.withColumn("train", F.lit(True))).count() == named
    assert sorted(r.kept for r in near_duplicates(odd).where("doc_id in (4, 5, 50)").collect()) == [False, True, True, True, True]
    assert near_duplicates(odd).count() == named


def test_odd_vectors_and_turns(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (3, [], "a"), (4, None, None), (5, [1.0, 1e-9], "a"), (6, [2.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").select("*", *[F.lit(1).alias(c) for c in ("id", "node", "copies", "n_links", "kept")])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (2, 1, False), 6: (0, 6, True)}
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), (1, 1, "assistant", "c" * 50_000)], "conv_id long, turn long, role string, text string")
    made = expand_conversations(turns.withColumn("example", F.lit(1)).withColumn("formatted", F.lit("x"))).orderBy("example")
    out = made.select(F.size(read_turns(F.col("formatted"))).alias("n"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    assert [(r.n, r.loss) for r in out] == [(1, "b"), (4, "c" * 50_000)]
