"""Splits of large documents, canonical JSON, refusals, selection of hot groups, and calls that are paid for once."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from qualispark.functions import columns as C
from qualispark.operators import alignment, checks, contracts, metrics, recipes, runs, sampling
from qualispark.sources import readers, splits


@pytest.fixture()
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packs_over_splits_equal_lines(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    odd = lambda: "".join(rng.choice(["a", "{", "}", "[", "]", '"', "\\", "\n", "é", "🙂", ",", ":", " "]) for _ in range(rng.randrange(30)))
    (tmp_path / "packs").mkdir()
    packs = []
    for j in range(3):
        cases = [
            {"id": f"c{i}{odd()}", "input": {"source": odd(), "x": odd()}, "gold": {"mode": "single", "verdict": odd(), "phenomenon": None}, "extra": {"a": [{"b": [odd()]}]}, "judge_output": odd()}
            for i in range(rng.randrange(1, 25))
        ]
        packs.append({"zero": [], "meta": {"l": [{"q": odd()}], "m": {"k": {}}}, "schema_version": 1, "other": [{"n": 1}, {"m": [{}]}], "id": f"p{j}", "cases": cases, "suite": "s" + odd(), "late": [{"x": odd()}] * 2})
        (tmp_path / "packs" / f"{j}.json").write_text(json.dumps(packs[-1], indent=[None, 2, 1][j], ensure_ascii=j % 2 == 0) + "\n")
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, packs)))
    got = readers.read_cases(spark, str(tmp_path / "packs"))
    assert splits.pieces(spark, str(tmp_path / "packs"), "}").rdd.getNumPartitions() > 20
    assert sorted(map(repr, got.collect())) == sorted(map(repr, readers.read_cases(spark, str(tmp_path / "lines.jsonl"), lines=True).collect()))
    assert [r.pos for r in got.where("pack_id = 'p1'").orderBy("pos").collect()] == list(range(len(packs[1]["cases"])))


def test_packs_that_are_refused(spark, tmp_path, tiny_splits):
    pack = {"schema_version": 1, "id": "p", "suite": "s", "cases": [{"id": "c" * 400}]}
    for i, text in enumerate(["[]", "3", "", "no", json.dumps(pack)[:-30], *(json.dumps(pack | x) for x in ({"schema_version": 2}, {"id": ""}, {"suite": None}, {"cases": [1]}, {"cases": [[]]}, {"cases": None}, {"cases": {}}))]):
        (tmp_path / f"{i}.json").write_text(text or " ")
        with pytest.raises(Exception, match="a pack needs"):
            readers.read_cases(spark, str(tmp_path / f"{i}.json")).collect()
    (tmp_path / "none.json").write_text(json.dumps(pack | {"cases": []}))
    assert readers.read_cases(spark, str(tmp_path / "none.json")).count() == 0


def test_quoted_tsv_over_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(6)
    words = ["w", '"q"', "a\nb", "\n\n", "t\tt", "é", "c\r\nd"]
    rows = [["system", "severity", "text"]] + [[rng.choice(["A", "b c", ""]), rng.choice(["Major", "x\ty", 'q"q', '"']), " ".join(rng.choice(words) for _ in range(5))] for _ in range(200)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter="\t", lineterminator="\n").writerows(rows)
    text = "﻿" + out.getvalue() + 'plain\tin "side" x\ttail\n\nlast\t"\nopen"\tend'
    (tmp_path / "m.tsv").write_bytes(text.encode())
    wanted = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter="\t") if r][1:]
    got = readers.read_mqm_tsv(spark, str(tmp_path / "m.tsv")).orderBy("pos").collect()
    assert [[x or "" for x in (r.system, r.severity, r.text)] for r in got] == wanted
    assert [r.pos for r in got[:202]] == [*range(201), 202]


def test_canonical_text_equals_python(spark):
    rng = random.Random(3)
    doubles = [float(x) for x in "1e16 1e15 1e-4 1e-5 0.1 5.684341886080802e-14 2e-3 1e23 2e23 1.7976931348623157e308 1e22 4.35 100 -0.0 0 1234567.5 9.999e-4 3.3e7 -1.5e-7 12.5".split()]
    doubles += [rng.random() for _ in range(2000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [float("nan"), float("inf"), float("-inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in doubles], "x double").select(C.double_text(F.col("x"))).collect()]
    assert got == [json.dumps(x) for x in doubles]
    schema = 'a int, b double, z array<struct<y:string,x:int,w:array<double>>>, m map<string,struct<q:boolean,p:string>>, s string, n struct<e:string>, t boolean, `k"é` int'
    rows = [
        (1, 1.5, [("y", None, [1e20, None]), None], {"b": (True, None), "a": None, "é": (None, "x\x1f\x0b\\u001F")}, 'q"\\\n', (None,), None, 3),
        (None, None, None, None, None, None, True, None),
        (2, 0.1, [], {}, "", ("e",), False, 0),
    ]
    df = spark.createDataFrame(rows, schema)

    def plain(x, drop):
        if isinstance(x, Row):
            x = x.asDict(False)
        if isinstance(x, dict):
            return {k: plain(v, drop) for k, v in x.items() if v is not None or not drop}
        return [plain(v, drop) for v in x] if isinstance(x, list) else x

    both = df.select(F.struct("*").alias("r"), C.canonical_text(F.struct("*"), df.schema).alias("whole"), C.strip_null_fields(F.struct("*"), df.schema).alias("stripped"))
    for r in both.collect():
        assert r.whole == json.dumps(plain(r.r, False), sort_keys=True, ensure_ascii=False)
        assert r.stripped == json.dumps(plain(r.r, True), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    v = spark.createDataFrame([('{"b":1.50,"a":[{"d":1,"c":null}],"e":1e30}',), (None,), ("3",)], "t string").select(F.struct(F.parse_json("t").alias("v"), F.lit(None).cast("int").alias("n")).alias("s"))
    kind = v.schema["s"].dataType
    assert [r[0] for r in v.select(C.canonical_text("s", kind)).collect()] == ['{"n": null, "v": {"a": [{"c": null, "d": 1}], "b": 1.5, "e": 1e+30}}', '{"n": null, "v": null}', '{"n": null, "v": 3}']
    assert [r[0] for r in v.select(C.strip_null_fields("s", kind)).collect()] == ['{"v":{"a":[{"d":1}],"b":1.5,"e":1e+30}}', "{}", '{"v":3}']


def test_artifacts_are_written_with_sorted_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, ("x", None)), (1, None)], "id int, c struct<z:string,a:int>")
    readers.write_table(df, str(tmp_path / "out"), order=["id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"c": null, "id": 1}', '{"c": {"a": null, "z": "x"}, "id": 2}']


def test_metadata_and_severities(spark):
    df = spark.createDataFrame([("a", None), ("b", "de")], "id string, pair string")
    got = [r.m.asDict() for r in df.select(C.case_metadata_defaults("id", {"language_pair": "pair", "source_case_id": "id"}).alias("m")).collect()]
    assert list(got[0]) == list(C.CASE_METADATA) and got[0]["language_pair"] == "unknown" and got[0]["partition"] == "unspecified" and got[1]["language_pair"] == "de"
    assert df.select(C.require_severity(F.lit(" No_Error "))).first()[0] == "none"
    with pytest.raises(Exception, match="unknown severity: grave"):
        df.select(C.require_severity(F.lit("grave"))).collect()


# --- refusals ------------------------------------------------------------------


def test_refuse_names_an_example_also_of_an_empty_result(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert checks.refuse(df, df.where("k = 2"), "k", "odd").collect() == df.collect()
    for out in (df, df.limit(0)):
        with pytest.raises(Exception, match=r"odd: 1 \(1 in all\)"):
            checks.refuse(out, df, "k", "odd").collect()
    assert [tuple(r) for r in checks.one_sided({"x": df, "y": df.withColumn("k", F.lit(2))}, "k").orderBy("k").collect()] == [(1, "y"), (2, "x")]


def test_rated_segments_refuse(spark):
    segments = spark.createDataFrame([(1, "s1", "d1", "news"), (2, "s2", "d1", "news")], "segment int, source string, doc string, domain string")
    rows = lambda *x: spark.createDataFrame([(s, i, f"{s}{i}") for s, i in x], "system string, segment int, output string")
    outputs = rows(("A", 1), ("A", 2), ("B", 1), ("B", 2))
    ratings = outputs.select("system", "segment", F.when(F.col("output") != "B2", F.array(F.col("output"))).alias("errors"))
    raters = outputs.select("system", "segment", F.lit("r").alias("rater"))
    got = sampling.rated_segments(segments, outputs, ratings, raters=raters)
    assert sorted(r.output for r in got.collect()) == ["A1", "A2", "B1"] and {"source", "doc", "domain", "rater"} <= set(got.columns)
    assert sampling.rated_segments(segments, outputs, ratings, systems=["A"]).count() == 2
    for wrong in (
        {"outputs": outputs.where("system = 'A'")}, {"raters": raters.where("system = 'A'")}, {"outputs": outputs.where("output <> 'B2'")}, {"segments": segments.limit(1)},
        {"ratings": ratings.where("segment = 1 or system = 'A'")}, {"outputs": outputs.unionByName(outputs.limit(1))}, {"systems": ["A", "Z"]},
    ):
        with pytest.raises(Exception, match="segment|ratings"):
            sampling.rated_segments(**({"segments": segments, "outputs": outputs, "ratings": ratings, "raters": raters} | wrong)).collect()


def test_other_refusals(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, k int")
    ids = spark.createDataFrame([("a",), ("x",), ("y",)], "case_id string")
    with pytest.raises(Exception, match=r"unknown case ids: x \(2 in all\)"):
        sampling.select_cases(cases, ids).collect()
    assert sampling.select_cases(cases, ids, strict=False).count() == 1
    scores = spark.createDataFrame([("m", "a", "candidate_a", 1), ("m", "a", "candidate_b", 2), ("m", "b", "candidate_a", 1)], "metric string, case_id string, role string, ms int")
    with pytest.raises(Exception, match="incomplete pairwise scores of m for b"):
        metrics.metric_pairwise_verdict(scores, lower_is_better={}).collect()
    assert metrics.metric_pairwise_verdict(scores, lower_is_better={}, strict=False).count() == 1
    effective = cases.select("case_id", F.lit("pairwise").alias("mode"), F.lit("tie").alias("gold_verdict"), F.lit("tie").alias("effective"), F.lit(True).alias("correct"), F.lit(None).cast("string").alias("failure"))
    verdicts = lambda *x: spark.createDataFrame([(m, c, "tie") for m, c in x], "metric string, case_id string, verdict string")
    assert alignment.align_evidence(effective, verdicts(("m", "a"), ("m", "b"))).count() == 2
    for wrong in ([("m", "a")], [("m", "a"), ("m", "b"), ("m", "c")], [("m", "a"), ("m", "b"), ("n", "a")], [("m", "a"), ("m", "b"), ("m", "b")], [("m", "a"), ("m", "c")]):
        with pytest.raises(Exception, match="match|each once"):
            alignment.align_evidence(effective, verdicts(*wrong)).collect()
    with pytest.raises(Exception, match="each once"):
        alignment.align_evidence(effective.unionByName(effective.limit(1)), verdicts(("m", "a"), ("m", "b"))).collect()
    run = lambda *x: spark.createDataFrame([(r, c, "translation", "completed", True, h) for r, c, h in x], "recipe string, case_id string, track string, status string, passed boolean, recipe_sha256 string")
    assert recipes.paired_runs(run(("x", "a", "1"), ("y", "a", "2"))).count() == 1
    for wrong in ([("x", "a", "1"), ("y", "a", "1")], [("x", "a", "1"), ("y", "b", "2")], [("x", "a", "1"), ("y", "a", "2"), ("y", "a", "2")], [("x", "a", "1"), ("x", "b", "1"), ("y", "a", "2")]):
        with pytest.raises(Exception, match="case ids|distinct recipe hashes"):
            recipes.paired_runs(run(*wrong)).collect()


# --- selection -------------------------------------------------------------------


def test_hot_groups_are_ranked_in_buckets(spark, monkeypatch):
    rows = [(f"c{i}", "none" if i % 10 else ["minor", "major", "critical"][i // 10 % 3], f"l{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "case_id string, gold_severity string, language_pair string").repartition(5)
    digest = {r.case_id: r.d for r in df.select("case_id", sampling.key_digest("case_id").alias("d")).collect()}
    order = lambda key: {g: sorted((i for i, s, p in rows if key(s, p) == g), key=digest.get) for g in {key(s, p) for _, s, p in rows}}
    by_severity = order(lambda s, p: s)
    rounds = [by_severity[g][k] for k in range(3000) for g in ("critical", "major", "minor", "none") if k < len(by_severity[g])]
    monkeypatch.setattr(sampling, "ROUNDS", 50)
    for limit in (1, 7, 1500, 2500, 5000):
        got = sampling.severity_round_robin(df, limit, digest=sampling.key_digest("case_id")).orderBy("place").collect()
        assert [r.case_id for r in got] == rounds[:limit] and [r.place for r in got] == list(range(1, len(rounds[:limit]) + 1))
    by_pair = order(lambda s, p: p)
    slots = spark.createDataFrame([("l0", 1), ("l0", 700), ("l1", 2), ("l2", 5000), ("zz", 1)], "language_pair string, occurrence int")
    got = sampling.slot_nth_sample(df, slots, ["language_pair"], digest=sampling.key_digest("case_id")).collect()
    assert {(r.language_pair, r.occurrence): r.case_id for r in got} == {("l0", 1): by_pair["l0"][0], ("l0", 700): by_pair["l0"][699], ("l1", 2): by_pair["l1"][1]}


def test_nth_digest(spark, monkeypatch):
    values = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(500)]
    values += ["abcd" * 15 + f"{i:04x}" for i in range(40)] + values[:50]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "d string")
    ranked = sorted(set(values))
    for most in (10_000, 10, 3):
        monkeypatch.setattr(sampling, "AT_ONCE", most)
        for n in (1, 5, 340, 360, 539, 540, 541, 9999):
            assert sampling.nth_digest(df, "d", n) == ranked[min(n, len(ranked)) - 1], n
    assert sampling.nth_digest(df, "d", 0) is None and sampling.nth_digest(df.limit(0), "d", 3) is None


def test_scores_of_any_scale_give_ranges(spark):
    df = spark.range(4000).select(F.lit("m").alias("metric"), (F.col("id") % 4).cast("int").alias("gold_rank"), (F.col("id") * 7919 % 4001 / 4001).alias("ms"))
    sizes = [r["count"] for r in metrics._ranged(metrics._cells(df, False, False), 50).groupBy("range").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 120
    assert metrics.severity_ranking(df).first().asDict() == metrics.severity_ranking_theta(df).first().asDict()


# --- judge outputs and calls -------------------------------------------------------


def judge_document(**more):
    return {"schema_version": 1, "case_id": "a", "judge": {"profile": "p", "model": "m", "prompt_revision": "1", "calibration_revision": "1"},
            "evaluation": {"mode": "single", "verdict": "fail", "confidence": "high", "errors": [{"candidate": "candidate", "category": "style", "severity": "minor", "explanation": "x"} | more], "rationale": "r", "limitations": []}}


def test_no_document_fails_a_job(spark):
    cut = "cut \ud83d"
    documents = [judge_document(source_excerpt=cut), judge_document(explanation=cut), judge_document() | {"case_id": cut}, judge_document() | {cut: 1}]
    for k in ("verdict", "confidence", "rationale", "mode", "dimensions", "errors", "limitations"):
        documents.append(judge_document())
        documents[-1]["evaluation"] |= {k: cut}
    texts = [json.dumps(d) for d in documents] + ['{"a": ' + "9" * 5000 + "}", '{"schema_version": 1e999}', "[" * 50_000, "\ud83d".encode("utf-8", "replace").decode(), "", " ", "null", '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, document string")
    got = {r.doc_id: r for r in contracts.validate_documents(df, "judge_result").collect()}
    assert len(got) == len(texts) and [got[i].valid for i in range(4)] == [True, True, True, False]
    parsed = contracts.parsed_judge(df.withColumn("case", F.lit("a")), "case", "document", "b").where("doc_id = 0").first()
    assert parsed.b_errors[0].source_excerpt == "cut �" and parsed.b_failure is None
    for contract in contracts.CONTRACTS:
        assert contracts.validate_documents(df, contract).where("not valid").count() == len(texts)


def test_review_queue_reads_each_case_once(spark):
    rows = [("a", "pairwise", "tie", "tie", True, None), ("b", "pairwise", "tie", "neither", False, None), ("c", "pairwise", "tie", None, False, "judge_invalid"), ("d", "single", "pass", "pass", True, None), ("e", "single", "pass", "fail", False, None)]
    effective = spark.createDataFrame(rows, "case_id string, mode string, gold_verdict string, effective string, correct boolean, failure string")
    verdicts = spark.createDataFrame([("m", c, v) for c, v in (("a", "candidate_a"), ("b", "candidate_b"), ("c", "tie"), ("d", "tie"))] + [("n", "a", "tie")], "metric string, case_id string, verdict string")
    got = {r.case_id: r.reasons for r in alignment.review_queue(effective, verdicts).collect()}
    assert got == {"a": "judge_m_disagreement", "b": "judge_gold_mismatch,judge_m_both_wrong,judge_m_disagreement", "c": "judge_gold_mismatch,judge_invalid", "e": "judge_gold_mismatch"}


def test_outputs_are_resumed(spark):
    good, bad = json.dumps(judge_document()), json.dumps(judge_document() | {"case_id": "z"})
    cases = spark.createDataFrame([("a", None, "own"), ("b", "own", None), ("c", None, None)], "case_id string, judge_output string, swap_judge_output string")
    prior = spark.createDataFrame([("a", good, bad), ("b", good, None), ("q", good, good)], "case_id string, judge_output string, swap_judge_output string")
    got = {r.case_id: (r.judge_output, r.swap_judge_output, r.reused) for r in runs.resume_outputs(cases, prior).collect()}
    assert got == {"a": (good, "own", 1), "b": ("own", None, 0), "c": (None, None, 0)}


def test_swap_requests_come_back_under_their_case(spark):
    cases = spark.createDataFrame([("a", "x", "y", "candidate_a", "in")], "case_id string, candidate_a string, candidate_b string, gold_verdict string, source string")
    tasks = spark.createDataFrame([("a", 1, "judge_output"), ("a", 1, "swap_judge_output")], "case_id string, run int, field string")
    asked = runs.judge_requests(tasks, cases)
    make = lambda: lambda row: json.dumps({"case_id": row["request_id"], "first": row["candidate_a"], "gold": row["gold_verdict"]})
    got = {r.field: json.loads(r.output) for r in runs.apply_judge(asked, make).collect()}
    assert got == {"judge_output": {"case_id": "a", "first": "x", "gold": "candidate_a"}, "swap_judge_output": {"case_id": "a", "first": "y", "gold": "candidate_b"}}


def test_logged_calls_are_not_repeated(spark, tmp_path):
    calls, log = tmp_path / "calls", tmp_path / "log"
    calls.mkdir()
    tasks = spark.range(20).select(F.concat(F.lit("c"), "id").alias("case_id"), F.lit("judge_output").alias("field")).repartition(2)

    def make(until):
        def one(row):
            n = len(os.listdir(calls))
            if n >= until:
                raise SystemExit("the executor is lost")
            (calls / f"{row['case_id']}-{n}-{os.urandom(4).hex()}").write_text("")
            if row["case_id"] == "c3":
                raise KeyError("c3")
            return "out " + row["case_id"]

        return lambda: one

    with pytest.raises(Exception, match="lost|Python worker|exit"):
        runs.apply_judge(tasks, make(9), log=str(log)).collect()
    before = {f.split("-")[0] for f in os.listdir(calls)}
    out = runs.apply_judge(tasks, make(10**9), log=str(log), every=3)
    for _ in range(2):
        got = {r.case_id: (r.output, r.failure) for r in out.collect()}
        assert len(got) == 20 and got["c3"] == (None, "benchmark_failure: KeyError") and all(v == ("out " + k, None) for k, v in got.items() if k != "c3")
    names = [f.split("-")[0] for f in os.listdir(calls)]
    assert len(before) >= 9 and all(names.count(f"c{i}") == 1 for i in range(20) if i != 3)


def test_recipes_of_artifacts(spark):
    rows = [("P", "m/1", "M", "t", "0", h, {"b": 1, "a": None}) for h in ("h2", "h1", "h1", "", None)] + [("P", "m/1", "M", "t", "0", "h1", None)]
    df = spark.createDataFrame(rows, "provider string, model_id string, model_label string, track string, fixture_sha256 string, prompt_sha256 string, policy map<string,int>")
    got = sorted(recipes.artifact_recipes(df, revision="2").collect(), key=lambda r: r.policy)
    for r, policy, prompts in zip(got, ({"a": None, "b": 1}, {}), (["h1", "h2"], ["h1"]), strict=True):
        snapshot = {"adapter_revision": "2", "provider": "P", "model_id": "m/1", "model_label": "M", "track": "t", "prompt_sha256": prompts, "fixture_sha256": "0", "policy": policy}
        text = json.dumps(snapshot, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert (r.snapshot, r.snapshot_sha256, r.recipe_id) == (text, hashlib.sha256(text.encode()).hexdigest(), "p.m-1.t")
