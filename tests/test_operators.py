"""Small cases with known results, and independence of partitioning."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualispark.functions import columns as C
from qualispark.operators import contracts, judge, metrics, recipes, runs, sampling
from qualispark.sources import readers


def output(case, mode="single", verdict="pass", errors=(), confidence="high", **more):
    body = {
        "schema_version": 1,
        "case_id": case,
        "judge": {"profile": "p", "model": "m", "prompt_revision": "1", "calibration_revision": "1"},
        "evaluation": {"mode": mode, "verdict": verdict, "confidence": confidence, "errors": list(errors), "rationale": "r", "limitations": []} | more,
    }
    return json.dumps(body)


def error(severity, category="accuracy", candidate="candidate", excerpt=None):
    e = {"candidate": candidate, "category": category, "severity": severity, "explanation": "x"}
    return e | ({"source_excerpt": excerpt} if excerpt else {})


@pytest.fixture()
def cases(spark):
    rows = [
        ("a", "single", "pass", "none", output("a"), None, False),
        ("b", "single", "fail", "major", output("b", verdict="fail", errors=[error("minor", "style"), error("major", excerpt="s")]), None, False),
        ("c", "single", "fail", "critical", output("c", verdict="pass"), None, False),
        ("d", "single", "fail", "major", output("d") + " ```", None, False),
        ("e", "pairwise", "candidate_a", "none", output("e", "pairwise", "candidate_a"), output("e", "pairwise", "candidate_b"), True),
        ("f", "pairwise", "tie", "none", output("x", "pairwise", "tie"), None, False),
        ("g", "pairwise", "candidate_b", "none", None, None, False),
    ]
    return spark.createDataFrame(rows, "case_id string, mode string, gold_verdict string, gold_severity string, judge_output string, swap_judge_output string, has_swap boolean").select(
        "*", F.lit("accuracy").alias("gold_category"), F.lit(None).cast("string").alias("phenomenon"), F.lit("p").alias("part")
    )


def test_judge_rates(cases):
    scores = judge.judge_case_scores(cases)
    v = judge.judge_validity(scores).first()
    assert (v.case_count, v.valid_count, v.parse_failures, v.contract_failures) == (7, 4, 1, 2)
    assert judge.judge_accuracy(scores).first().accuracy == round(3 / 7, 6)
    r = judge.severe_error_recall(scores).first()
    assert (r.major_recall, r.critical_recall) == (0.333333, 0.0)
    s = judge.swap_consistency(scores).first()
    assert (s.swap_count, s.swap_accuracy, s.position_consistency) == (1, 1.0, 1.0)
    assert {x.category for x in scores.where("case_id = 'b'").collect()} == {"accuracy"}


@pytest.mark.parametrize(
    ("text", "sound"),
    [
        (output("a"), True),
        (output("a", verdict="fail"), False),
        (output("a", verdict="tie"), False),
        (output("a", "pairwise", "tie", [error("minor")]), False),
        (output("a", dimensions={"fluency": 101}), False),
        (output("a", dimensions={"fluency": 100}), True),
        (output("a", confidence="sure"), False),
        (output("a", surplus=1), False),
        ("{}", False),
        ("[]", False),
        ("3", False),
        ("not json", False),
        ('{"a": 1} x', False),
        (output("a")[:-1] + ', "case_id": "a"}', True),
        (output("a", dimensions={"fluency": float("nan")}), False),
        (output("a", dimensions={"fluency": float("inf")}), False),
        (output("a", dimensions={"fluency": 50.5}), False),
        (output("a", dimensions=None), False),
        (output("a", confidence=["high"]), False),
        ("[" * 100_000, False),
        (None, False),
    ],
)
def test_judge_contract_both_ways(spark, text, sound):
    df = spark.createDataFrame([("a", text)], "doc_id string, document string")
    assert contracts.validate_documents(df, "judge_result").first().valid is sound
    assert contracts.parsed_judge(df, "doc_id", "document", "b").first().b_sound is sound


def test_judge_issues_are_named(spark):
    texts = [output("a", verdict="fail"), output("a", "pairwise", "pass"), output("a", surplus=1, dimensions={"fluency": -1, "x": 1}), "[]", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, document string")
    got = {r.doc_id: r.issues for r in contracts.validate_documents(df, "judge_result").collect()}
    assert got[0] == ["$.evaluation.errors: least"]
    assert got[1] == ["$.evaluation.verdict: mode"]
    assert got[2] == ["$.evaluation.dimensions.fluency: range", "$.evaluation.dimensions: extra", "$.evaluation: extra"]
    assert "$: object" in got[3] and "$.evaluation: object" in got[3]
    assert got[4] == ["$: json"]


def test_holdout_keeps_every_row(spark):
    cases = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "case_id string")
    for n, chosen in ((0, 0), (1, 1), (2, 2), (3, 3), (9, 3)):
        rows = sampling.holdout_split(cases, n).collect()
        assert len(rows) == 5 and len({r.case_id for r in rows if r.split == "holdout"}) == chosen
        assert all(len({r.split for r in rows if r.case_id == i}) == 1 for i in ("a", None))
    assert sampling.assemble_mixed_pack({"x": cases, "y": cases}, 2).count() == 10


def test_recipe_manifest(spark):
    good = {
        "schema_version": 1, "id": "a-1", "display_name": "A", "source_language": "en", "target_language": "de", "provider": {"name": "p"}, "model": {"id": "m"},
        "stages": [{"kind": "translate", "implementation": "i"}], "validator_policy": {"mode": "veto", "profile": "x"},
    }
    bad = good | {"validator_policy": {"mode": "veto"}, "stages": [], "id": "A!"}
    df = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(bad))], "doc_id string, document string")
    got = {r.doc_id: r.issues for r in contracts.validate_documents(df, "recipe_manifest").collect()}
    assert got == {"g": [], "b": ["$.id: pattern", "$.stages: least", "$.validator_policy.profile: required"]}


def test_ranking_by_ranges_equals_all_pairs(spark):
    rows = [("m", i * 7 % 4, i * 37 % 23 - 11) for i in range(60)] + [("m", 1, None), ("m", None, 3)]
    df = spark.createDataFrame(rows, "metric string, gold_rank int, ms long")
    for low in (False, True):
        held = [r for r in rows if None not in r]
        pairs = [(g, w) if low else (w, g) for _, i, g in held for _, j, w in held if i < j]
        n, won = len(pairs), sum(x < y for x, y in pairs)
        wanted = {"metric": "m", "comparisons": n, "correct": won, "ties": sum(x == y for x, y in pairs), "accuracy": won / n}
        for ranges in (1, 2, 7, 100):
            assert metrics.severity_ranking(df, lower_is_better=low, ranges=ranges).first().asDict() == wanted
            assert metrics.severity_ranking_theta(df, lower_is_better=low, ranges=ranges).first().asDict() == wanted


def test_cumulative_cost_by_ranges(spark):
    rows = [("a", i, i + 1) for i in range(40)] + [("a", None, 5), ("b", 3, None), ("b", 25, 2), ("b", 26, None), (None, 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "run string, segment long, cost_micros long")
    for width in (7, 1000):
        got = {(r.run, r.segment): r.cumulative for r in runs.cumulative_cost(df, width=width).collect()}
        assert len(got) == len(rows)
        assert all(got["a", i] == 5 + (i + 1) * (i + 2) // 2 for i in range(40)) and got["a", None] == 5
        assert (got["b", 3], got["b", 25], got["b", 26]) == (None, 2, 2) and (got[None, 1], got[None, 2]) == (1, 3)


def test_ranking_small(spark):
    rows = [("m", 0, 900), ("m", 1, 700), ("m", 2, 700), ("m", 3, 100)]
    df = spark.createDataFrame(rows, "metric string, gold_rank int, ms long")
    for f in (metrics.severity_ranking, metrics.severity_ranking_theta):
        r = f(df).first()
        assert (r.comparisons, r.correct, r.ties) == (6, 5, 1)
    r = metrics.severity_ranking(df, pass_fail=True).first()
    assert (r.comparisons, r.accuracy) == (3, 1.0)


def test_canonical_digest(spark):
    import hashlib

    values = ['q"\\', "line\nx\x1f", "é🙂\x0b", "\\u001F", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.d for r in df.select("v", C.stable_digest(C.canonical_json({"k": F.col("v"), "a": F.lit("b")})).alias("d")).collect()}
    for v in values:
        text = json.dumps({"k": v, "a": "b"}, sort_keys=True, ensure_ascii=False)
        assert got[v] == hashlib.sha256(text.encode()).hexdigest(), v


def test_markup(spark):
    df = spark.createDataFrame([("a<v>🙂b</v>c",), ("<v>x",), ("</v>x<v>",), ("<v><v>x</v></v>",), ("",), (None,)], "t string")
    got = [r.m for r in df.select(C.parse_span_markup("t").alias("m")).collect()]
    assert got[0].clean == "a🙂bc" and [(s.start, s.end, s.text) for s in got[0].spans] == [(1, 3, "🙂b")]
    assert [g.valid if g else None for g in got] == [True, False, False, False, True, None]


def test_samplers_do_not_depend_on_partitioning(spark):
    rows = [(f"c{i}", ["none", "minor", "major", "critical"][i % 4], "accuracy" if i % 3 else "style", f"l{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "case_id string, gold_severity string, gold_category string, language_pair string")
    digest = sampling.key_digest("case_id")
    makers = [
        lambda d: sampling.severity_round_robin(d, 17, digest=digest).select("case_id", "place"),
        lambda d: sampling.stratified_round_robin(d, ["language_pair"], 23, digest=digest).select("case_id", "place"),
        lambda d: sampling.holdout_split(d, 9).select("case_id", "split"),
        lambda d: sampling.slot_quota_sample(d, [("critical", None), ("critical", "style"), ("none", None)], by="language_pair", digest=digest),
    ]
    for make in makers:
        assert sorted(make(df).collect()) == sorted(make(df.repartition(7, "gold_category")).collect())
    slots = makers[3](df).where("case_id is not null").groupBy("language_pair").agg(F.countDistinct("case_id").alias("n"), F.count("*").alias("m")).collect()
    assert all(r.n == r.m for r in slots)


def test_mqm_grouping_looks_for_the_untrimmed_severity(spark):
    rows = [("s", "1", 0, "Minor", "Fluency/Grammar"), ("s", "1", 1, " major", "Accuracy/Omission"), ("s", "2", 2, "No-error", None)]
    df = spark.createDataFrame(rows, "system string, seg_id string, pos int, severity string, category string")
    got = {r.seg_id: (r.severity, r.category, r.phenomenon) for r in sampling.group_mqm_ratings(df, keys=("system", "seg_id")).collect()}
    assert got == {"1": ("major", "fluency", "fluency.grammar"), "2": ("none", "none", "no-error")}


def test_decisions(spark):
    rows = [("candidate_a", "candidate_b"), ("candidate_a", "candidate_a"), ("tie", "tie"), ("uncertain", "uncertain"), (None, "tie")]
    df = spark.createDataFrame(rows, "b string, s string")
    assert [r.w for r in df.select(recipes.judge_pair_decision(F.col("b"), F.col("s")).alias("w")).collect()] == ["left", "unresolved", "tie", "uncertain", "unresolved"]


def test_judge_surface_turns_exceptions_into_rows(spark):
    tasks = spark.createDataFrame([("a", "judge_output"), ("b", "judge_output")], "case_id string, field string")

    def make():
        def one(row):
            if row["case_id"] == "b":
                raise KeyError("x")
            return "fine"

        return one

    got = {r.case_id: (r.output, r.failure) for r in runs.apply_judge(tasks, make).collect()}
    assert got == {"a": ("fine", None), "b": (None, "benchmark_failure: KeyError")}


def test_a_scorer_must_be_finite(spark):
    df = spark.createDataFrame([("a", "s", "h", "r")], "id string, source string, hypothesis string, reference string")
    with pytest.raises(Exception, match="finite"):
        metrics.score_hypotheses(df, lambda: lambda pdf: pd.Series([float("nan")] * len(pdf))).collect()


def test_readers(spark, tmp_path):
    pack = {"schema_version": 1, "id": "p", "suite": "s", "cases": [{"id": "c", "input": {"source": "x"}, "gold": {"mode": "single", "verdict": "pass"}}]}
    (tmp_path / "pack.json").write_text(json.dumps(pack))
    assert readers.read_cases(spark, str(tmp_path / "pack.json")).first().gold_verdict == "pass"
    (tmp_path / "bad.json").write_text(json.dumps(pack | {"schema_version": 2}))
    with pytest.raises(Exception, match="version"):
        readers.read_cases(spark, str(tmp_path / "bad.json")).collect()
    line = {"ID": "1", "source": "s", "good-translation": "g", "incorrect-translation": "i", "phenomena": "p", "langpair": "en-de"}
    line["reference"] = "r"
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(line)] * 3 + [json.dumps({"ID": "2"}), "nope", "", "[1]"]) + "\n")
    every = readers.read_contrastive_jsonl(spark, str(tmp_path / "x.jsonl"), fail_fast=False)
    assert [(r.line_number, r.issue) for r in every.orderBy("line_number").collect()] == [(1, None), (2, None), (3, None), (4, "source"), (5, "malformed"), (6, "malformed"), (7, "malformed")]
    assert readers.read_contrastive_jsonl(spark, str(tmp_path / "x.jsonl"), fail_fast=False, annotated=True).where("line_number = 1").first().issue == "incorrect-translation-annotated"
    assert tuple(readers.contrastive_counts(every, ["en-de"], ["p"]).first()) == (7, 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    (tmp_path / "n.txt").write_text("\n".join(f"row {i}" for i in range(1, 200)))
    assert all(r.value == f"row {r.line_number}" for r in readers.numbered_lines(spark, str(tmp_path / "n.txt")).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="row without"):
        readers.read_contrastive_jsonl(spark, str(tmp_path / "x.jsonl")).collect()
    (tmp_path / "m.tsv").write_text("﻿system\tseverity\nA\tMajor\n", encoding="utf-8")
    assert readers.read_mqm_tsv(spark, str(tmp_path / "m.tsv")).first().system == "A"
    run = {"run_id": "r", "suite": "s", "recipe": {"id": "x", "sha256": "0"}, "cases": [{"id": "c", "track": "t", "execution_status": "completed", "hard_validation": {"enabled": True, "passed": None}}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    got = readers.read_runs(spark, str(tmp_path / "run.json"))
    assert got.select(recipes.eligible().alias("e")).first().e is False
    for wrong in ({"suite": ""}, {"suite": "other"}, {"cases": [{"id": "c", "execution_status": "?"}]}):
        (tmp_path / "wrong.json").write_text(json.dumps(run | wrong))
        with pytest.raises(Exception, match="run result"):
            readers.read_runs(spark, str(tmp_path / "wrong.json"), suite="s").collect()
    readers.write_table(got, str(tmp_path / "out"), order=["case_id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    metric_pack = {"id": "p", "cases": [{"id": "a", "source": "s", "hypothesis": "h"}]}
    result = {"pack_id": "p", "metric": {"name": "xcomet", "direction": "higher_is_better"}, "cases": [{"id": "a", "score": 0.5}]}
    for wrong in ({"pack_id": "q"}, {"cases": [{"id": "a", "score": 1}, {"id": "b", "score": 1}]}, {"cases": [{"id": "b", "score": 1}]}, {"cases": result["cases"] * 2}):
        (tmp_path / "mp.json").write_text(json.dumps(metric_pack))
        (tmp_path / "mr.json").write_text(json.dumps(result | wrong))
        with pytest.raises(Exception, match="match its pack"):
            readers.read_metric_tables(spark, str(tmp_path / "mp.json"), str(tmp_path / "mr.json")).collect()
    (tmp_path / "mp.json").write_text(json.dumps(metric_pack))
    (tmp_path / "mr.json").write_text(json.dumps(result))
    assert [r.score for r in readers.read_metric_tables(spark, str(tmp_path / "mp.json"), str(tmp_path / "mr.json")).collect()] == [0.5]
    raw = {"schema_version": 1, "provider": "p", "model_id": "m", "model_label": "M", "track": "t", "benchmark": "b", "fixture_sha256": "0", "created_at_utc": "2026-01-01T00:00:10Z", "summary": {"elapsed_seconds": 10}, "results": [{"id": "1", "score": {"parsed": True, "item_count_match": True, "hard_pass": True}}]}
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    for wrong in ({"schema_version": 2}, {"summary": None}, {"provider": ""}, {"results": None}, {"summary": {"elapsed_seconds": -1}}):
        (tmp_path / "wrong.json").write_text(json.dumps(raw | wrong))
        with pytest.raises(Exception, match="benchmark artifact"):
            readers.read_benchmark_artifacts(spark, str(tmp_path / "wrong.json")).collect()
    got = readers.read_benchmark_artifacts(spark, str(tmp_path / "raw.json"))
    assert str(got.first().started_at) == "2026-01-01 00:00:00"
    status = recipes.execution_status(F.col("execution_failure").isNotNull(), F.col("score.parsed"), F.col("score.item_count_match"))
    assert got.select(status.alias("s")).first().s == "completed"


def test_queries_read_whole_texts(spark, tmp_path):
    from qualispark.plans.catalog import QUERIES

    text = "Some words of a text that is longer than forty letters é " * 30 + "end"
    spark.createDataFrame([(0, text), (4, text), (5, text), (6, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    slugs, parsed = rows("slugify_whole"), rows("parse_span_markup_whole")
    assert all(r.slug.endswith("-forty-letters-end") and r.slug.count("forty") == 30 for r in slugs.values())
    n = len(text) // 3
    assert [parsed[i].clean for i in (0, 4, 5, 6)] == [text * 2, text, text, text]
    assert [parsed[i].spans for i in (0, 4, 5, 6)] == [f"0-{len(text)}", "", f"0-{n},{2 * n}-{len(text)}", f"{n}-{2 * n}"]
    assert [rows("span_alignment_flag_whole")[i].aligned for i in (4, 5, 6)] == [False, True, True]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_score_all_hypotheses_and_rank_both_metrics(spark):
    from qualispark.plans.catalog import QUERIES

    run = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")
    ids = lambda name: sorted(r.id for r in run(name).collect())
    assert ids("score_hypotheses_all") == ids("flatten_hypotheses")
    for name in ("severity_ranking_all", "pass_fail_ranking_all", "severity_ranking_theta_all"):
        got = {r.metric: r for r in run(name).collect()}
        assert sorted(got) == ["down", "up"] and got["up"][1:] == got["down"][1:]  # `down` is `up` turned over
        assert sorted(got.values()) == sorted(run(name.removesuffix("_all")).collect())


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_select_from_all_cases(spark):
    from qualispark.plans.catalog import QUERIES
    from qualispark.plans.views import view

    cases = view(spark, "/root/testdata/sf0.001", "cases")
    run = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")
    pairs = lambda df: {r.language_pair for r in df.select("language_pair").distinct().collect()}
    assert pairs(run("slot_nth_sample_all").where("case_id is not null")) == pairs(cases)
    chosen = [r.case_id for r in run("select_cases_all").collect()]
    assert chosen == [r.case_id for r in cases.where("gold_rank > 0").orderBy("k").limit(200).collect()]
    assert len({int(c.removeprefix("case-")) % 6 for c in chosen}) > 1
