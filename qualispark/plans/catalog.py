"""The evaluation queries over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualispark.functions import columns as C
from qualispark.operators import alignment, contracts, judge, metrics, recipes, runs, sampling
from qualispark.plans.views import ctes, judge_json, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def same(name: str, other: str) -> None:
    """A query under another name that it has been known by."""
    QUERIES[name], SQL[name] = QUERIES[other], SQL[other]


# --- judge against gold -----------------------------------------------------

JUDGED = (
    ctes("answers")
    + """,
j0 AS (SELECT *, (kind = 'sound' OR (kind = 'mode' AND verdict = 'uncertain')) AS valid FROM answers),
j AS (SELECT *,
  CASE WHEN kind = 'text' THEN 'json_parse_failure' WHEN NOT valid THEN 'schema_failure' END AS failure,
  valid AND kind = 'sound' AND verdict = gold_verdict AS correct,
  CASE WHEN valid THEN CASE WHEN verdict <> 'fail' THEN 'none' WHEN pred_rank <= 1 THEN 'minor' WHEN pred_rank = 2 THEN 'major' ELSE 'critical' END END AS severity,
  CASE WHEN valid THEN CASE WHEN verdict <> 'fail' THEN 'none' WHEN k % 7 = 0 OR gold_category = 'none' THEN 'other' ELSE gold_category END END AS category,
  CASE WHEN valid AND verdict = 'fail' THEN CASE WHEN minor_first THEN 2 ELSE 1 END ELSE 0 END AS errors,
  valid AND has_swap AS swap, valid AND has_swap AND NOT swap_broken AS swap_valid,
  mode = 'pairwise' AND gold_verdict IN ('candidate_a', 'candidate_b') AS decided,
  CASE gold_verdict WHEN 'candidate_a' THEN 'candidate_b' WHEN 'candidate_b' THEN 'candidate_a' ELSE gold_verdict END AS gold_swapped
  FROM j0)
"""
)
_RATE = "round_even(CAST({} AS DOUBLE) / nullif({}, 0), 6)"


def _rate(top: str, bottom: str) -> str:
    return _RATE.format(f"count(*) FILTER (WHERE {top})", f"count(*) FILTER (WHERE {bottom})")


VALIDITY = f"count(*) AS case_count, count(*) FILTER (WHERE valid) AS valid_count, {_rate('valid', 'true')} AS valid_rate, count(*) FILTER (WHERE failure = 'json_parse_failure') AS parse_failures, count(*) FILTER (WHERE failure = 'schema_failure') AS contract_failures"
ACCURACY = f"""{_rate("correct", "true")} AS accuracy, {_rate("correct AND mode = 'single'", "mode = 'single'")} AS single_accuracy, {_rate("correct AND mode = 'pairwise'", "mode = 'pairwise'")} AS pairwise_accuracy"""
RECALL = f"""{_rate("gold_rank >= 2 AND severity IN ('major', 'critical')", "gold_rank >= 2")} AS major_recall, {_rate("gold_rank >= 2 AND coalesce(severity, '') NOT IN ('major', 'critical')", "gold_rank >= 2")} AS major_false_negative_rate, {_rate("gold_rank = 3 AND severity = 'critical'", "gold_rank = 3")} AS critical_recall"""
FALSE_GOOD = f"""{_rate("valid AND mode = 'single' AND gold_verdict = 'fail' AND verdict = 'pass'", "mode = 'single' AND gold_verdict = 'fail'")} AS false_good_rate, {_rate("decided AND correct", "decided")} AS bad_candidate_accuracy"""
EVIDENCE = f"""{_rate("valid AND confidence = 'low'", "valid")} AS low_confidence_rate, {_RATE.format("sum(CASE WHEN excerpt THEN errors ELSE 0 END)", "sum(errors)")} AS evidence_rate"""
SWAPS = f"""count(*) FILTER (WHERE swap) AS swap_count, {_rate("swap_valid", "swap")} AS swap_valid_rate, {_rate("swap_valid AND swap_verdict = gold_swapped", "swap")} AS swap_accuracy, {_rate("swap_valid AND swap_verdict = swapped", "swap_valid")} AS position_consistency"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_json(view(spark, sf_dir, "answers"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge_case_scores(judged(spark, sf_dir))


def _from_scores(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_scores(spark, sf_dir))


query(JUDGED + f"SELECT {VALIDITY} FROM j", "judge_validity")(_from_scores(judge.judge_validity))
query(JUDGED + f"SELECT {ACCURACY} FROM j", "judge_accuracy")(_from_scores(judge.judge_accuracy))
query(JUDGED + f"SELECT {RECALL} FROM j", "severe_error_recall")(_from_scores(judge.severe_error_recall))
query(JUDGED + f"SELECT {FALSE_GOOD} FROM j", "false_good_and_bad_candidate")(_from_scores(judge.false_good_and_bad_candidate))
query(
    JUDGED + "SELECT " + ", ".join(f"count(*) FILTER (WHERE valid AND confidence = '{c}') AS confidence_{c}" for c in ("high", "medium", "low")) + f", {EVIDENCE} FROM j",
    "confidence_and_evidence",
)(_from_scores(judge.confidence_and_evidence))
query(JUDGED + f"SELECT {SWAPS} FROM j", "swap_consistency")(_from_scores(judge.swap_consistency))
query(JUDGED + f"SELECT phenomenon, count(*) AS case_count, count(*) FILTER (WHERE correct) AS correct_count, {_rate('correct', 'true')} AS accuracy FROM j GROUP BY phenomenon", "phenomenon_accuracy")(_from_scores(judge.phenomenon_accuracy))
for _what in ("severity", "category"):
    query(JUDGED + f"SELECT gold_{_what} AS gold, coalesce({_what}, 'invalid_output') AS predicted, count(*) AS n FROM j GROUP BY 1, 2", f"confusion_matrix_{_what}")(_from_scores(lambda s, w=_what: judge.confusion_matrix(s, w)))
query(JUDGED + "SELECT case_id, failure FROM j WHERE failure IS NOT NULL", "judge_failures")(_from_scores(judge.judge_failures))
query(JUDGED + f"SELECT part, {VALIDITY}, {ACCURACY}, {RECALL}, {FALSE_GOOD}, {EVIDENCE}, {SWAPS} FROM j GROUP BY GROUPING SETS ((), (part))", "calibration_by_partition")(_from_scores(judge.calibration_by_partition))
query(
    JUDGED + "SELECT case_id, failure, coalesce(verdict, '') AS verdict, correct FROM (SELECT case_id, failure, CASE WHEN valid THEN verdict END AS verdict, correct FROM j)",
    "judge_case_scores",
)(lambda spark, sf_dir: _scores(spark, sf_dir).select("case_id", "failure", F.coalesce("verdict", F.lit("")).alias("verdict"), "correct"))

# --- contracts ---------------------------------------------------------------

query(JUDGED + "SELECT case_id, failure FROM j", "classify_judge_output")(lambda spark, sf_dir: contracts.classify_judge_output(judged(spark, sf_dir)))
query(
    JUDGED + "SELECT case_id, CASE WHEN kind = 'case' THEN 'case_id_mismatch' WHEN valid THEN 'ok' ELSE 'invalid' END AS status FROM j",
    "judge_evidence_status",
)(lambda spark, sf_dir: contracts.judge_evidence_status(judged(spark, sf_dir)))
query(JUDGED + "SELECT case_id, (valid OR kind = 'case') AS valid FROM j", "pairwise_judge_validity")(lambda spark, sf_dir: contracts.pairwise_judge_validity(judged(spark, sf_dir)))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(F.col("case_id").alias("doc_id"), F.coalesce("judge_output", F.lit("")).alias("document"))


@query(
    JUDGED
    + """SELECT case_id AS doc_id, (valid OR kind = 'case') AS valid,
  CASE WHEN kind IN ('text', 'missing') THEN '$: json'
       WHEN kind = 'mode' AND verdict = 'fail' THEN '$.evaluation.errors[].candidate: mode,$.evaluation.verdict: mode'
       WHEN kind = 'mode' AND verdict <> 'uncertain' THEN '$.evaluation.verdict: mode' ELSE '' END AS issues FROM j"""
)
def judge_result_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validate_documents(_documents(spark, sf_dir), "judge_result").withColumn("issues", F.array_join("issues", ","))


@query(
    JUDGED
    + """, i AS (SELECT unnest(CASE WHEN kind IN ('text', 'missing') THEN ['$: json']
       WHEN kind = 'mode' AND verdict = 'fail' THEN ['$.evaluation.errors[].candidate: mode', '$.evaluation.verdict: mode']
       WHEN kind = 'mode' AND verdict <> 'uncertain' THEN ['$.evaluation.verdict: mode'] ELSE [] END) AS issue FROM j)
SELECT issue, count(*) AS n FROM i GROUP BY issue"""
)
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validate_documents(_documents(spark, sf_dir), "judge_result").select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id AS doc_id, count(*) FILTER (WHERE coalesce(text, '') = '' OR coalesce(role, '') = '') = 0 AND count(*) <= 6 AS valid FROM conversations GROUP BY conv_id"""
)
def metric_pack_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = view(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"), F.lit("p").alias("id"), F.lit("s").alias("suite"),
                F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("source"), F.coalesce("role", F.lit("")).alias("hypothesis"))).alias("cases"),
            )
        ).alias("document")
    )
    v = F.try_parse_json("document")
    return packs.select("doc_id", (F.size(contracts.issues_of(contracts.metric_pack_rules(v, most=6))) == 0).alias("valid"))


@query(
    """SELECT event_id AS doc_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS valid FROM events"""
)
def metric_result_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events")
    sha = F.when(F.col("event_id") % 5 == 0, F.upper(F.sha2(F.concat(F.lit("x"), F.col("event_id")), 256))).otherwise(F.sha2(F.concat(F.lit("x"), F.col("event_id")), 256))
    sha = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Z"), F.substring(sha, 2, 63))).otherwise(sha)
    score = F.struct(F.lit("a").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") / 1000).alias("score"))
    number = lambda n: F.lit(0.5).alias(n)
    body = F.to_json(
        F.struct(
            F.lit("p").alias("pack_id"),
            F.struct(F.lit("xcomet").alias("name"), F.lit("m").alias("model_id"), sha.alias("model_sha256"), F.lit("qe").alias("mode"), F.when(F.col("event_id") % 11 == 0, "sideways").otherwise("higher_is_better").alias("direction")).alias("metric"),
            F.array(score).alias("cases"),
            F.struct(F.lit(1).alias("case_count"), number("mean_score"), number("minimum_score"), number("maximum_score")).alias("summary"),
        )
    )
    return contracts.validate_documents(e.select(F.col("event_id").alias("doc_id"), body.alias("document")), "metric_result").select("doc_id", "valid")


@query(ctes("runs") + "SELECT concat(recipe, '/', case_id) AS doc_id, quantity % 13 <> 0 AS valid FROM runs")
def run_result_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "runs")
    status = F.when(F.col("quantity") % 13 == 0, "lost").otherwise(F.col("status"))
    hard = F.struct(F.lit(True).alias("enabled"), F.col("passed"), F.array().cast("array<struct<code:string>>").alias("findings"))
    body = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), F.lit("r").alias("run_id"), F.lit("s").alias("suite"), F.struct(F.col("recipe").alias("id"), F.sha2("recipe", 256).alias("sha256")).alias("recipe"),
            F.array(F.struct(F.col("case_id").alias("id"), status.alias("execution_status"), hard.alias("hard_validation"))).alias("cases"),
        ),
        {"ignoreNullFields": "false"},
    )
    return contracts.validate_documents(r.select(F.concat_ws("/", "recipe", "case_id").alias("doc_id"), body.alias("document")), "run_result").select("doc_id", "valid")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def assert_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.assert_unique_keys(view(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    ctes("runs")
    + """, a AS (SELECT DISTINCT case_id FROM runs WHERE recipe = 'r0'), b AS (SELECT DISTINCT case_id FROM runs WHERE recipe = 'r1')
SELECT case_id, 'left' AS side FROM a WHERE case_id NOT IN (SELECT case_id FROM b) UNION ALL SELECT case_id, 'right' FROM b WHERE case_id NOT IN (SELECT case_id FROM a)"""
)
def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "runs")
    return contracts.key_set_diff(r.where("recipe = 'r0'"), r.where("recipe = 'r1'"), "case_id")


@query(
    ctes("pairs")
    + """SELECT count(*) AS n, count(*) FILTER (WHERE reference IS NULL OR candidate_a IS NULL OR candidate_b IS NULL) AS incomplete,
  count(*) FILTER (WHERE reference IS NULL) AS missing_reference, count(*) FILTER (WHERE candidate_a IS NULL) AS missing_candidate_a, count(*) FILTER (WHERE candidate_b IS NULL) AS missing_candidate_b FROM pairs"""
)
def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.metadata_completeness(view(spark, sf_dir, "pairs"), "reference", "candidate_a", "candidate_b")


@query(
    """SELECT doc_id AS id, CASE doc_id % 17 WHEN 0 THEN 'null' WHEN 1 THEN 'nan' ELSE 'infinite' END AS issue FROM documents WHERE doc_id % 17 < 3 AND doc_id % 23 <> 5
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 23 = 5"""
)
def score_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    value = F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 17 == 1, F.lit(float("nan"))).when(F.col("id") % 17 == 2, F.lit(float("inf"))).otherwise(F.col("id") / 7)
    return contracts.score_sanity(d.where("id % 23 <> 5").withColumn("score", value), d)


@query(ctes("cases") + "SELECT case_id, CASE WHEN k % 31 = 0 THEN 'mode' ELSE 'severity' END AS issue FROM cases WHERE k % 31 = 0 OR k % 37 = 0")
def gold_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "cases")
    c = c.withColumn("mode", F.when(F.col("k") % 31 == 0, "group").otherwise(F.col("mode"))).withColumn("gold_severity", F.when(F.col("k") % 37 == 0, "grave").otherwise(F.col("gold_severity")))
    return contracts.gold_contract(c)


# --- columns -----------------------------------------------------------------

RAW = "concat(' ', upper(CASE doc_id % 9 WHEN 0 THEN 'no_error' WHEN 1 THEN 'neutral' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' WHEN 4 THEN 'critical' WHEN 5 THEN '' WHEN 6 THEN 'grave' WHEN 7 THEN 'none' ELSE 'minor' END), ' ')"
KIND = "CASE doc_id % 11 WHEN 0 THEN 'Accuracy/Omission' WHEN 1 THEN 'terminology' WHEN 2 THEN 'Fluency/Grammar' WHEN 3 THEN 'mistranslation' WHEN 4 THEN 'grammar' WHEN 5 THEN '' WHEN 6 THEN 'no-error' WHEN 7 THEN 'locale convention' WHEN 8 THEN 'word_order' WHEN 9 THEN 'else' ELSE 'Style' END"
_PREFIXES = "CASE WHEN v LIKE 'accuracy%' THEN 'accuracy' WHEN v LIKE 'terminology%' THEN 'terminology' WHEN v LIKE 'fluency%' THEN 'fluency' WHEN v LIKE 'style%' THEN 'style' WHEN v LIKE 'locale%' THEN 'locale' WHEN v IN ('', 'no-error') THEN 'none' {} ELSE 'other' END"
_DOCS = "SELECT doc_id, {} FROM documents"


def _docs(spark: SparkSession, sf_dir: str, **made) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in made.items()])


query(ctes("cases") + "SELECT case_id, gold_rank AS rank FROM cases", "severity_rank")(lambda s, d: view(s, d, "cases").select("case_id", C.severity_rank("gold_severity").alias("rank")))
query(
    f"SELECT doc_id, CASE v WHEN '' THEN 'none' WHEN 'no-error' THEN 'none' WHEN 'neutral' THEN 'none' WHEN 'grave' THEN NULL ELSE v END AS severity FROM (SELECT doc_id, replace(lower(trim({RAW})), '_', '-') AS v FROM documents)",
    "normalize_severity_strict",
)(lambda s, d: _docs(s, d, severity=C.normalize_severity_strict(F.expr(RAW))))
query(f"SELECT doc_id, {_PREFIXES.format('')} AS category FROM (SELECT doc_id, lower({KIND}) AS v FROM documents)", "normalize_category_strict")(lambda s, d: _docs(s, d, category=C.normalize_category_strict(F.expr(KIND))))
query(
    "SELECT doc_id, " + _PREFIXES.format("WHEN v IN ('mistranslation', 'omission', 'addition', 'wrong_named_entity') THEN 'accuracy' WHEN v IN ('grammar', 'agreement', 'punctuation', 'word_order', 'unnatural_flow') THEN 'fluency'") + f" AS category FROM (SELECT doc_id, lower({KIND}) AS v FROM documents)",
    "normalize_category_lenient",
)(lambda s, d: _docs(s, d, category=C.normalize_category_lenient(F.expr(KIND))))
query(f"SELECT doc_id, CASE WHEN v = '' THEN 'unspecified' ELSE v END AS phenomenon FROM (SELECT doc_id, replace(lower(trim({KIND})), '/', '.') AS v FROM documents)", "normalize_phenomenon")(
    lambda s, d: _docs(s, d, phenomenon=C.normalize_phenomenon(F.expr(KIND)))
)


def _error_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "errors").withColumn("severity", C.severity_name("sev_rank"))
    return e.groupBy("k", "system_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category", "severity"))), lambda x: F.struct(x["category"].alias("category"), x["severity"].alias("severity"))).alias("errors"))


_TOP = ctes("errors") + ", t AS (SELECT *, row_number() OVER (PARTITION BY k, system_no ORDER BY sev_rank DESC, pos) AS place FROM errors) SELECT k, system_no, {} FROM t WHERE place = 1"
_NAME = "CASE sev_rank WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END"
query(_TOP.format(f"{_NAME} AS severity"), "max_severity_of_errors")(lambda s, d: _error_arrays(s, d).select("k", "system_no", C.max_severity_of_errors("errors").alias("severity")))
query(_TOP.format("category"), "primary_category_of_errors")(lambda s, d: _error_arrays(s, d).select("k", "system_no", C.primary_category_of_errors("errors").alias("category")))
query(_TOP.format(f"'fail' AS gold_verdict, {_NAME} AS gold_severity, category AS gold_category"), "gold_from_spans")(lambda s, d: sampling.gold_from_spans(_error_arrays(s, d)).drop("errors"))
query(ctes("answers") + "SELECT case_id, swapped FROM answers", "swap_verdict")(lambda s, d: view(s, d, "answers").select("case_id", C.swap_verdict("verdict").alias("swapped")))
query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug FROM documents", "slugify")(lambda s, d: _docs(s, d, slug=C.slugify("text")))
same("slugify_whole", "slugify")
query("""SELECT doc_id, sha256(concat('{"lang": "', lang, '", "source": "', source, '"}')) AS spaced, sha256(concat('{"lang":"', lang, '","source":"', source, '"}')) AS compact FROM documents""", "stable_digest")(
    lambda s, d: _docs(s, d, spaced=C.stable_digest(C.canonical_json({"source": F.col("source"), "lang": F.col("lang")})), compact=C.stable_digest(C.canonical_json({"source": F.col("source"), "lang": F.col("lang")}, compact=True)))
)
query("SELECT doc_id, CASE WHEN substr(sha256(source), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'A' ELSE 'B' END AS good FROM documents", "digest_parity_order")(
    lambda s, d: _docs(s, d, good=F.when(C.is_even_digest(F.sha2("source", 256)), "A").otherwise("B"))
)
query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('{"lang":"', lang, '"}') ELSE concat('{"lang":"', lang, '","source":"', source, '"}') END AS packed FROM documents""", "strip_null_fields")(
    lambda s, d: _docs(s, d, packed=C.strip_null_fields(F.struct("lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")), "struct<lang:string,source:string>"))
)
# Whole texts, cut into thirds a, b and c of which one or two are wrapped.
MARKUP = "CASE doc_id % 13 WHEN 0 THEN concat('<v>', t, '</v>', t) WHEN 1 THEN concat('<v>', t) WHEN 2 THEN concat(t, '</v>', t, '<v>') WHEN 3 THEN concat('<v><v>', t, '</v></v>') WHEN 4 THEN t WHEN 5 THEN concat('<v>', a, '</v>', b, '<v>', c, '</v>') ELSE concat(a, '<v>', b, '</v>', c) END"
_MARKED = f"""(SELECT doc_id, {MARKUP} AS marked, t, a, b, c FROM (
  SELECT doc_id, t, substr(t, 1, n) AS a, substr(t, n + 1, n) AS b, substr(t, 2 * n + 1) AS c FROM (
    SELECT doc_id, replace(coalesce(text, ''), '<', ' ') AS t, CAST(floor(length(coalesce(text, '')) / 3) AS INT) AS n FROM {{}}) w) x) y"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_MARKED.format('{documents}')}", documents=view(spark, sf_dir, "documents"))


query(
    f"""SELECT doc_id, doc_id % 13 NOT IN (1, 2, 3) AS valid,
  CASE doc_id % 13 WHEN 0 THEN t || t WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE t END AS clean,
  CASE doc_id % 13 WHEN 0 THEN '0-' || length(t) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '0-' || length(a) || ',' || length(a || b) || '-' || length(t) ELSE length(a) || '-' || length(a || b) END AS spans
FROM {_MARKED.format("documents")}""",
    "parse_span_markup",
)(
    lambda s, d: _marked(s, d).select("doc_id", C.parse_span_markup("marked").alias("m")).select("doc_id", "m.valid", "m.clean", F.array_join(F.transform("m.spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
)
query(f"SELECT doc_id, doc_id % 13 >= 5 AS aligned FROM {_MARKED.format('documents')}", "span_alignment_flag")(
    lambda s, d: sampling.span_alignment_flag(_marked(s, d).withColumn("incorrect", F.when(F.col("doc_id") % 13 >= 5, F.col("t")).otherwise("?")), "marked", "incorrect").select("doc_id", "aligned")
)
same("parse_span_markup_whole", "parse_span_markup")
same("span_alignment_flag_whole", "span_alignment_flag")
query(f"SELECT l_orderkey % 97 AS g, {_RATE.format('sum(l_linenumber)', 'sum(CAST(l_quantity AS BIGINT))')} AS rate FROM lineitem GROUP BY 1", "safe_rate")(
    lambda s, d: view(s, d, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("g")).agg(C.safe_rate(F.sum("l_linenumber"), F.sum(F.col("l_quantity").cast("bigint"))).alias("rate"))
)
query(ctes("pairs") + "SELECT id, coalesce(reference, 'unknown') AS reference, coalesce(candidate_b, 'unspecified') AS candidate_b FROM pairs", "case_metadata_defaults")(
    lambda s, d: view(s, d, "pairs").select("id", F.coalesce("reference", F.lit("unknown")).alias("reference"), F.coalesce("candidate_b", F.lit("unspecified")).alias("candidate_b"))
)
query(
    ctes("cases")
    + """SELECT case_id, 'candidate' AS candidate_role, case_id AS source_case_id, language_pair, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE origin END AS origin_suite, CASE WHEN k % 5 = 0 THEN 'unspecified' ELSE part END AS partition,
  mode AS gold_mode, gold_verdict, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE gold_severity END AS gold_severity, gold_category, 'unknown' AS phenomenon FROM cases""",
    "case_metadata",
)(
    lambda s, d: view(s, d, "cases")
    .select(
        "case_id",
        C.case_metadata_defaults(
            F.lit("candidate"),
            {"source_case_id": "case_id", "language_pair": "language_pair", "origin_suite": F.when(F.col("k") % 3 != 0, F.col("origin")), "partition": F.when(F.col("k") % 5 != 0, F.col("part")), "gold_mode": "mode",
             "gold_verdict": "gold_verdict", "gold_severity": F.when(F.col("k") % 7 != 0, F.col("gold_severity")), "gold_category": "gold_category"},
        ).alias("m"),
    )
    .select("case_id", "m.*")
)
# Nested values: what Spark holds, and the same spelled out, with nulls and without.
_NESTED = "struct<k:bigint,weight:double,none:string,errors:array<struct<sev_rank:int,category:string,evidence:boolean>>,by:map<string,struct<w:double,n:int>>>"
_ENTRY = """'{{"category": "' || category || '", {}"sev_rank": ' || sev_rank || '}}'"""
_SPELLED = """'{{"by": {{"a\\\"b": {{{}"w": ' || CAST(k + 0.25 AS DOUBLE) || '}}, "z": {{"n": 1, "w": 1e-05}}}}, "errors": [' || string_agg({}, ', ' ORDER BY pos) || '], "k": ' || k || ', {}"weight": 1e+16}}'"""
_WITH = _SPELLED.format('"n": null, ', _ENTRY.format("""\"evidence\": ' || CASE WHEN has_evidence THEN 'true' ELSE 'null' END || ', """), '"none": null, ')
_WITHOUT = _SPELLED.format("", _ENTRY.format("""' || CASE WHEN has_evidence THEN '"evidence": true, ' ELSE '' END || '"""), "")
query(
    ctes("errors") + f"SELECT k, sha256({_WITH}) AS spaced, sha256(replace(replace({_WITHOUT}, ': ', ':'), ', ', ',')) AS stripped FROM errors GROUP BY k",
    "canonical_text",
)(
    lambda s, d: view(s, d, "errors")
    .groupBy("k")
    .agg(F.array_sort(F.collect_list(F.struct("pos", "sev_rank", "category", F.when(F.col("has_evidence"), True).alias("evidence")))).alias("e"))
    .select(
        "k",
        F.struct(
            "k", F.lit(1e16).alias("weight"), F.lit(None).cast("string").alias("none"), F.transform("e", lambda x: x.dropFields("pos")).alias("errors"),
            F.create_map(F.lit("z"), F.struct(F.lit(1e-5).alias("w"), F.lit(1).alias("n")), F.lit('a"b'), F.struct((F.col("k") + 0.25).alias("w"), F.lit(None).cast("int").alias("n"))).alias("by"),
        ).alias("v"),
    )
    .select("k", C.stable_digest(C.canonical_text("v", _NESTED)).alias("spaced"), C.stable_digest(C.strip_null_fields("v", _NESTED)).alias("stripped"))
)
query(
    """SELECT o_orderkey, strftime(f, '%Y%m%dT%H%M%SZ') AS stamp, epoch_us(f) AS finished_us, epoch_us(f) - o_orderkey % 1000 * 1500 AS started_us
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS f FROM orders)""",
    "run_window",
)(
    lambda s, d: view(s, d, "orders")
    .select("o_orderkey", F.concat(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit("T"), F.date_format(F.timestamp_seconds(F.col("o_orderkey") % 86400), "HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("")).alias("iso"))
    .select("o_orderkey", C.run_window(C.utc_timestamp("iso"), (F.col("o_orderkey") % 1000).cast("double") * 0.0015).alias("w"))
    .select("o_orderkey", "w.stamp", F.unix_micros("w.finished").alias("finished_us"), F.unix_micros("w.started").alias("started_us"))
)
query(ctes("pairs") + "SELECT id, concat('source: ', source, ' candidate: ', candidate_a, CASE WHEN reference IS NULL THEN '' ELSE ' reference: ' || reference END) AS scored FROM pairs WHERE candidate_a IS NOT NULL", "scorer_text")(
    lambda s, d: view(s, d, "pairs").where("candidate_a is not null").select("id", C.scorer_text("source", "candidate_a", "reference").alias("scored"))
)
query("""SELECT doc_id, concat('Evaluation mode: single', chr(10), '{"language": "', lang, '", "site": "', source, '"}') AS request FROM documents""", "judge_request_text")(
    lambda s, d: _docs(s, d, request=C.judge_request_text(F.lit("single"), {"site": F.col("source"), "language": F.col("lang")}))
)

# --- sampling ----------------------------------------------------------------

_DIGEST = "sha256(concat('[\"', case_id, '\"]'))"


def _digest():
    return sampling.key_digest("case_id")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cases")


@query(
    ctes("errors")
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY k, system_no ORDER BY sev_rank DESC, pos) AS place FROM errors)
SELECT CAST(k AS STRING) AS seg_id, {_NAME} AS severity, category, category AS phenomenon FROM t WHERE place = 1"""
)
def group_mqm_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "errors").select(F.col("system_no").cast("string").alias("system"), F.col("k").cast("string").alias("seg_id"), "pos", F.initcap(C.severity_name("sev_rank")).alias("severity"), F.initcap("category").alias("category"))
    return sampling.group_mqm_ratings(e, keys=("system", "seg_id")).drop("system")


def _ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, outputs and ratings; a system has some of the segments only."""
    held = _error_arrays(spark, sf_dir).select(F.col("system_no").alias("system"), F.col("k").alias("segment"), "errors")
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), F.col("o_orderstatus").alias("doc"), F.col("o_orderpriority").alias("source"))
    rated = held.join(orders.select("segment", "doc"), "segment").select("system", "segment", F.when(F.col("doc") != "P", F.col("errors")).alias("errors"))
    return orders, held.select("system", "segment", F.concat(F.lit("t"), F.col("segment")).alias("output")), rated


_RATED = _TOP.split(" SELECT k,")[0] + ", r AS (SELECT t.*, o.o_orderstatus, o.o_orderpriority FROM t JOIN orders o ON o_orderkey = k WHERE place = 1 AND o_orderstatus <> 'P')"


@query(_RATED + " SELECT system_no AS system, k AS segment, o_orderpriority AS source, 't' || k AS output FROM r")
def rated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rated_segments(*_ratings(spark, sf_dir), strict=False).select("system", "segment", "source", "output")


@query(_RATED + f""" SELECT 'mqm-' || substr(sha256('["' || system_no || '", "' || k || '"]'), 1, 12) AS case_id, 'fail' AS gold_verdict, {_NAME} AS gold_severity, category AS gold_category FROM r""")
def rated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rated_cases(sampling.rated_segments(*_ratings(spark, sf_dir), strict=False), "mqm-").select("case_id", "gold_verdict", "gold_severity", "gold_category")


@query(ctes("runs") + "SELECT recipe, count(*) AS n FROM runs WHERE recipe IN ('r1', 'r3') GROUP BY recipe")
def filter_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.filter_systems(view(spark, sf_dir, "runs"), ["r1", "r3"], "recipe").groupBy("recipe").agg(F.count("*").alias("n"))


@query(ctes("cases") + "SELECT case_id FROM cases WHERE (language_pair, phenomenon) IN (SELECT language_pair, phenomenon FROM cases WHERE k < 40)")
def filter_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases(spark, sf_dir)
    return sampling.filter_strata(c, c.where("k < 40"), "language_pair", "phenomenon").select("case_id")


@query(
    ctes("cases")
    + f""", r AS (SELECT case_id, gold_rank, row_number() OVER (PARTITION BY gold_rank ORDER BY {_DIGEST}) AS round FROM cases)
SELECT case_id, row_number() OVER (ORDER BY round, gold_rank DESC) AS place FROM r QUALIFY place <= 50"""
)
def severity_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.severity_round_robin(_cases(spark, sf_dir), 50, digest=_digest()).select("case_id", "place")


@query(
    ctes("cases")
    + f""", r AS (SELECT case_id, language_pair, phenomenon, row_number() OVER (PARTITION BY language_pair, phenomenon ORDER BY {_DIGEST}) AS round FROM cases)
SELECT case_id, row_number() OVER (ORDER BY round, sha256('["' || language_pair || '", "' || phenomenon || '"]')) AS place FROM r QUALIFY place <= 150"""
)
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_round_robin(_cases(spark, sf_dir), ["language_pair", "phenomenon"], 150, digest=_digest()).select("case_id", "place")


@query(
    ctes("cases")
    + f""", r AS (SELECT language_pair, case_id, gold_severity, gold_category, row_number() OVER (PARTITION BY language_pair, gold_severity, gold_category ORDER BY {_DIGEST}) AS place FROM cases)
SELECT language_pair, CASE WHEN gold_severity = 'critical' THEN 1 WHEN gold_severity = 'major' THEN place + 1 ELSE 4 END AS slot, case_id FROM r
WHERE (gold_severity = 'critical' AND gold_category = 'accuracy' AND place = 1) OR (gold_severity = 'major' AND gold_category = 'fluency' AND place <= 2) OR (gold_severity = 'none' AND place = 1)"""
)
def slot_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = [("critical", "accuracy"), ("major", "fluency"), ("major", "fluency"), ("none", None)]
    return sampling.slot_quota_sample(_cases(spark, sf_dir), slots, by="language_pair", digest=_digest()).where("case_id is not null")


@query(
    ctes("cases")
    + f""", r AS (SELECT language_pair, phenomenon, case_id, row_number() OVER (PARTITION BY language_pair, phenomenon ORDER BY {_DIGEST}) AS occurrence FROM cases)
SELECT language_pair, phenomenon, occurrence, case_id FROM r WHERE occurrence <= 3"""
)
def slot_nth_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all language pairs."""
    c = _cases(spark, sf_dir)
    slots = c.select("language_pair", "phenomenon").distinct().withColumn("occurrence", F.explode(F.sequence(F.lit(1), F.lit(3))))
    out = sampling.slot_nth_sample(c, slots, ["language_pair", "phenomenon"], digest=_digest())
    return out.select("language_pair", "phenomenon", F.col("occurrence").cast("long").alias("occurrence"), "case_id")


same("slot_nth_sample_all", "slot_nth_sample")


@query(ctes("cases") + f"SELECT case_id, CASE WHEN row_number() OVER (ORDER BY {_DIGEST}) <= 100 THEN 'holdout' ELSE 'calibration' END AS split FROM cases")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.holdout_split(_cases(spark, sf_dir), 100).select("case_id", "split")


@query(
    ctes("pairs")
    + """, p AS (SELECT id, candidate_a AS good, candidate_b AS bad, substr(sha256('["' || id || '"]'), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS even FROM pairs WHERE candidate_b IS NOT NULL)
SELECT id, CASE WHEN even THEN good ELSE bad END AS first, CASE WHEN even THEN bad ELSE good END AS second, CASE WHEN even THEN 'candidate_a' ELSE 'candidate_b' END AS winner FROM p"""
)
def contrastive_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairs").where("candidate_b is not null").select("id", F.col("candidate_a").alias("good"), F.col("candidate_b").alias("incorrect"))
    return sampling.contrastive_cases(p, sampling.key_digest("id")).select("id", "first", "second", "winner")


@query(
    ctes("cases")
    + f""", r AS (SELECT {_DIGEST} AS d, gold_rank, row_number() OVER (PARTITION BY gold_rank ORDER BY {_DIGEST}) AS round FROM cases),
s AS (SELECT d, row_number() OVER (ORDER BY round, gold_rank DESC) AS place FROM r QUALIFY place <= 50)
SELECT sha256(string_agg(d, chr(10) ORDER BY place)) AS content_sha256, count(*) AS n FROM s"""
)
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.content_digest(sampling.severity_round_robin(_cases(spark, sf_dir), 50, digest=_digest()), place="place", digest="digest")


@query(ctes("cases", "errors") + "SELECT case_id FROM cases WHERE k IN (SELECT k FROM errors) ORDER BY k LIMIT 200")
def select_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the cases with labelled errors."""
    c = _cases(spark, sf_dir)
    return sampling.select_cases(c, c.join(view(spark, sf_dir, "errors").select("k"), "k", "left_semi"), 200).select("case_id")


same("select_cases_all", "select_cases")


@query(ctes("cases") + f"SELECT case_id, origin, CASE WHEN row_number() OVER (ORDER BY {_DIGEST}) <= 120 THEN 'holdout' ELSE 'calibration' END AS split FROM cases")
def assemble_mixed_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = judged(spark, sf_dir)
    return sampling.assemble_mixed_pack({o: c.where(F.col("origin") == o) for o in ("annotated", "contrastive", "authored")}, 120).select("case_id", "origin", "split")


@query(ctes("cases") + " UNION ALL ".join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS n FROM cases GROUP BY {k}" for k in ("origin", "part", "gold_severity", "language_pair")))
def pack_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pack_profile(_cases(spark, sf_dir), ["origin", "part", "gold_severity", "language_pair"])


# --- metrics -----------------------------------------------------------------

_REASON = """CASE WHEN coalesce(source, '') = '' THEN 'missing_source' WHEN coalesce(reference, '') = '' THEN 'missing_reference' WHEN mode NOT IN ('single', 'pairwise') THEN 'unsupported_mode'
  WHEN coalesce(candidate_a, '') = '' OR (mode = 'pairwise' AND coalesce(candidate_b, '') = '') THEN 'missing_hypothesis' END"""
LOW = {"up": False, "down": True}


def _metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scores")


def _gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_scores(spark, sf_dir).where("role = 'candidate'").join(_cases(spark, sf_dir).select("case_id", "gold_rank", "gold_verdict", "gold_severity", "language_pair"), "case_id")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_pairwise_verdict(_metric_scores(spark, sf_dir), lower_is_better=LOW)


PAIRED = (
    ctes("scores", "cases")
    + """, m0 AS (SELECT metric, case_id, max(ms) FILTER (WHERE role = 'candidate_a') AS a, max(ms) FILTER (WHERE role = 'candidate_b') AS b FROM scores WHERE role <> 'candidate' GROUP BY 1, 2),
m1 AS (SELECT metric, case_id, abs(a - b) AS margin_ms, CASE WHEN a = b THEN 'tie' WHEN (a > b) = (metric = 'up') THEN 'candidate_a' ELSE 'candidate_b' END AS verdict FROM m0),
m AS (SELECT m1.*, gold_verdict, language_pair, phenomenon, verdict = gold_verdict AS correct FROM m1 JOIN cases USING (case_id)) """
)
_PAIRED = "count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct) / count(*) AS accuracy, count(*) FILTER (WHERE verdict = 'tie') AS ties"
_SUMMARY = "count(*) AS n, CAST(sum(ms) AS DOUBLE) / count(*) / 1000 AS mean, min(ms) / 1000 AS minimum, max(ms) / 1000 AS maximum"


@query(
    ctes("pairs")
    + f""", p AS (SELECT * FROM pairs WHERE {_REASON} IS NULL)
SELECT id, id AS case_id, 'candidate' AS role, source, candidate_a AS hypothesis, reference FROM p WHERE mode = 'single'
UNION ALL SELECT id || '::candidate_a', id, 'candidate_a', source, candidate_a, reference FROM p WHERE mode = 'pairwise'
UNION ALL SELECT id || '::candidate_b', id, 'candidate_b', source, candidate_b, reference FROM p WHERE mode = 'pairwise'"""
)
def flatten_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.flatten_hypotheses(view(spark, sf_dir, "pairs"))


@query(ctes("pairs") + f"SELECT coalesce({_REASON}, 'selected') AS reason, count(*) AS n FROM pairs GROUP BY 1")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.skip_reasons(view(spark, sf_dir, "pairs"))


@query(
    ctes("pairs")
    + f""", p AS (SELECT * FROM pairs WHERE {_REASON} IS NULL)
SELECT CASE WHEN mode = 'single' THEN id ELSE id || '::candidate_a' END AS id, CAST(length(candidate_a) AS DOUBLE) / length(source) AS score FROM p
UNION ALL SELECT id || '::candidate_b', CAST(length(candidate_b) AS DOUBLE) / length(source) FROM p WHERE mode = 'pairwise'"""
)
def score_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hypotheses of single and pairwise cases."""
    return metrics.score_hypotheses(metrics.flatten_hypotheses(view(spark, sf_dir, "pairs")), lambda: lambda pdf: pdf["hypothesis"].str.len() / pdf["source"].str.len())


same("score_hypotheses_all", "score_hypotheses")
query(ctes("scores") + f"SELECT metric, {_SUMMARY} FROM scores GROUP BY metric", "score_summary")(lambda s, d: metrics.score_summary(_metric_scores(s, d)))
query(
    ctes("scores", "cases")
    + ", g AS (SELECT * FROM scores JOIN cases USING (case_id) WHERE role = 'candidate') "
    + " UNION ALL ".join(f"SELECT metric, '{k}' AS key, {k} AS value, {_SUMMARY} FROM g GROUP BY metric, {k}" for k in ("language_pair", "gold_verdict", "gold_severity")),
    "score_summary_by",
)(lambda s, d: metrics.score_summary_by(_gold_scores(s, d), "language_pair", "gold_verdict", "gold_severity"))
query(PAIRED + "SELECT metric, case_id, verdict, margin_ms FROM m", "metric_pairwise_verdict")(_verdicts)
query(PAIRED + f"SELECT metric, {_PAIRED} FROM m GROUP BY metric", "metric_pairwise_summary")(lambda s, d: metrics.metric_pairwise_summary(metrics.judged_pairs(_verdicts(s, d), _cases(s, d))))
query(PAIRED + f"SELECT metric, language_pair AS value, {_PAIRED}, CAST(sum(margin_ms) AS DOUBLE) / count(*) / 1000 AS mean_margin FROM m GROUP BY 1, 2", "metric_pairwise_by")(
    lambda s, d: metrics.metric_pairwise_by(metrics.judged_pairs(_verdicts(s, d), _cases(s, d)), "language_pair")
)
_HISTOGRAM = ctes("scores", "cases") + ", h AS (SELECT metric, {} AS r, ms, count(*) AS n FROM scores JOIN cases USING (case_id) WHERE role = 'candidate' GROUP BY 1, 2, 3) "
# Of `down`, the lower score is the better one.
_THETA = "SELECT g.metric, CAST(sum(g.n * w.n) AS BIGINT) AS comparisons, CAST(sum(CASE WHEN (g.metric = 'up' AND g.ms > w.ms OR g.metric = 'down' AND g.ms < w.ms) THEN g.n * w.n ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN g.ms = w.ms THEN g.n * w.n ELSE 0 END) AS BIGINT) AS ties, CAST(sum(CASE WHEN (g.metric = 'up' AND g.ms > w.ms OR g.metric = 'down' AND g.ms < w.ms) THEN g.n * w.n ELSE 0 END) AS BIGINT) / CAST(sum(g.n * w.n) AS BIGINT) AS accuracy FROM h g JOIN h w ON g.metric = w.metric AND g.r < w.r GROUP BY g.metric"


def _both_metrics(rank: Callable[..., DataFrame], spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    scores = _gold_scores(spark, sf_dir)
    return reduce(DataFrame.unionByName, [rank(scores.where(F.col("metric") == m), lower_is_better=low, **more) for m, low in LOW.items()])


query(_HISTOGRAM.format("gold_rank") + _THETA, "severity_ranking")(lambda s, d: _both_metrics(metrics.severity_ranking, s, d))
query(_HISTOGRAM.format("CASE WHEN gold_rank > 0 THEN 1 ELSE 0 END") + _THETA, "pass_fail_ranking")(lambda s, d: _both_metrics(metrics.severity_ranking, s, d, pass_fail=True))
query(_HISTOGRAM.format("gold_rank") + _THETA, "severity_ranking_theta")(lambda s, d: _both_metrics(metrics.severity_ranking_theta, s, d))

for _name in ("severity_ranking", "pass_fail_ranking", "severity_ranking_theta"):
    same(f"{_name}_all", _name)

# --- alignment ---------------------------------------------------------------

ALIGNED = PAIRED.replace("WITH ", "WITH ", 1) + (
    ", "
    + JUDGED.removeprefix("WITH ").split("answers AS (")[1].join(["answers AS (", ""])
    + """,
e0 AS (SELECT case_id, mode, gold_verdict, gold_rank, has_swap, CASE WHEN valid THEN verdict END AS base,
  CASE WHEN has_swap AND NOT swap_broken THEN CASE swap_verdict WHEN 'candidate_a' THEN 'candidate_b' WHEN 'candidate_b' THEN 'candidate_a' ELSE swap_verdict END END AS swap FROM j),
e1 AS (SELECT *, CASE WHEN swap IS NOT NULL THEN base IS NOT DISTINCT FROM swap END AS consistent FROM e0),
e2 AS (SELECT *, CASE WHEN coalesce(consistent, true) THEN base END AS effective FROM e1),
e AS (SELECT *, coalesce(effective = gold_verdict, false) AS correct, CASE WHEN base IS NULL THEN 'judge_invalid' WHEN NOT coalesce(consistent, true) THEN 'judge_position_inconsistent' END AS failure FROM e2),
x AS (SELECT e.*, m.metric, m.verdict AS metric_verdict, m.correct AS metric_correct FROM e JOIN m USING (case_id) WHERE e.mode = 'pairwise'),
c AS (SELECT *, CASE WHEN correct AND metric_correct THEN 'both_correct' WHEN correct THEN 'judge_only' WHEN metric_correct THEN 'metric_only' ELSE 'both_wrong' END AS category FROM x) """
)


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.effective_verdict(judged(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_evidence(_effective(spark, sf_dir), _verdicts(spark, sf_dir))


query(ALIGNED + "SELECT case_id, metric, effective, metric_verdict, correct, metric_correct FROM x", "align_evidence")(lambda s, d: _aligned(s, d).select("case_id", "metric", "effective", "metric_verdict", "correct", "metric_correct"))
query(ALIGNED + "SELECT case_id, effective, coalesce(CAST(consistent AS VARCHAR), '') AS consistent, correct, failure FROM e", "effective_verdict")(
    lambda s, d: _effective(s, d).select("case_id", "effective", F.coalesce(F.col("consistent").cast("string"), F.lit("")).alias("consistent"), "correct", "failure")
)
query(
    ALIGNED
    + """SELECT count(*) AS case_count, count(base) AS valid_base, count(*) FILTER (WHERE base = gold_verdict) / count(*) AS base_accuracy, count(*) FILTER (WHERE has_swap) AS swap_count,
  count(*) FILTER (WHERE consistent) / count(*) FILTER (WHERE has_swap) AS position_consistency, count(*) FILTER (WHERE correct) / count(*) AS effective_accuracy FROM e""",
    "judge_alignment_summary",
)(lambda s, d: alignment.judge_alignment_summary(_effective(s, d)))
query(ALIGNED + "SELECT metric, case_id, verdict, correct FROM m", "metric_case_verdict")(lambda s, d: metrics.judged_pairs(_verdicts(s, d), _cases(s, d)).select("metric", "case_id", "verdict", "correct"))
query(ALIGNED + "SELECT metric, category, count(*) AS n, count(*) FILTER (WHERE effective <> metric_verdict) AS disagreements FROM c WHERE effective IS NOT NULL GROUP BY 1, 2", "agreement_contingency")(
    lambda s, d: alignment.agreement_contingency(_aligned(s, d))
)
query(
    ALIGNED
    + "SELECT metric, count(*) AS pairs, count(*) FILTER (WHERE metric_correct) / count(*) AS metric_accuracy, count(effective) AS aligned, count(*) FILTER (WHERE effective IS NOT NULL AND category <> 'both_wrong') / count(effective) AS union_accuracy FROM c GROUP BY metric",
    "oracle_union_accuracy",
)(lambda s, d: alignment.oracle_union_accuracy(_aligned(s, d)))
query(
    ALIGNED + "SELECT metric, CASE WHEN correct THEN 'judge_correct' ELSE 'judge_wrong' END AS outcome, count(*) AS n, CAST(sum(ms) AS DOUBLE) / count(*) / 1000 AS mean FROM e JOIN scores USING (case_id) WHERE mode = 'single' AND role = 'candidate' GROUP BY 1, 2",
    "single_scores_by_judge_outcome",
)(lambda s, d: alignment.single_scores_by_judge_outcome(_effective(s, d), _metric_scores(s, d)))
query(
    ALIGNED
    + """, q AS (SELECT case_id, failure AS reason FROM e WHERE failure IS NOT NULL UNION SELECT case_id, 'judge_gold_mismatch' FROM e WHERE NOT correct
UNION SELECT case_id, 'judge_' || metric || '_disagreement' FROM c WHERE effective <> metric_verdict UNION SELECT case_id, 'judge_' || metric || '_both_wrong' FROM c WHERE effective IS NOT NULL AND category = 'both_wrong')
SELECT case_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM q GROUP BY case_id""",
    "review_queue",
)(lambda s, d: alignment.review_queue(_effective(s, d), _verdicts(s, d)))

# --- recipes -----------------------------------------------------------------

RUNS = ctes("runs", "items") + ", r AS (SELECT *, coalesce(status = 'completed' AND passed, false) AS ok FROM runs), p AS (SELECT a.recipe AS l, b.recipe AS r, a.case_id, a.track, a.ok AS lo, b.ok AS ro, a.case_no FROM r a JOIN r b ON a.case_id = b.case_id AND a.recipe < b.recipe)"
# Verdicts of a judge on soft cases, made from the case number.
_BASE = "CASE case_no % 7 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'neither' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'candidate_b' ELSE 'candidate_a' END"
_SWAP = "CASE case_no % 7 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'neither' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'candidate_a' WHEN 5 THEN 'candidate_a' ELSE 'candidate_b' END"
DECIDED = (
    RUNS
    + """, d AS (
SELECT l, r, case_id, CASE WHEN lo THEN 'left' WHEN ro THEN 'right' ELSE 'neither' END AS winner, 'hard_validation' AS src FROM p WHERE NOT (lo AND ro)
UNION ALL SELECT l, r, case_id, CASE case_no % 7 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'tie' WHEN 2 THEN 'neither' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'right' WHEN 5 THEN 'unresolved' ELSE 'left' END,
  CASE case_no % 7 WHEN 0 THEN 'judge_missing_or_invalid' WHEN 5 THEN 'judge_position_inconsistent' ELSE 'judge_position_consistent' END FROM p WHERE lo AND ro) """
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "runs")


def _pairs(r: DataFrame) -> DataFrame:
    """The tables leave gaps in the recipes' cases, so what both of two have is compared."""
    return recipes.paired_runs(r, strict=False)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    pairs = _pairs(r)
    soft = recipes.soft_comparison_cases(pairs)
    numbers = r.select("case_id", "case_no").distinct()
    verdicts = soft.select("left", "right", "case_id").join(numbers, "case_id").select("left", "right", "case_id", F.expr(_BASE).alias("base"), F.expr(_SWAP).alias("swap"))
    columns = ["left", "right", "case_id", "winner", "decision_source"]
    return recipes.hard_veto_decisions(pairs).select(*columns).unionByName(recipes.judged_decisions(soft, verdicts).select(*columns))


query(
    ctes("items") + "SELECT recipe, case_no, item_no, CASE WHEN item_no % 10 = 0 THEN 'execution_failure' WHEN NOT parity_failed AND has_finding THEN 'structured_output_failure' ELSE 'completed' END AS status FROM items",
    "execution_status",
)(lambda s, d: view(s, d, "items").select("recipe", "case_no", "item_no", recipes.execution_status(F.col("item_no") % 10 == 0, F.lit(True), F.when(F.col("parity_failed") | ~F.col("has_finding"), F.lit(True))).alias("status")))
query(ctes("runs") + "SELECT recipe, case_id, coalesce(CAST(passed AS VARCHAR), '') AS passed FROM runs", "hard_pass_flag")(
    lambda s, d: _runs(s, d).select("recipe", "case_id", F.coalesce(recipes.hard_pass_flag(F.col("status"), F.coalesce("passed", F.lit(True))).cast("string"), F.lit("")).alias("passed"))
)
query(
    RUNS
    + """, f AS (SELECT recipe, case_no, item_no, 'validation' AS source, code FROM items WHERE has_finding UNION ALL SELECT recipe, case_no, item_no, 'token_parity', NULL FROM items WHERE parity_failed)
SELECT * FROM f UNION ALL SELECT recipe, case_no, NULL, 'hard_validation', 'no_structured_finding' FROM runs WHERE passed = false AND (recipe, case_no) NOT IN (SELECT recipe, case_no FROM f)""",
    "explode_findings",
)(lambda s, d: recipes.explode_findings(_runs(s, d), view(s, d, "items")))
query(ctes("runs") + "SELECT recipe, case_id, quantity AS elapsed_seconds, unchanged AS valid_items_unchanged, exact AS reference_exact_match FROM runs", "automatic_metrics")(
    lambda s, d: recipes.automatic_metrics(_runs(s, d).select("recipe", "case_id", F.col("quantity").alias("elapsed_seconds"), F.struct(F.col("unchanged").alias("valid_items_unchanged"), F.col("exact").alias("reference_exact_match"), F.array(F.lit(1)).alias("items")).alias("score")))
)
_PROMPTS = "SELECT recipe, string_agg(DISTINCT sha256('p' || quantity % 3), ',' ORDER BY sha256('p' || quantity % 3)) AS prompts FROM runs GROUP BY recipe"
query(
    ctes("runs")
    + f""", s AS ({_PROMPTS}), t AS (SELECT *, sha256('{{"prompts":"' || prompts || '","recipe":"' || recipe || '"}}') AS snapshot_sha256 FROM s) SELECT *, recipe || '-' || substr(snapshot_sha256, 1, 12) AS recipe_id FROM t""",
    "recipe_snapshot",
)(lambda s, d: recipes.recipe_snapshot(_runs(s, d).withColumn("prompt_sha256", F.sha2(F.concat(F.lit("p"), F.col("quantity") % 3), 256))))
query(
    RUNS + "SELECT recipe, count(*) AS case_count, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'execution_failure') AS execution_failures, count(*) FILTER (WHERE status = 'structured_output_failure') AS structured_failures, count(*) FILTER (WHERE passed) AS hard_pass FROM r GROUP BY recipe",
    "run_summary",
)(lambda s, d: recipes.run_summary(_runs(s, d)))
query(RUNS + "SELECT recipe, case_id, ok AS eligible FROM r", "eligible")(lambda s, d: _runs(s, d).select("recipe", "case_id", recipes.eligible().alias("eligible")))
query(RUNS + "SELECT l AS \"left\", r AS \"right\", case_id, CASE WHEN lo THEN 'left' WHEN ro THEN 'right' ELSE 'neither' END AS winner FROM p WHERE NOT (lo AND ro)", "hard_veto_decisions")(
    lambda s, d: recipes.hard_veto_decisions(_pairs(_runs(s, d))).select("left", "right", "case_id", "winner")
)
query(RUNS + "SELECT l AS \"left\", r AS \"right\", substr(sha256(l || ':' || r), 1, 16) AS pair_id, case_id, track, CASE track WHEN 'repair' THEN 'repair' ELSE 'translate' END AS instruction FROM p WHERE lo AND ro", "soft_comparison_cases")(
    lambda s, d: recipes.soft_comparison_cases(_pairs(_runs(s, d)))
)
query(
    RUNS
    + f"""SELECT recipe, count(*) AS case_count, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE ok) AS hard_pass, count(*) FILTER (WHERE status = 'completed' AND unchanged) AS unchanged,
  count(*) FILTER (WHERE status = 'completed' AND NOT unchanged) AS over_edited, count(*) FILTER (WHERE status = 'completed' AND exact) AS exact_matches, {_rate("status = 'completed' AND NOT unchanged", "status = 'completed'")} AS over_edit_rate,
  coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (WHERE status = 'completed' AND NOT unchanged), '') AS over_edited_ids FROM r WHERE track = 'repair' GROUP BY recipe""",
    "repair_restraint",
)(lambda s, d: recipes.repair_restraint(_runs(s, d), list_ids=True))
query(RUNS + "SELECT recipe, case_id FROM r WHERE track = 'repair' AND status = 'completed' AND NOT unchanged", "over_edited_cases")(lambda s, d: recipes.over_edited_cases(_runs(s, d)))
query(DECIDED + "SELECT l AS \"left\", r AS \"right\", case_id, winner, src AS decision_source FROM d WHERE src <> 'hard_validation'", "judge_pair_decision")(lambda s, d: _decisions(s, d).where("decision_source <> 'hard_validation'"))
_COUNTS = ", ".join([*(f"count(*) FILTER (WHERE winner = '{w}') AS {w}_count" for w in ("left", "right", "tie", "neither", "unresolved", "uncertain")), *(f"count(*) FILTER (WHERE src = '{x}') AS {x}" for x in ("hard_validation", "judge_position_consistent", "judge_position_inconsistent", "judge_missing_or_invalid"))])
query(DECIDED + f'SELECT l AS "left", r AS "right", count(*) AS case_count, {_COUNTS} FROM d GROUP BY l, r', "pairwise_report")(lambda s, d: recipes.pairwise_report(_decisions(s, d)))
query(
    DECIDED
    + """, t AS (SELECT l AS recipe, winner, 'left' AS side FROM d UNION ALL SELECT r, winner, 'right' FROM d),
c AS (SELECT recipe, count(*) FILTER (WHERE winner = side) AS wins, count(*) FILTER (WHERE winner IN ('left', 'right') AND winner <> side) AS losses, count(*) FILTER (WHERE winner = 'tie') AS ties, count(*) FILTER (WHERE winner = 'neither') AS neither, count(*) FILTER (WHERE winner IN ('unresolved', 'uncertain')) AS unresolved FROM t GROUP BY recipe),
h AS (SELECT recipe, count(*) FILTER (WHERE ok) AS hard_passes FROM r GROUP BY recipe)
SELECT *, rank() OVER (ORDER BY wins DESC, losses) AS rank FROM c JOIN h USING (recipe)""",
    "tournament_standings",
)(lambda s, d: recipes.tournament_standings(_decisions(s, d), _runs(s, d)))

# --- judge runs --------------------------------------------------------------

_WANTED = "origin = 'contrastive' OR k % 5 = 0"
TASKS = ctes("answers") + f", t AS (SELECT case_id, k % 20 AS run, 'judge_output' AS field FROM answers WHERE kind = 'missing' UNION ALL SELECT case_id, k % 20, 'swap_judge_output' FROM answers WHERE ({_WANTED}) AND NOT has_swap) "


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).withColumn("run", F.col("k") % 20).withColumn("ab_swap", F.col("k") % 5 == 0)
    return runs.plan_judge_tasks(j)


query(TASKS + "SELECT * FROM t", "plan_judge_tasks")(_tasks)
query(
    ctes("pairs", "cases") + "SELECT p.id || '::swap' AS case_id, candidate_b AS candidate_a, candidate_a AS candidate_b, CASE conv_id % 3 WHEN 0 THEN 'tie' WHEN 1 THEN 'candidate_b' ELSE 'candidate_a' END AS gold_verdict FROM pairs p",
    "swap_case",
)(lambda s, d: runs.swap_case(view(s, d, "pairs").select(F.col("id").alias("case_id"), "candidate_a", "candidate_b", F.expr("CASE conv_id % 3 WHEN 0 THEN 'tie' WHEN 1 THEN 'candidate_a' ELSE 'candidate_b' END").alias("gold_verdict"))))
query(
    TASKS + ", n AS (SELECT run, count(*) AS planned FROM t GROUP BY run) SELECT DISTINCT k % 20 AS run, coalesce(planned, 0) AS planned, 100 + k % 20 * 10 AS max_calls, coalesce(planned, 0) <= 100 + k % 20 * 10 AS within FROM answers LEFT JOIN n ON n.run = k % 20",
    "budget_check",
)(lambda s, d: runs.budget_check(_tasks(s, d), view(s, d, "orders").select((F.col("o_orderkey") % 20).alias("run")).distinct().withColumn("max_calls", F.col("run") * 10 + 100)))
query(JUDGED + "SELECT case_id, valid AS reused_base, (has_swap AND NOT swap_broken) AS reused_swap FROM j", "resume_merge")(
    lambda s, d: (
        lambda j: runs.resume_merge(
            j.select("case_id"),
            contracts.parsed_judge(contracts.parsed_judge(j, "case_id", "judge_output", "base"), "case_id", "swap_judge_output", "swap").select("case_id", F.col("base_failure").isNull().alias("base_ok"), F.col("swap_failure").isNull().alias("swap_ok")),
        )
    )(judged(s, d))
)
query("SELECT c_custkey AS run, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'model,max_tokens' ELSE 'model' END WHEN c_custkey % 3 = 0 THEN 'max_tokens' ELSE '' END AS mismatches FROM customer", "resume_compatibility")(
    lambda s, d: (
        lambda c: runs.resume_compatibility(
            c,
            c.withColumn("model", F.when(F.col("run") % 4 == 0, F.concat("model", F.lit("-old"))).otherwise(F.col("model"))).withColumn("max_tokens", F.when(F.col("run") % 3 != 0, F.col("max_tokens"))),
        )
    )(
        view(s, d, "customer").select(
            F.col("c_custkey").alias("run"), F.col("c_name").alias("model"), F.col("c_nationkey").cast("string").alias("profile"), F.when(F.col("c_custkey") % 5 != 0, "1").alias("prompt_revision"), (F.col("c_custkey") % 1000).alias("max_tokens"), F.lit("low").alias("reasoning_effort")
        )
    )
)
query(
    TASKS + "SELECT case_id, field, CASE WHEN run <> 7 THEN 'done ' || field END AS output, CASE WHEN run = 7 THEN 'benchmark_failure: ValueError' END AS failure FROM t",
    "apply_judge",
)(lambda s, d: runs.apply_judge(_tasks(s, d), _stub_judge))


def _stub_judge() -> Callable[[dict], str]:
    def judge_one(row: dict) -> str:
        if row["run"] == 7:
            raise ValueError("no answer")
        return "done " + row["field"]

    return judge_one


# Usage as three providers report it, from an event's token number.
CALLS = (
    ctes("calls")
    + """, u AS (SELECT event_id, run, outcome, provider, tokens % 50 AS hit,
  CASE WHEN provider = 'cached' AND tokens % 3 = 0 AND tokens % 11 > 0 THEN tokens % 11 ELSE greatest(tokens - tokens % 50, 0) END AS miss,
  tokens % 40 AS output, CASE provider WHEN 'cached' THEN 0 ELSE tokens % 30 END AS reasoning, CASE WHEN provider = 'ticked' THEN tokens % 4 * 1000000 ELSE 0 END AS ticks FROM calls),
s AS (SELECT *, CASE provider WHEN 'free' THEN 0.0 WHEN 'ticked' THEN CASE WHEN ticks > 0 THEN round_even(CAST(ticks AS DOUBLE) / 10000000000, 10) ELSE round_even(hit * 0.2::DOUBLE + miss * 2.0::DOUBLE + (output + reasoning) * 6.0::DOUBLE, 0) / 1000000 END
  ELSE round_even(hit * 0.025::DOUBLE + miss * 3.0::DOUBLE + (output + reasoning) * 6.0::DOUBLE, 0) / 1000000 END AS cost,
  CASE provider WHEN 'free' THEN 'free_tier' WHEN 'ticked' THEN CASE WHEN ticks > 0 THEN 'ticks' ELSE 'token_estimate' END ELSE 'token_estimate' END AS cost_source FROM u) """
)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    cached = F.to_json(F.struct(t.alias("prompt_tokens"), (t % 40).alias("completion_tokens"), (t % 50).alias("prompt_cache_hit_tokens"), F.when(t % 3 == 0, t % 11).alias("prompt_cache_miss_tokens")))
    ticked = F.to_json(F.struct(t.alias("input_tokens"), (t % 40).alias("output_tokens"), F.struct((t % 50).alias("cached_tokens")).alias("input_tokens_details"), F.struct((t % 30).alias("reasoning_tokens")).alias("output_tokens_details"), (t % 4 * 1000000).alias("cost_in_usd_ticks")))
    free = F.to_json(F.struct(t.alias("promptTokenCount"), (t % 50).alias("cachedContentTokenCount"), (t % 40).alias("candidatesTokenCount"), (t % 30).alias("thoughtsTokenCount")))
    usage = F.when(F.col("provider") == "cached", cached).when(F.col("provider") == "ticked", ticked).otherwise(free)
    return runs.normalize_usage(view(spark, sf_dir, "calls").withColumn("usage", usage)).drop("usage", "tokens")


def prices(spark: SparkSession) -> DataFrame:
    """Price per million tokens by kind of provider; ticks per currency unit; whether it is free."""
    rows = [("cached", 0.025, 3.0, 6.0, 0, False), ("ticked", 0.2, 2.0, 6.0, 10_000_000_000, False), ("free", 0.0, 0.0, 0.0, 0, True)]
    return spark.createDataFrame(rows, "provider string, hit double, miss double, output double, ticks_per_unit long, free boolean")


query(CALLS + "SELECT event_id, run, outcome, provider, hit, miss, output, reasoning, ticks FROM u", "normalize_usage")(_usage)
query(CALLS + "SELECT event_id, provider, cost, cost_source FROM s", "usage_cost")(lambda s, d: runs.usage_cost(_usage(s, d), prices(s)).select("event_id", "provider", "cost", "cost_source"))
query(
    CALLS + "SELECT run, count(*) AS calls, count(*) FILTER (WHERE outcome IN ('error', 'timeout', 'failure', 'refund')) AS failures, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("hit", "miss", "output", "reasoning", "ticks")) + " FROM u GROUP BY run",
    "run_rollup",
)(lambda s, d: runs.run_rollup(_usage(s, d)))
query(
    CALLS + "SELECT event_id AS segment, run, CAST(round(cost * 1000000) AS BIGINT) AS cost_micros, CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) OVER (PARTITION BY run ORDER BY event_id) AS BIGINT) AS cumulative FROM s",
    "cumulative_cost",
)(lambda s, d: runs.cumulative_cost(runs.usage_cost(_usage(s, d), prices(s)).select(F.col("event_id").alias("segment"), "run", F.round(F.col("cost") * 1000000).cast("long").alias("cost_micros"))))


# Outputs of an earlier run put into cases that have none.
query(JUDGED + "SELECT case_id, CAST(valid AS INT) + CAST(has_swap AND NOT swap_broken AS INT) AS reused, valid AS has_base, (has_swap AND NOT swap_broken) AS has_swap_output FROM j", "resume_outputs")(
    lambda s, d: (lambda j: runs.resume_outputs(j.select("case_id"), j))(judged(s, d)).select("case_id", "reused", F.col("judge_output").isNotNull().alias("has_base"), F.col("swap_judge_output").isNotNull().alias("has_swap_output"))
)
query(
    TASKS + "SELECT case_id, field, CASE field WHEN 'judge_output' THEN case_id ELSE case_id || '::swap' END AS request_id, CASE field WHEN 'judge_output' THEN 'a of ' ELSE 'b of ' END || case_id AS candidate_a FROM t",
    "judge_requests",
)(
    lambda s, d: runs.judge_requests(
        _tasks(s, d), view(s, d, "cases").select("case_id", F.concat(F.lit("a of "), "case_id").alias("candidate_a"), F.concat(F.lit("b of "), "case_id").alias("candidate_b"), "gold_verdict")
    ).select("case_id", "field", "request_id", "candidate_a")
)
query(
    ctes("pairs")
    + f""", p AS (SELECT * FROM pairs WHERE {_REASON} IS NULL)
SELECT CASE WHEN mode = 'single' THEN id ELSE id || '::candidate_a' END AS id, CAST(length(candidate_a) AS DOUBLE) AS score, 'letters' AS metric, 'qe' AS mode, 'lower_is_better' AS direction FROM p
UNION ALL SELECT id || '::candidate_b', CAST(length(candidate_b) AS DOUBLE), 'letters', 'qe', 'lower_is_better' FROM p WHERE mode = 'pairwise'""",
    "score_hypotheses_directed",
)(lambda s, d: metrics.score_hypotheses(metrics.flatten_hypotheses(view(s, d, "pairs")), lambda: lambda pdf: pdf["hypothesis"].str.len(), mode="qe", metric="letters", lower_is_better=True))
query(
    ctes("runs")
    + """, s AS (SELECT 'p ' || recipe AS provider, track, '["' || string_agg(DISTINCT sha256('p' || quantity % 3), '","' ORDER BY sha256('p' || quantity % 3)) || '"]' AS prompts FROM runs GROUP BY recipe, track),
t AS (SELECT provider, track, '{"adapter_revision":"1","fixture_sha256":"' || sha256(track) || '","model_id":"M/1","model_label":"M","policy":{"limits":[1.0,0.5],"note":null},"prompt_sha256":' || prompts || ',"provider":"' || provider || '","track":"' || track || '"}' AS snapshot FROM s)
SELECT provider, track, snapshot, sha256(snapshot) AS snapshot_sha256, replace(provider, ' ', '-') || '.m-1.' || track AS recipe_id FROM t""",
    "artifact_recipes",
)(
    lambda s, d: recipes.artifact_recipes(
        _runs(s, d).select(
            F.concat(F.lit("p "), "recipe").alias("provider"), F.lit("M/1").alias("model_id"), F.lit("M").alias("model_label"), "track", F.sha2("track", 256).alias("fixture_sha256"), F.sha2(F.concat(F.lit("p"), F.col("quantity") % 3), 256).alias("prompt_sha256"),
            F.struct(F.lit(None).cast("string").alias("note"), F.array(F.lit(1.0), F.lit(0.5)).cast("array<double>").alias("limits")).alias("policy"),
        ),
        revision="1",
    ).select("provider", "track", "snapshot", "snapshot_sha256", "recipe_id")
)
