"""Projections of the star-schema tables to the shapes that the evaluation operators read.

Each is one SELECT in the SQL that Spark and other ANSI engines share, so that
an oracle can start from the same rows. `{sha}` is the engine's SHA-256.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")

SQL = {
    # Annotated errors, numbered within their case.
    "errors": """
SELECT l_orderkey AS k, CAST(round(l_discount * 100) AS INT) - 7 AS sev_rank,
  CASE l_returnflag WHEN 'R' THEN 'accuracy' WHEN 'A' THEN 'fluency' ELSE 'style' END AS category,
  l_linestatus = 'O' AS has_evidence, l_suppkey % 5 AS system_no,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS pos
FROM lineitem WHERE round(l_discount * 100) >= 8""",
    "first_errors": """
SELECT k, sev_rank AS top_rank, category AS top_category FROM (
  SELECT k, sev_rank, category, row_number() OVER (PARTITION BY k ORDER BY sev_rank DESC, pos) AS place FROM errors) ranked WHERE place = 1""",
    "cases": """
SELECT concat('case-', CAST(o_orderkey AS STRING)) AS case_id, o_orderkey AS k,
  CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE 'pairwise' END AS mode,
  concat(lower(substr(r_name, 1, 2)), '-', CASE o_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'ja' END) AS language_pair,
  lower(substr(o_orderpriority, 3)) AS phenomenon,
  CASE o_orderstatus WHEN 'F' THEN 'annotated' WHEN 'O' THEN 'contrastive' ELSE 'authored' END AS origin,
  CASE WHEN o_orderkey % 4 = 0 THEN 'holdout' ELSE 'calibration' END AS part,
  coalesce(top_rank, 0) AS gold_rank, coalesce(top_category, 'none') AS gold_category,
  CASE coalesce(top_rank, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END AS gold_severity,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN coalesce(top_rank, 0) = 0 THEN 'pass' ELSE 'fail' END
       WHEN o_orderkey % 20 = 1 THEN 'tie'
       WHEN substr({sha_key}, 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'candidate_a' ELSE 'candidate_b' END AS gold_verdict
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN first_errors ON k = o_orderkey""",
    # One row per hypothesis and metric, scores in thousandths.
    "scores": """
SELECT case_id, metric, role, CASE metric WHEN 'up' THEN ms ELSE 999 - ms END AS ms FROM (
  SELECT case_id, CASE mode WHEN 'single' THEN 'candidate' ELSE 'candidate_a' END AS role, k * 7919 % 1000 AS ms FROM cases
  UNION ALL
  SELECT case_id, 'candidate_b' AS role, CASE WHEN k % 29 = 0 THEN k * 7919 % 1000 ELSE k * 6101 % 997 END AS ms FROM cases WHERE mode = 'pairwise') s
CROSS JOIN (SELECT 'up' AS metric UNION ALL SELECT 'down' AS metric) m""",
    # What a judge has answered, as plain values.
    "answers": """
SELECT a.*,
  CASE verdict WHEN 'candidate_a' THEN 'candidate_b' WHEN 'candidate_b' THEN 'candidate_a' ELSE verdict END AS swapped,
  CASE WHEN k % 9 = 0 THEN verdict WHEN verdict = 'candidate_a' THEN 'candidate_b' WHEN verdict = 'candidate_b' THEN 'candidate_a' ELSE verdict END AS swap_verdict
FROM (SELECT c.*,
  CASE WHEN k % 10 < 7 THEN gold_rank ELSE (gold_rank + k) % 4 END AS pred_rank,
  CASE WHEN mode = 'single' THEN CASE WHEN k % 11 = 0 THEN 'uncertain' WHEN (CASE WHEN k % 10 < 7 THEN gold_rank ELSE (gold_rank + k) % 4 END) = 0 THEN 'pass' ELSE 'fail' END
       WHEN k % 10 < 8 THEN gold_verdict WHEN gold_verdict = 'tie' THEN 'neither' WHEN gold_verdict = 'candidate_a' THEN 'candidate_b' ELSE 'candidate_a' END AS verdict,
  CASE origin WHEN 'annotated' THEN 'high' WHEN 'contrastive' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN k % 53 = 0 THEN 'text' WHEN k % 59 = 0 THEN 'mode' WHEN k % 61 = 0 THEN 'case' WHEN k % 67 = 0 THEN 'missing' ELSE 'sound' END AS kind,
  mode = 'pairwise' AND k % 4 <> 3 AS has_swap, k % 71 = 0 AS swap_broken, k % 3 = 0 AS excerpt, k % 6 = 0 AS minor_first
  FROM cases c) a""",
    # A run's output for each recipe and case.
    "runs": """
SELECT * FROM (
  SELECT concat('r', CAST(l_suppkey % 4 AS STRING)) AS recipe, l_partkey AS case_no, concat('case-', CAST(l_partkey AS STRING)) AS case_id,
    CASE WHEN l_partkey % 3 = 0 THEN 'repair' ELSE 'translation' END AS track,
    CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 'execution_failure' WHEN 1 THEN 'structured_output_failure' ELSE 'completed' END AS status,
    CASE WHEN CAST(l_quantity AS INT) % 10 > 1 THEN l_returnflag <> 'R' END AS passed,
    l_linestatus = 'O' AS unchanged, l_returnflag = 'A' AS exact,
    l_orderkey AS orderkey, CAST(l_quantity AS INT) AS quantity,
    row_number() OVER (PARTITION BY l_suppkey % 4, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS place
  FROM lineitem) x WHERE place = 1""",
    # Items with findings, many to a run's case.
    "items": """
SELECT concat('r', CAST(l_suppkey % 4 AS STRING)) AS recipe, l_partkey AS case_no,
  CAST(row_number() OVER (PARTITION BY l_suppkey % 4, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS item_no,
  round(l_discount * 100) >= 9 AS has_finding, l_returnflag AS code, round(l_tax * 100) >= 7 AS parity_failed
FROM lineitem""",
    "pairs": """
SELECT conv_id, turn, concat('p-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CASE WHEN turn % 5 = 4 THEN 'batch' WHEN turn % 2 = 0 THEN 'pairwise' ELSE 'single' END AS mode, text AS source,
  CASE WHEN turn % 3 < 2 THEN role END AS reference,
  lead(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS candidate_a, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS candidate_b
FROM conversations""",
    "calls": """
SELECT event_id, user_id AS run, event_type AS outcome, CAST(floor(value * 100) AS BIGINT) AS tokens,
  CASE event_id % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'ticked' ELSE 'free' END AS provider
FROM events""",
    "docs": """
SELECT d.doc_id, d.text, d.lang, d.source, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
NEEDS = {name: [v for v in (*SQL, *TABLES) if v != name and re.search(rf"\b(FROM|JOIN) {v}\b", text)] for name, text in SQL.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or one of the tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace("{sha_key}", "sha2(CAST(o_orderkey AS STRING), 256)")
    inputs = {v: view(spark, sf_dir, v) for v in NEEDS[name]}
    for v in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {v}\b", rf"\1 {{{v}}}", text)
    return spark.sql(text, **inputs)


def ctes(*names: str) -> str:
    """WITH clause of the projections, for an oracle."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for v in NEEDS[name]:
            if v in SQL:
                add(v)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].replace('{sha_key}', 'sha256(CAST(o_orderkey AS STRING))')})" for n in ordered)


def judge_json(answers: DataFrame) -> DataFrame:
    """The answers as a judge would send them: `judge_output` and `swap_judge_output` as JSON text, null where there is none."""

    def output(verdict, mode, case, broken):
        error = lambda severity: F.struct(
            F.when(F.col("mode") == "single", "candidate").otherwise("candidate_a").alias("candidate"),
            F.when((F.col("k") % 7 == 0) | (F.col("gold_category") == "none"), "other").otherwise(F.col("gold_category")).alias("category"),
            severity.alias("severity"),
            F.lit("why").alias("explanation"),
            F.when(F.col("excerpt"), F.lit("bit")).alias("source_excerpt"),
        )
        rank = F.greatest(F.col("pred_rank"), F.lit(1))
        own = error(F.get(F.array(F.lit("none"), F.lit("minor"), F.lit("major"), F.lit("critical")), rank.cast("int")))
        errors = (
            F.when(verdict != "fail", F.array().cast("array<struct<candidate:string,category:string,severity:string,explanation:string,source_excerpt:string>>"))
            .when(F.col("minor_first"), F.array(error(F.lit("minor")), own))
            .otherwise(F.array(own))
        )
        body = F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"),
                case.alias("case_id"),
                F.struct(F.lit("p").alias("profile"), F.lit("m").alias("model"), F.lit("1").alias("prompt_revision"), F.lit("1").alias("calibration_revision")).alias("judge"),
                F.struct(
                    mode.alias("mode"), verdict.alias("verdict"), F.col("confidence").alias("confidence"), errors.alias("errors"), F.lit("because").alias("rationale"), F.array(F.lit("short")).alias("limitations")
                ).alias("evaluation"),
            )
        )
        return F.when(broken, F.concat(body, F.lit("\n```"))).otherwise(body)

    other_mode = F.when(F.col("mode") == "single", "pairwise").otherwise("single")
    mode = F.when(F.col("kind") == "mode", other_mode).otherwise(F.col("mode"))
    case = F.when(F.col("kind") == "case", F.concat("case_id", F.lit("-x"))).otherwise(F.col("case_id"))
    base = F.when(F.col("kind") != "missing", output(F.col("verdict"), mode, case, F.col("kind") == "text"))
    swap = F.when(F.col("has_swap"), output(F.col("swap_verdict"), F.col("mode"), F.col("case_id"), F.col("swap_broken")))
    return answers.withColumn("judge_output", base).withColumn("swap_judge_output", swap)
