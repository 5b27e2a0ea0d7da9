"""Queries over the readers and the writer: the driver's tables are written as artifacts to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualispark.operators import contracts
from qualispark.plans.catalog import query
from qualispark.plans.views import ctes, view
from qualispark.sources import readers

#: Cases of a document.
EACH = 64


def _lines(spark: SparkSession, documents: DataFrame) -> str:
    """The path of the documents, one JSON object a line."""
    path = readers.scratch(spark)
    documents.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def _gathered(df: DataFrame, keys: list[Column], order: Column, entry: Column, name: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))).alias("rows"))
    return rows.withColumn(name, F.transform("rows", lambda r: r["e"])).drop("rows")


@query(
    ctes("cases")
    + f"""SELECT 'pack-' || CAST(k // {EACH} AS VARCHAR) AS pack_id, 'translation' AS suite, row_number() OVER (PARTITION BY k // {EACH} ORDER BY k) - 1 AS pos,
  case_id, origin, part, mode, gold_verdict, gold_severity, gold_category, phenomenon FROM cases"""
)
def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.struct("mode", F.col("gold_verdict").alias("verdict"), F.col("gold_severity").alias("max_severity"), F.col("gold_category").alias("primary_category"), "phenomenon")
    case = F.struct(F.col("case_id").alias("id"), F.col("origin").alias("origin_suite"), F.col("part").alias("partition"), F.struct(F.col("language_pair").alias("source")).alias("input"), gold.alias("gold"))
    packs = _gathered(view(spark, sf_dir, "cases"), [F.concat(F.lit("pack-"), F.expr(f"k div {EACH}")).alias("id")], F.col("k"), case, "cases")
    path = _lines(spark, packs.select(F.lit(1).alias("schema_version"), "id", F.lit("translation").alias("suite"), "cases"))
    return readers.read_cases(spark, path, lines=True).select(
        "pack_id", "suite", F.col("pos").cast("long").alias("pos"), "case_id", "origin", "part", "mode", "gold_verdict", "gold_severity", "gold_category", "phenomenon"
    )


@query(
    ctes("scores")
    + f"""SELECT 'pack-' || CAST(CAST(substr(case_id, 6) AS BIGINT) // {EACH} AS VARCHAR) AS pack_id, case_id || '/' || role AS id, metric,
  CASE metric WHEN 'up' THEN 'higher_is_better' ELSE 'lower_is_better' END AS direction, CAST(ms AS DOUBLE) / 1000 AS score, case_id AS source FROM scores"""
)
def read_metric_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs and results are written side by side, from one pass over the scores: a pack's texts are those of its metric 'up'."""
    s = view(spark, sf_dir, "scores").withColumn("pack", F.concat(F.lit("pack-"), F.expr(f"CAST(substr(case_id, 6) AS BIGINT) div {EACH}"))).withColumn("name", F.concat_ws("/", "case_id", "role"))
    case = F.struct(F.col("case_id").alias("source"), F.col("role").alias("hypothesis"), (F.col("ms") / 1000).alias("score"))
    gathered = _gathered(s, [F.col("pack"), F.col("metric").alias("m")], F.col("name"), F.struct(F.col("name").alias("id"), case.alias("c")), "rows_of")
    texts = F.transform("rows_of", lambda r: F.struct(r["id"].alias("id"), r["c"]["source"].alias("source"), r["c"]["hypothesis"].alias("hypothesis")))
    scores = F.transform("rows_of", lambda r: F.struct(r["id"].alias("id"), r["c"]["score"].alias("score")))
    direction = F.when(F.col("m") == "up", "higher_is_better").otherwise("lower_is_better")
    pack = F.when(F.col("m") == "up", F.to_json(F.struct(F.col("pack").alias("id"), texts.alias("cases"))))
    result = F.to_json(F.struct(F.col("pack").alias("pack_id"), F.struct(F.col("m").alias("name"), direction.alias("direction")).alias("metric"), scores.alias("cases")))
    path = readers.scratch(spark)
    documents = gathered.select(F.inline(F.array(F.struct(F.lit("pack").alias("kind"), pack.alias("value")), F.struct(F.lit("result").alias("kind"), result.alias("value")))))
    documents.where("value IS NOT NULL").write.partitionBy("kind").text(path)
    return readers.read_metric_tables(spark, f"{path}/kind=pack", f"{path}/kind=result", lines=True).select("pack_id", "id", "metric", "direction", "score", "source")


@query(
    ctes("runs")
    + f"SELECT recipe || '-' || CAST(case_no // {EACH} AS VARCHAR) AS run_id, 'translation' AS suite, recipe, sha256(recipe) AS recipe_sha256, case_id, track, status, passed FROM runs"
)
def read_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.struct(F.col("case_id").alias("id"), "track", F.col("status").alias("execution_status"), F.struct(F.lit(True).alias("enabled"), "passed").alias("hard_validation"))
    runs = _gathered(view(spark, sf_dir, "runs"), [F.col("recipe").alias("r"), F.expr(f"case_no div {EACH}").alias("part")], F.col("case_no"), case, "cases")
    documents = runs.select(F.concat_ws("-", "r", "part").alias("run_id"), F.lit("translation").alias("suite"), F.struct(F.col("r").alias("id"), F.sha2("r", 256).alias("sha256")).alias("recipe"), "cases")
    return readers.read_runs(spark, _lines(spark, documents), suite="translation", lines=True)


@query(
    ctes("pairs")
    + """SELECT id, CASE WHEN coalesce(source, '') = '' THEN 'source' WHEN coalesce(candidate_a, '') = '' THEN 'good-translation'
  WHEN coalesce(candidate_b, '') = '' THEN 'incorrect-translation' WHEN coalesce(reference, '') = '' THEN 'reference' END AS issue, length(source) AS chars FROM pairs"""
)
def read_contrastive_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = view(spark, sf_dir, "pairs").select(
        F.col("id").alias("ID"), "source", F.col("candidate_a").alias("good-translation"), F.col("candidate_b").alias("incorrect-translation"), "reference", F.col("mode").alias("phenomena"), F.lit("en-de").alias("langpair")
    )
    out = readers.read_contrastive_jsonl(spark, _lines(spark, line), fail_fast=False)
    return out.select(F.col("ID").alias("id"), "issue", F.length("source").cast("long").alias("chars"))


@query(
    ctes("pairs")
    + f""", f AS (SELECT conv_id // {EACH} AS file, count(*) AS n FROM pairs GROUP BY 1)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE mode IN ('single', 'pairwise')) AS matching_rows, count(*) AS numbers, (SELECT CAST(sum(n * (n + 1) // 2) AS BIGINT) FROM f) AS number_sum FROM pairs"""
)
def contrastive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in all, rows of two phenomena, and the line numbers of the files: from 1 in each, none twice. A file holds the turns of a few conversations."""
    path = readers.scratch(spark)
    pairs = view(spark, sf_dir, "pairs").withColumn("part", F.expr(f"conv_id div {EACH}"))
    pairs.select(F.to_json(F.struct("id", F.col("mode").alias("phenomena"))).alias("value"), "part").repartition("part").write.partitionBy("part").text(path)
    rows = readers.read_contrastive_jsonl(spark, path, fail_fast=False)
    numbers = rows.agg(F.count_distinct("file", "line_number").alias("numbers"), F.sum("line_number").alias("number_sum"))
    return readers.contrastive_counts(rows, phenomena=["single", "pairwise"]).crossJoin(numbers)


@query(ctes("errors") + "SELECT k, pos, 's' || CAST(system_no AS VARCHAR) AS system, category, CASE sev_rank WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' ELSE 'Critical' END AS severity, 'a \"b\" ' || category AS said FROM errors")
def read_mqm_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("CASE sev_rank WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' ELSE 'Critical' END")
    rows = view(spark, sf_dir, "errors").select("k", F.col("pos").alias("place"), F.concat(F.lit("s"), "system_no").alias("system"), "category", severity.alias("severity"), F.concat(F.lit('a "b" '), "category").alias("said"))
    path = readers.scratch(spark)
    rows.write.csv(path, sep="\t", header=True, quote='"', escape='"')
    out = readers.read_mqm_tsv(spark, path)
    return out.select(F.col("k").cast("long").alias("k"), F.col("place").cast("int").alias("pos"), "system", "category", "severity", "said")


@query(
    ctes("runs")
    + """SELECT recipe AS model_id, track, case_id AS id, status = 'execution_failure' AS failed, status = 'completed' AS parsed, coalesce(passed, false) AS hard_pass, 10 AS seconds FROM runs"""
)
def read_benchmark_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "runs")
    score = F.struct((F.col("status") == "completed").alias("parsed"), F.lit(True).alias("item_count_match"), F.coalesce("passed", F.lit(False)).alias("hard_pass"))
    result = F.struct(F.col("case_id").alias("id"), F.when(F.col("status") == "execution_failure", "timeout").alias("execution_failure"), F.lit(0.5).alias("elapsed_seconds"), score.alias("score"), F.sha2("case_id", 256).alias("prompt_sha256"), F.lit("never read").alias("raw_response"))
    documents = _gathered(r, ["recipe", "track", F.expr(f"case_no div {EACH}").alias("part")], F.col("case_no"), result, "results").select(
        F.lit(1).alias("schema_version"), F.lit("p").alias("provider"), F.col("recipe").alias("model_id"), F.col("recipe").alias("model_label"), "track", F.lit("b").alias("benchmark"), F.sha2("track", 256).alias("fixture_sha256"),
        F.lit("2026-01-01T00:00:10Z").alias("created_at_utc"), F.struct(F.lit(10).alias("elapsed_seconds")).alias("summary"), "results",
    )
    out = readers.read_benchmark_artifacts(spark, _lines(spark, documents), lines=True)
    seconds = (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).cast("int")
    return out.select("model_id", "track", "id", F.col("execution_failure").isNotNull().alias("failed"), F.col("score.parsed").alias("parsed"), F.col("score.hard_pass").alias("hard_pass"), seconds.alias("seconds"))


@query(
    ctes("runs")
    + """SELECT recipe AS model_id, case_id AS id, 2 AS sources, '"s ' || case_id || '"' AS first_source, CASE track WHEN 'repair' THEN '["e"]' END AS injected_errors, CASE track WHEN 'repair' THEN '{"t":' || case_no || '}' END AS broken_translation FROM runs"""
)
def artifact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and repair evidence of benchmark results, a file for each recipe and track, read in splits."""
    r = view(spark, sf_dir, "runs")
    items = F.array(F.struct(F.concat(F.lit("s "), "case_id").alias("source")), F.struct(F.lit(None).cast("string").alias("source")))
    result = F.struct(F.col("case_id").alias("id"), "track", F.struct(F.lit(True).alias("parsed"), items.alias("items")).alias("score"), F.array(F.lit("e")).alias("injected_errors"), F.struct(F.col("case_no").alias("t")).alias("broken_translation"))
    documents = _gathered(r, ["recipe", "track"], F.col("case_no"), result, "results").select(
        F.lit(1).alias("schema_version"), F.lit("p").alias("provider"), F.col("recipe").alias("model_id"), F.col("recipe").alias("model_label"), "track", F.lit("b").alias("benchmark"), F.sha2("track", 256).alias("fixture_sha256"),
        F.lit("2026-01-01T00:00:10Z").alias("created_at_utc"), F.struct(F.lit(10).alias("elapsed_seconds")).alias("summary"), "results",
    )
    path = readers.scratch(spark)
    documents.select(F.to_json(F.struct("*")).alias("value"), "model_id", "track").write.partitionBy("model_id", "track").text(path)
    out = readers.read_benchmark_artifacts(spark, path)
    return out.select("model_id", "id", F.size("source_inputs").alias("sources"), F.col("source_inputs")[0].alias("first_source"), "repair_evidence.injected_errors", "repair_evidence.broken_translation")


@query(ctes("cases") + "SELECT case_id, gold_severity, language_pair FROM cases")
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = readers.scratch(spark)
    readers.write_table(view(spark, sf_dir, "cases").select("language_pair", "case_id", "gold_severity"), path, order=["case_id"])
    return spark.read.json(path)


@query(
    ctes("runs")
    + """SELECT recipe || '/' || case_id AS doc_id, concat_ws('; ', CASE WHEN case_no % 5 = 0 THEN '$.id: pattern' END, CASE WHEN case_no % 7 = 0 THEN '$.stages: least' END,
  CASE WHEN case_no % 3 = 0 THEN '$.validator_policy.profile: required' END) AS issues FROM runs"""
)
def recipe_manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.array(F.struct(F.lit("translate").alias("kind"), F.lit("i").alias("implementation")))
    policy = F.struct(F.lit("veto").alias("mode"), F.when(F.expr("case_no % 3 <> 0"), "x").alias("profile"))
    manifest = F.struct(
        F.lit(1).alias("schema_version"), F.when(F.expr("case_no % 5 = 0"), "A!").otherwise(F.concat(F.lit("r-"), "case_no")).alias("id"), F.col("recipe").alias("display_name"), F.lit("en").alias("source_language"), F.lit("de").alias("target_language"),
        F.struct(F.lit("p").alias("name")).alias("provider"), F.struct(F.lit("m").alias("id")).alias("model"), F.when(F.expr("case_no % 7 = 0"), F.slice(stage, 1, 0)).otherwise(stage).alias("stages"), policy.alias("validator_policy"),
    )
    documents = view(spark, sf_dir, "runs").select(F.concat_ws("/", "recipe", "case_id").alias("doc_id"), F.to_json(manifest).alias("document"))
    return contracts.validate_documents(documents, "recipe_manifest").select("doc_id", F.array_join("issues", "; ").alias("issues"))
