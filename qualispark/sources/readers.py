"""Readers of evaluation artifacts and a deterministic writer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualispark.functions.columns import canonical_text
from qualispark.sources.splits import document_lists, tsv_records

STATUSES = ("completed", "execution_failure", "structured_output_failure")
GOLD = "struct<mode:string,verdict:string,max_severity:string,primary_category:string,phenomenon:string>"
CASE = f"struct<id:string,origin_suite:string,partition:string,input:map<string,string>,gold:{GOLD},judge_output:string,swap_judge_output:string>"


def _entries(spark: SparkSession, path: str, envelope: str, name: str, entry: str, lines: bool, sound: Column, message: str) -> DataFrame:
    """(envelope fields..., pos, entry) of JSON documents: a file each, read in splits, or (`lines`) a line each. What is not `sound` fails the job."""
    if not lines:
        return document_lists(spark, path, envelope, name, entry, sound, message)
    documents = spark.read.schema(f"{envelope}, {name} array<{entry}>").json(path)
    kept = [c for c in documents.columns if c != name]
    return documents.withColumn(name, _required(sound & F.col(name).isNotNull(), F.col(name), message)).select(*kept, F.posexplode(name).alias("pos", "entry"))


def _required(sound: Column, value: Column, message: str) -> Column:
    """`value`, or an error that fails the job."""
    return F.when(F.coalesce(sound, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def read_cases(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(pack_id, suite, pos, case fields) of packs; an envelope of another version, or without id, suite or cases, fails the job.

    A file is a pack, read in splits however large it is; with `lines`, each line is one.
    """
    sound = (F.col("schema_version") == 1) & (F.length("id") > 0) & (F.length("suite") > 0)
    cases = _entries(spark, path, "schema_version int, id string, suite string", "cases", CASE, lines, sound, "a pack needs version 1, id, suite and cases")
    return cases.select(F.col("id").alias("pack_id"), "suite", "pos", F.col("entry").alias("c")).select(
        "pack_id", "suite", "pos", F.col("c.id").alias("case_id"), F.col("c.origin_suite").alias("origin"), F.col("c.partition").alias("part"), F.col("c.input").alias("input"),
        F.col("c.gold.mode").alias("mode"), F.col("c.gold.verdict").alias("gold_verdict"), F.col("c.gold.max_severity").alias("gold_severity"),
        F.col("c.gold.primary_category").alias("gold_category"), F.col("c.gold.phenomenon").alias("phenomenon"), F.col("c.judge_output").alias("judge_output"), F.col("c.swap_judge_output").alias("swap_judge_output"),
    )


def read_metric_tables(spark: SparkSession, pack: str, result: str, *, lines: bool = False) -> DataFrame:
    """(pack_id, id, metric, direction, score) with the pack's texts.

    A result of another pack, a case that a result scores twice, and cases that
    only the pack or only a result has fail the job. Files as for `read_cases`.
    """
    text = "struct<id:string,source:string,hypothesis:string,reference:string>"
    texts = _entries(spark, pack, "id string", "cases", text, lines, F.lit(True), "a metric pack needs cases").select(F.col("id").alias("pack_id"), "entry.*")
    scores = _entries(spark, result, "pack_id string, metric struct<name:string,direction:string>", "cases", "struct<id:string,score:double>", lines, F.lit(True), "a metric result needs cases")
    flat = scores.select("pack_id", F.col("metric.name").alias("metric"), F.col("metric.direction").alias("direction"), "entry.*")
    flat = flat.groupBy("pack_id", "id", "metric").agg(F.any_value("direction").alias("direction"), F.any_value("score").alias("score"), F.count("*").alias("_n"))
    asked = texts.join(flat.select("pack_id", "metric").distinct(), "pack_id", "left").withColumn("_asked", F.lit(True))
    joined = flat.join(asked, ["pack_id", "id", "metric"], "full")
    sound = F.col("_asked") & (F.col("_n") == 1)
    return joined.withColumn("id", _required(sound, F.col("id"), "a metric result's cases do not match its pack exactly")).drop("_n", "_asked")


def read_runs(spark: SparkSession, path: str, *, suite: str | None = None, lines: bool = False) -> DataFrame:
    """(run_id, suite, recipe, recipe_sha256, case fields) of all run results under a path, files as for `read_cases`.

    A document without a run id, suite, recipe or cases, or (if asked for) of
    another suite, fails the job, and so does a case without an id or with a status that is not known.
    """
    case = "struct<id:string,track:string,execution_status:string,hard_validation:struct<enabled:boolean,passed:boolean>>"
    message = f"a run result needs run_id, suite{'' if suite is None else ' ' + suite}, recipe and sound cases"
    sound = (F.length("run_id") > 0) & (F.length("suite") > 0) & (F.length("recipe.id") > 0)
    if suite is not None:
        sound &= F.col("suite") == suite
    runs = _entries(spark, path, "run_id string, suite string, recipe struct<id:string,sha256:string>", "cases", case, lines, sound, message)
    known = (F.length("entry.id") > 0) & F.col("entry.execution_status").isin(*STATUSES)
    return runs.select("run_id", "suite", F.col("recipe.id").alias("recipe"), F.col("recipe.sha256").alias("recipe_sha256"), _required(known, F.col("entry"), message).alias("c")).select(
        "run_id", "suite", "recipe", "recipe_sha256", F.col("c.id").alias("case_id"), F.col("c.track").alias("track"), F.col("c.execution_status").alias("status"), F.col("c.hard_validation.passed").alias("passed")
    )


CONTRASTIVE = T.StructType([T.StructField(n, T.StringType()) for n in ("ID", "source", "good-translation", "incorrect-translation", "reference", "phenomena", "langpair", "incorrect-translation-annotated", "annotation-method")])
NEEDED = ("ID", "source", "good-translation", "incorrect-translation", "reference", "phenomena", "langpair")
ANNOTATED = ("incorrect-translation-annotated", "annotation-method")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) of text files, lines numbered from 1 in each file. One row per split of a file is added up and broadcast (some 150 bytes for 128 MB of text), no line is shuffled."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(F.broadcast(blocks), ["file", "_block"]).select("file", (F.col("_row") + F.col("_shift")).alias("line_number"), "value")


def read_contrastive_jsonl(spark: SparkSession, path: str, *, fail_fast: bool = True, annotated: bool = False) -> DataFrame:
    """JSON lines of contrastive pairs with `file`, `line_number` and `issue`: malformed or the first missing or empty field.

    With `annotated` the fields of marked spans are needed too. With `fail_fast`
    an issue fails the job and names its line, also of rows filtered out later.
    """
    parsed = numbered_lines(spark, path).select("file", "line_number", "value", F.from_json("value", CONTRASTIVE, {"mode": "PERMISSIVE"}).alias("r"))
    issue = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("")).startswith("OBJECT") == F.lit(False), F.lit("malformed"))
    for name in NEEDED + (ANNOTATED if annotated else ()):
        issue = issue.when(F.coalesce(F.col(f"r.`{name}`"), F.lit("")) == "", F.lit(name))
    out = parsed.select("file", "line_number", "r.*", issue.alias("issue"))
    wrong = F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": row without "), F.col("issue"))
    return out.withColumn("issue", F.when(F.col("issue").isNotNull(), F.raise_error(wrong)).cast("string")) if fail_fast else out


def contrastive_counts(rows: DataFrame, language_pairs: list[str] | None = None, phenomena: list[str] | None = None) -> DataFrame:
    """One row: total_rows, and matching_rows of the given language pairs and phenomena (null: all)."""
    match = F.lit(True) if language_pairs is None else F.col("langpair").isin(language_pairs)
    match &= F.lit(True) if phenomena is None else F.col("phenomena").isin(phenomena)
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(F.coalesce(match, F.lit(False))).alias("matching_rows"))


def read_mqm_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated annotations, all columns as strings, a byte order mark dropped; `pos` is the row's place in its file, from 0.

    Files are read in splits; quoted cells may hold tabs, doubled quotation marks and line breaks,
    also over a split's border. All files have the columns of one of them. Empty lines are no rows.
    """
    records = tsv_records(spark, path)
    options = {"sep": "\t", "quote": '"', "escape": '"'}
    header = records.where("pos = 0").select("text").first()
    if header is None:
        raise ValueError("a TSV file needs a header")
    first = header[0].removeprefix("\ufeff")
    width = first.count("\t") + 1
    cells = spark.range(1).select(F.from_csv(F.lit(first), ", ".join(f"c{i} string" for i in range(width)), options).alias("r")).first().r
    names = [c for c in cells if c is not None]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = records.where("pos > 0 and text <> ''")
    return rows.select((F.col("pos") - 1).alias("pos"), F.from_csv("text", schema.toDDL(), options).alias("r")).select("r.*", "pos")


def read_benchmark_artifacts(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Raw benchmark results, a row per result, with when their run started; texts of raw responses are never parsed. Files as for `read_cases`.

    A document of another version, without results or summary, with a negative
    time or with an empty one of its required strings fails the job.
    """
    needed = ("provider", "model_id", "model_label", "track", "benchmark", "fixture_sha256", "created_at_utc")
    envelope = f"schema_version int, {', '.join(f'{n} string' for n in needed)}, policy variant, summary struct<elapsed_seconds:double>"
    result = "struct<id:string,track:string,execution_failure:string,elapsed_seconds:double,score:struct<parsed:boolean,item_count_match:boolean,hard_pass:boolean,items:array<struct<source:variant>>>,prompt_sha256:string,injected_errors:variant,broken_translation:variant,reference_translation:variant,broken_validation:variant>"
    elapsed = F.coalesce(F.col("summary.elapsed_seconds"), F.lit(0.0))
    sound = (F.col("schema_version") == 1) & F.col("summary").isNotNull() & (elapsed >= 0)
    for name in needed:
        sound &= F.length(name) > 0
    results = _entries(spark, path, envelope, "results", result, lines, sound, "a benchmark artifact needs version 1, results, a summary and " + ", ".join(needed))
    finished = F.try_to_timestamp("created_at_utc")
    started = finished - F.make_dt_interval(secs=elapsed.cast("decimal(18,6)"))
    fields = ("id", "execution_failure", "elapsed_seconds", "score", "prompt_sha256")
    return results.select(*needed, "policy", started.alias("started_at"), finished.alias("finished_at"), *[F.col(f"entry.{f}").alias(f) for f in fields], source_inputs(F.col("entry.score.items")).alias("source_inputs"), repair_evidence(F.col("entry")).alias("repair_evidence"))


def source_inputs(items: Column) -> Column:
    """The sources of a score's items, in their order (null where an item has none); no items: an empty array."""
    return F.coalesce(F.transform(items, lambda i: F.to_json(i["source"])), F.array().cast("array<string>"))


def repair_evidence(result: Column) -> Column:
    """What a repair was given and should give, as JSON texts; null for other tracks. Missing errors are an empty array."""
    parts = ("broken_translation", "reference_translation", "broken_validation")
    evidence = F.struct(F.coalesce(F.to_json(result["injected_errors"]), F.lit("[]")).alias("injected_errors"), *[F.to_json(result[n]).alias(n) for n in parts])
    return F.when(result["track"] == "repair", evidence)


def write_table(df: DataFrame, path: str, *, order: list[str] | None = None, kind: str = "json") -> None:
    """JSON lines with sorted keys at every depth and nulls written out, or columns in the order of their names in another format.

    With `order`, files that are sorted and follow one another by name. A small table is one file.
    """
    out = df.orderBy(*order) if order else df
    if kind == "json":
        out.select(canonical_text(F.struct("*"), df.schema).alias("value")).write.mode("overwrite").text(path)
    else:
        out.select(*sorted(df.columns)).write.mode("overwrite").format(kind).save(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; without one, a local folder on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
