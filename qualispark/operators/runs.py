"""Planning of judge runs, resumption, usage and cost."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.columns import swap_verdict
from qualispark.operators.contracts import parsed_judge

CONFIGURATION = ("model", "profile", "prompt_revision", "max_tokens", "reasoning_effort")


def plan_judge_tasks(cases: DataFrame) -> DataFrame:
    """(case_id, run, field): a task for each missing output; swaps only of contrastive cases or where ab_swap is set."""
    wants = (F.col("origin") == "contrastive") | F.coalesce("ab_swap", F.lit(False))
    fields = F.array_compact(F.array(F.when(F.col("judge_output").isNull(), "judge_output"), F.when(wants & F.col("swap_judge_output").isNull(), "swap_judge_output")))
    return cases.select("case_id", "run", F.explode(fields).alias("field"))


def swap_case(cases: DataFrame) -> DataFrame:
    """The case with candidates exchanged, id suffixed and gold verdict inverted."""
    return (
        cases.withColumn("_a", F.col("candidate_a"))
        .withColumn("candidate_a", F.col("candidate_b"))
        .withColumn("candidate_b", F.col("_a"))
        .drop("_a")
        .withColumn("case_id", F.concat("case_id", F.lit("::swap")))
        .withColumn("gold_verdict", swap_verdict("gold_verdict"))
    )


def budget_check(tasks: DataFrame, limits: DataFrame) -> DataFrame:
    """(run, planned, max_calls, within) per run."""
    planned = tasks.groupBy("run").agg(F.count("*").alias("planned"))
    return limits.join(planned, "run", "left").select("run", F.coalesce("planned", F.lit(0)).alias("planned"), "max_calls", (F.coalesce("planned", F.lit(0)) <= F.col("max_calls")).alias("within"))


def resume_merge(cases: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds reused_base and reused_swap: prior outputs that are valid and carry the case's id. `prior` has case_id, base_ok and swap_ok."""
    return cases.join(prior, "case_id", "left").withColumn("reused_base", F.coalesce("base_ok", F.lit(False))).withColumn("reused_swap", F.coalesce("swap_ok", F.lit(False))).drop("base_ok", "swap_ok")


OUTPUTS = ("judge_output", "swap_judge_output")


def resume_outputs(cases: DataFrame, prior: DataFrame) -> DataFrame:
    """The cases with an earlier run's outputs put in, and `reused`, how many of a case's two outputs were.

    `prior` has case_id and both output columns. An output is taken that keeps
    the contract and carries the case's id, also over one that the case
    has; others stay as the case has them. A prior case that comes twice gives the smaller valid output.
    """
    known = parsed_judge(parsed_judge(prior.select("case_id", *OUTPUTS), "case_id", OUTPUTS[0], "base"), "case_id", OUTPUTS[1], "swap")
    sound = {c: F.when(F.col(f"{p}_failure").isNull(), F.col(c)) for c, p in zip(OUTPUTS, ("base", "swap"), strict=True)}
    kept = known.groupBy("case_id").agg(*[F.min(v).alias(f"_{c}") for c, v in sound.items()])
    held = [F.col(c) if c in cases.columns else F.lit(None).cast("string") for c in OUTPUTS]
    joined = cases.join(kept, "case_id", "left")
    reused = sum((F.col(f"_{c}").isNotNull().cast("int") for c in OUTPUTS), F.lit(0))
    return joined.withColumn("reused", reused).withColumns({c: F.coalesce(F.col(f"_{c}"), own) for c, own in zip(OUTPUTS, held, strict=True)}).drop(*[f"_{c}" for c in OUTPUTS])


def resume_compatibility(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(run, mismatches): comma-joined configuration keys that differ from the prior run's; nulls equal nulls."""
    c, p = current.alias("c"), prior.alias("p")
    names = F.array_compact(F.array(*[F.when(~F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")), F.lit(k)) for k in CONFIGURATION]))
    return c.join(p, F.col("c.run") == F.col("p.run")).select(F.col("c.run").alias("run"), F.array_join(names, ",").alias("mismatches"))


def judge_requests(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks with their cases' columns and `request_id`; a swap task gets the case with candidates exchanged, under an id of its own."""
    columns = [c for c in cases.columns if c not in ("run", *OUTPUTS)]
    plain = tasks.join(cases.select(*columns), "case_id")
    base = plain.where(F.col("field") == OUTPUTS[0]).withColumn("request_id", F.col("case_id"))
    swapped = swap_case(plain.where(F.col("field") == OUTPUTS[1]).withColumn("_base", F.col("case_id")))
    return base.unionByName(swapped.withColumn("request_id", F.col("case_id")).withColumn("case_id", F.col("_base")).drop("_base"))


def _under(output: str, row: dict) -> str:
    """An output of a request with an id of its own, under the id of its case."""
    if row.get("request_id", row["case_id"]) == row["case_id"]:
        return output
    try:
        document = json.loads(output)
    except (ValueError, TypeError, RecursionError):
        return output
    if not isinstance(document, dict) or "case_id" not in document:
        return output
    return json.dumps(document | {"case_id": row["case_id"]}, ensure_ascii=False)


class CallLog:
    """Outputs that have been paid for, as JSON lines in a folder that driver and executors share.

    A task writes to files of its own, each complete when it gets its name, so a
    task that is run again finds what the lost one had written.
    """

    def __init__(self, folder: str, run: str) -> None:
        self.folder, self.run = folder, run

    def _at(self, *parts: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        return store, "/".join((root.rstrip("/"), *parts))

    def runs(self) -> bool:
        """Whether a run has written here."""
        from pyarrow import fs

        store, root = self._at()
        return any(f.extension == "jsonl" for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)))

    def written(self, part: int) -> dict[tuple[str, str], str]:
        """What tasks of this run with the same number have logged."""
        from pyarrow import fs

        store, root = self._at(self.run, str(part))
        found = {}
        for file in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if file.extension == "jsonl":
                with store.open_input_stream(file.path) as stream:
                    for line in stream.read().decode().splitlines():
                        x = json.loads(line)
                        found[x["case_id"], x["field"]] = x["output"]
        return found

    def append(self, part: int, rows: list[dict]) -> None:
        store, root = self._at(self.run, str(part))
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(name + ".part") as stream:
            stream.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        store.move(name + ".part", name + ".jsonl")


def apply_judge(tasks: DataFrame, make_judge: Callable[[], Callable[[dict], str]], *, log: str | None = None, every: int = 1) -> DataFrame:
    """(case_id, field, output, failure): a user's judge over task rows; an exception becomes the row's failure.

    Outputs of `judge_requests` come back under their case's id. With `log`, a
    folder (or URI) that all executors share, outputs of earlier runs are taken
    from it, and each `every` calls a task writes its outputs there: a task that
    is lost and run again, and a result that is read twice, repeat no call that was
    logged. Failures are not logged, so a later run tries them again.
    """
    calls = None if log is None else CallLog(log, uuid.uuid4().hex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        part = TaskContext.get().partitionId()
        known = calls.written(part) if calls else {}
        fresh: list[dict] = []
        for pdf in batches:
            outputs, failures = [], []
            for row in pdf.to_dict("records"):
                failure, output = None, known.get((row["case_id"], row["field"]))
                if output is None:
                    try:
                        output = _under(judge(row), row)
                    except Exception as error:  # noqa: BLE001
                        failure = f"benchmark_failure: {type(error).__name__}"
                    if calls and failure is None:
                        fresh.append({"case_id": row["case_id"], "field": row["field"], "output": output})
                        if len(fresh) >= every:
                            calls.append(part, fresh)
                            fresh = []
                outputs.append(output)
                failures.append(failure)
            yield pd.DataFrame({"case_id": pdf["case_id"], "field": pdf["field"], "output": outputs, "failure": failures})
        if calls and fresh:
            calls.append(part, fresh)

    schema = "case_id string, field string, output string, failure string"
    if calls is None or not calls.runs():
        return tasks.mapInPandas(run, schema)
    logged = tasks.sparkSession.read.schema("case_id string, field string, output string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(log)
    held = logged.groupBy("case_id", "field").agg(F.min("output").alias("output"))
    asked = tasks.select("case_id", "field").distinct()
    old = asked.join(held, ["case_id", "field"]).withColumn("failure", F.lit(None).cast("string"))
    return tasks.join(held, ["case_id", "field"], "left_anti").mapInPandas(run, schema).unionByName(old)


def run_rollup(calls: DataFrame) -> DataFrame:
    """Per run: calls, failures and token totals. Reads run, outcome and the usage columns."""
    failed = F.col("outcome").isin("error", "timeout", "failure", "refund")
    return calls.groupBy("run").agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"), *[F.sum(c).alias(c) for c in ("hit", "miss", "output", "reasoning", "ticks")])


def normalize_usage(calls: DataFrame, usage: str = "usage") -> DataFrame:
    """Adds hit, miss, output, reasoning and ticks from a provider's usage JSON; a zero counts as absent, a miss is never negative."""

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(usage, p).cast("long"), F.lit(0).cast("long")) for p in paths], F.lit(0).cast("long"))

    prompt = first("$.prompt_tokens", "$.input_tokens", "$.promptTokenCount")
    hit = first("$.prompt_cache_hit_tokens", "$.prompt_tokens_details.cached_tokens", "$.input_tokens_details.cached_tokens", "$.cachedContentTokenCount")
    explicit = F.nullif(F.get_json_object(usage, "$.prompt_cache_miss_tokens").cast("long"), F.lit(0).cast("long"))
    return (
        calls.withColumn("hit", hit)
        .withColumn("miss", F.coalesce(explicit, F.greatest(prompt - hit, F.lit(0).cast("long"))))
        .withColumn("output", first("$.completion_tokens", "$.output_tokens", "$.candidatesTokenCount"))
        .withColumn("reasoning", first("$.completion_tokens_details.reasoning_tokens", "$.output_tokens_details.reasoning_tokens", "$.thoughtsTokenCount"))
        .withColumn("ticks", first("$.cost_in_usd_ticks"))
    )


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost and cost_source. `prices` has a row per provider: hit, miss and output price per million tokens, ticks per unit, free.

    Exact ticks win unless they are zero; a free tier costs nothing; else tokens
    at their prices, to six places, halves to even.
    """
    p = prices.select("provider", F.col("hit").alias("p_hit"), F.col("miss").alias("p_miss"), F.col("output").alias("p_output"), "ticks_per_unit", "free")
    j = usage.join(F.broadcast(p), "provider")
    estimate = F.bround(F.col("hit") * F.col("p_hit") + F.col("miss") * F.col("p_miss") + (F.col("output") + F.col("reasoning")) * F.col("p_output"), 0) / 1000000
    exact = F.when(F.col("ticks_per_unit") > 0, F.nullif(F.bround(F.col("ticks") / F.col("ticks_per_unit"), 10), F.lit(0.0)))
    return (
        j.withColumn("cost", F.when(F.col("free"), F.lit(0.0)).otherwise(F.coalesce(exact, estimate)))
        .withColumn("cost_source", F.when(F.col("free"), "free_tier").when(exact.isNotNull(), "ticks").otherwise("token_estimate"))
        .drop("p_hit", "p_miss", "p_output", "ticks_per_unit", "free")
    )


def cumulative_cost(segments: DataFrame, *, cost: str = "cost_micros", width: int = 100_000) -> DataFrame:
    """Adds `cumulative`: what a chain of resumed segments has cost so far, in whole millionths.

    Segments are whole numbers. A run is cut into ranges of `width` of them, each
    added up by itself after the totals of earlier ranges, so no long run meets in
    one task. Segments without a run are a run, one without a number comes first,
    and a cost that is null adds nothing.
    """
    ranged = segments.withColumn("_range", F.floor(F.col("segment") / width).cast("long"))
    earlier = Window.partitionBy("run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("run", "_range").agg(F.sum(cost).alias("_own"))
    before = totals.select(F.col("run").alias("_run"), F.col("_range").alias("_at"), F.sum("_own").over(earlier).alias("_before"))
    own = F.sum(cost).over(Window.partitionBy("run", "_range").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.join(before, F.col("run").eqNullSafe(F.col("_run")) & F.col("_range").eqNullSafe(F.col("_at")))
    return joined.withColumn("cumulative", F.coalesce(F.col("_before") + own, F.col("_before"), own)).drop("_run", "_at", "_range", "_before")
