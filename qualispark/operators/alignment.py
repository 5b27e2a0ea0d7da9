"""Gold, judge and metric evidence joined on the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.columns import swap_verdict
from qualispark.operators.checks import refuse, required
from qualispark.operators.contracts import parsed_judge


def effective_verdict(cases: DataFrame) -> DataFrame:
    """One row per case: effective verdict, whether it is correct, whether base and swap agree, and why there is none.

    The base verdict stands unless a valid swap disagrees. An invalid swap leaves
    it; a valid swap with an invalid base is not consistent.
    """
    p = parsed_judge(parsed_judge(cases, "case_id", "judge_output", "base"), "case_id", "swap_judge_output", "swap")
    base = F.when(F.col("base_case_id") == F.col("case_id"), F.col("base_any_verdict"))
    swap = F.when(F.col("has_swap") & (F.col("swap_case_id") == F.col("case_id")), swap_verdict(F.col("swap_any_verdict")))
    out = p.select("case_id", "mode", "gold_verdict", "gold_rank", "has_swap", base.alias("base"), swap.alias("swap"))
    consistent = F.when(F.col("swap").isNotNull(), F.col("base").eqNullSafe(F.col("swap")))
    return (
        out.withColumn("consistent", consistent)
        .withColumn("effective", F.when(F.coalesce("consistent", F.lit(True)), F.col("base")))
        .withColumn("base_correct", F.coalesce(F.col("base") == F.col("gold_verdict"), F.lit(False)))
        .withColumn("correct", F.coalesce(F.col("effective") == F.col("gold_verdict"), F.lit(False)))
        .withColumn("failure", F.when(F.col("base").isNull(), "judge_invalid").when(~F.coalesce("consistent", F.lit(True)), "judge_position_inconsistent"))
    )


def judge_alignment_summary(effective: DataFrame) -> DataFrame:
    swaps = F.count_if("has_swap")
    return effective.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("base").isNotNull()).alias("valid_base"),
        (F.count_if("base_correct") / F.count("*")).alias("base_accuracy"),
        F.count_if("has_swap").alias("swap_count"),
        (F.count_if("consistent") / F.nullif(swaps, F.lit(0))).alias("position_consistency"),
        (F.count_if("correct") / F.count("*")).alias("effective_accuracy"),
    )


def align_evidence(effective: DataFrame, verdicts: DataFrame, *, strict: bool = True) -> DataFrame:
    """A row per pairwise case and metric with both signals. Reads metric verdicts (metric, case_id, verdict).

    `strict`: every metric needs a verdict for every pairwise case, once, and
    for no other. A case that only one side has fails the job and is named; so does a metric whose
    cases, told by their number and the sums of their hashes, are not those of the judge.
    """
    v = verdicts.select("case_id", "metric", F.col("verdict").alias("metric_verdict"))
    pairs = effective.where("mode = 'pairwise'")
    agrees = F.col("metric_verdict") == F.col("gold_verdict")
    if not strict:
        return pairs.join(v, "case_id").withColumn("metric_correct", agrees)
    both = pairs.withColumn("_judged", F.lit(True)).join(v, "case_id", "full").withColumn("metric_correct", agrees)
    known = F.coalesce("_judged", F.lit(False)) & F.col("metric").isNotNull()
    both = both.withColumn("case_id", required(known, F.col("case_id"), "judge and metric cases do not match: ", F.col("case_id"))).drop("_judged")
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("case_id").cast("decimal(38)")).alias("h"), F.expr("bit_xor(xxhash64('_', case_id))").alias("x"))
    wanted = pairs.agg(*[m.alias(f"all_{i}") for i, m in enumerate(mark)])
    odd = verdicts.groupBy("metric").agg(*mark).crossJoin(F.broadcast(wanted)).where("not (n <=> all_0 and h <=> all_1 and x <=> all_2)")
    return refuse(both, odd, "metric", "a metric's cases are not the judge's, each once")


def _category():
    j, m = F.col("correct"), F.col("metric_correct")
    return F.when(j & m, "both_correct").when(j, "judge_only").when(m, "metric_only").otherwise("both_wrong")


def agreement_contingency(aligned: DataFrame) -> DataFrame:
    """(metric, category, n, disagreements) over cases with an effective verdict."""
    held = aligned.where("effective is not null")
    return held.groupBy("metric", _category().alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("effective") != F.col("metric_verdict")).alias("disagreements"))


def oracle_union_accuracy(aligned: DataFrame) -> DataFrame:
    """Per metric: the share of pairs that it gets right, and of aligned pairs that either signal gets right."""
    held = F.col("effective").isNotNull()
    return aligned.groupBy("metric").agg(
        F.count("*").alias("pairs"),
        (F.count_if("metric_correct") / F.count("*")).alias("metric_accuracy"),
        F.count_if(held).alias("aligned"),
        (F.count_if(held & (F.col("correct") | F.col("metric_correct"))) / F.nullif(F.count_if(held), F.lit(0))).alias("union_accuracy"),
    )


def single_scores_by_judge_outcome(effective: DataFrame, scores: DataFrame) -> DataFrame:
    """Per metric, number and mean score of single cases that the judge got right or wrong."""
    s = scores.where("role = 'candidate'").select("case_id", "metric", "ms")
    held = effective.where("mode = 'single'").join(s, "case_id")
    return held.groupBy("metric", F.when(F.col("correct"), "judge_correct").otherwise("judge_wrong").alias("outcome")).agg(F.count("*").alias("n"), (F.sum("ms") / F.count("*") / 1000).alias("mean"))


def review_queue(effective: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case_id, reasons): the sorted, comma-joined reasons to look at a case; cases without one give no row.

    Reads metric verdicts (metric, case_id, verdict). They are gathered per case,
    a verdict a metric, so that each case is read and judged once.
    """
    told = verdicts.groupBy("case_id").agg(F.collect_set(F.struct("metric", "verdict")).alias("_told"))
    held = (F.col("mode") == "pairwise") & F.col("effective").isNotNull()

    def reasons(t: Column) -> Column:
        name = lambda end: F.concat(F.lit("judge_"), t["metric"], F.lit(end))
        differs = F.when(F.col("effective") != t["verdict"], name("_disagreement"))
        return F.array(differs, F.when(~F.col("correct") & (t["verdict"] != F.col("gold_verdict")), name("_both_wrong")))

    more = F.when(held, F.flatten(F.transform("_told", reasons)))
    own = F.array(F.col("failure"), F.when(~F.col("correct"), "judge_gold_mismatch"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(own, F.coalesce(more, F.array().cast("array<string>"))))))
    return effective.join(told, "case_id", "left").select("case_id", F.array_join(found, ",").alias("reasons")).where("reasons <> ''")
