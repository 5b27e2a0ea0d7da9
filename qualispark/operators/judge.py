"""Judge against gold: accuracy, recall, consistency and confusion of structured verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.columns import max_severity_of_errors, primary_category_of_errors, safe_rate, severity_rank, swap_verdict
from qualispark.operators.contracts import parsed_judge

DECIDED = ("candidate_a", "candidate_b")


def judge_case_scores(cases: DataFrame) -> DataFrame:
    """One row per case with what its judge outputs are worth against gold.

    Reads case_id, mode, gold_verdict, gold_severity (null: none), gold_category
    (null: none), phenomenon (null: unspecified), part, judge_output, has_swap and
    swap_judge_output. Swap flags count only where the base output is valid.
    """
    p = parsed_judge(parsed_judge(cases, "case_id", "judge_output", "base"), "case_id", "swap_judge_output", "swap")
    gold_severity = F.coalesce("gold_severity", F.lit("none"))
    rank = F.coalesce(severity_rank(gold_severity), F.lit(0))
    valid = F.col("base_failure").isNull()
    severity = F.when(valid, max_severity_of_errors("base_errors"))
    swap_valid = valid & F.col("has_swap") & F.col("swap_failure").isNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return p.select(
        "case_id",
        "mode",
        F.coalesce("phenomenon", F.lit("unspecified")).alias("phenomenon"),
        "part",
        "gold_verdict",
        gold_severity.alias("gold_severity"),
        F.coalesce("gold_category", F.lit("none")).alias("gold_category"),
        F.col("base_failure").alias("failure"),
        F.col("base_verdict").alias("verdict"),
        F.col("base_confidence").alias("confidence"),
        severity.alias("severity"),
        F.when(valid, primary_category_of_errors("base_errors")).alias("category"),
        F.when(valid, F.size("base_errors")).otherwise(0).alias("errors"),
        F.when(valid, F.size(F.filter("base_errors", lambda e: F.coalesce(e["source_excerpt"], F.lit("")) != ""))).otherwise(0).alias("backed_errors"),
        valid.alias("valid"),
        yes(valid & (F.col("base_mode") == F.col("mode")) & (F.col("base_verdict") == F.col("gold_verdict"))).alias("correct"),
        (rank >= 2).alias("major"),
        yes(valid & (rank >= 2) & (severity_rank(severity) >= 2)).alias("major_found"),
        (rank == 3).alias("critical"),
        yes(valid & (rank == 3) & (severity == "critical")).alias("critical_found"),
        yes((F.col("mode") == "single") & (F.col("gold_verdict") == "fail")).alias("bad_single"),
        yes(valid & (F.col("mode") == "single") & (F.col("gold_verdict") == "fail") & (F.col("base_verdict") == "pass")).alias("false_good"),
        yes((F.col("mode") == "pairwise") & F.col("gold_verdict").isin(*DECIDED)).alias("decided"),
        (valid & F.col("has_swap")).alias("swap"),
        swap_valid.alias("swap_valid"),
        yes(swap_valid & (F.col("swap_verdict") == swap_verdict("gold_verdict"))).alias("swap_correct"),
        yes(swap_valid & (F.col("swap_verdict") == swap_verdict("base_verdict"))).alias("consistent"),
    )


def _n(c: Column | str) -> Column:
    return F.coalesce(F.count_if(F.col(c) if isinstance(c, str) else c), F.lit(0))


def validity() -> dict[str, Column]:
    return {
        "case_count": F.count("*"),
        "valid_count": _n("valid"),
        "valid_rate": safe_rate(_n("valid"), F.count("*")),
        "parse_failures": _n(F.col("failure") == "json_parse_failure"),
        "contract_failures": _n(F.col("failure") == "schema_failure"),
    }


def accuracy() -> dict[str, Column]:
    single, pairwise = F.col("mode") == "single", F.col("mode") == "pairwise"
    return {
        "accuracy": safe_rate(_n("correct"), F.count("*")),
        "single_accuracy": safe_rate(_n(single & F.col("correct")), _n(single)),
        "pairwise_accuracy": safe_rate(_n(pairwise & F.col("correct")), _n(pairwise)),
    }


def severe_recall() -> dict[str, Column]:
    return {
        "major_recall": safe_rate(_n("major_found"), _n("major")),
        "major_false_negative_rate": safe_rate(_n("major") - _n("major_found"), _n("major")),
        "critical_recall": safe_rate(_n("critical_found"), _n("critical")),
    }


def false_good() -> dict[str, Column]:
    return {
        "false_good_rate": safe_rate(_n("false_good"), _n("bad_single")),
        "bad_candidate_accuracy": safe_rate(_n(F.col("decided") & F.col("correct")), _n("decided")),
    }


def evidence() -> dict[str, Column]:
    return {
        "low_confidence_rate": safe_rate(_n(F.col("confidence") == "low"), _n("valid")),
        "evidence_rate": safe_rate(F.sum("backed_errors"), F.sum("errors")),
    }


def swaps() -> dict[str, Column]:
    return {
        "swap_count": _n("swap"),
        "swap_valid_rate": safe_rate(_n("swap_valid"), _n("swap")),
        "swap_accuracy": safe_rate(_n("swap_correct"), _n("swap")),
        "position_consistency": safe_rate(_n("consistent"), _n("swap_valid")),
    }


def _agg(scores: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return scores.agg(*[c.alias(k) for k, c in columns.items()])


def judge_validity(scores: DataFrame) -> DataFrame:
    return _agg(scores, validity())


def judge_accuracy(scores: DataFrame) -> DataFrame:
    """Invalid outputs stay in the denominators."""
    return _agg(scores, accuracy())


def severe_error_recall(scores: DataFrame) -> DataFrame:
    return _agg(scores, severe_recall())


def false_good_and_bad_candidate(scores: DataFrame) -> DataFrame:
    return _agg(scores, false_good())


def confidence_and_evidence(scores: DataFrame) -> DataFrame:
    """The low-confidence rate is over valid outputs."""
    return _agg(scores, {**{f"confidence_{c}": _n(F.col("confidence") == c) for c in ("high", "medium", "low")}, **evidence()})


def swap_consistency(scores: DataFrame) -> DataFrame:
    """Swap accuracy is over all swaps, position consistency over valid ones."""
    return _agg(scores, swaps())


def phenomenon_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("phenomenon").agg(F.count("*").alias("case_count"), _n("correct").alias("correct_count"), safe_rate(_n("correct"), F.count("*")).alias("accuracy"))


def confusion_matrix(scores: DataFrame, what: str = "severity") -> DataFrame:
    """(gold, predicted, n) of severities or categories; invalid outputs count as invalid_output."""
    return scores.groupBy(F.col(f"gold_{what}").alias("gold"), F.coalesce(what, F.lit("invalid_output")).alias("predicted")).agg(F.count("*").alias("n"))


def judge_failures(scores: DataFrame) -> DataFrame:
    return scores.where("failure is not null").select("case_id", "failure")


def calibration_by_partition(scores: DataFrame) -> DataFrame:
    """All rates overall (part: null) and for each partition, in one pass; cases without a partition count overall only."""
    columns = {**validity(), **accuracy(), **severe_recall(), **false_good(), **evidence(), **swaps()}
    grouped = scores.groupingSets([[F.col("part")], []], F.col("part")).agg(F.grouping_id().alias("_overall"), *[c.alias(k) for k, c in columns.items()])
    return grouped.where("_overall = 1 or part is not null").drop("_overall")
