"""Automatic metric scores against gold: flattening, summaries, pairwise verdicts and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.operators.checks import required

#: Ranges of scores of a metric that are ranked side by side, and the sketch's accuracy.
RANGES, ACCURACY = 200, 10_000
STRATA = (0, 1, 2, 3)
ROLES = {"single": ("candidate",), "pairwise": ("candidate_a", "candidate_b")}


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def skip_reason() -> Column:
    """Why a case cannot be scored, the first reason in order; null if it can. Reads id, mode, source, reference and the candidates."""
    single = _filled(F.col("candidate_a"))
    return (
        F.when(~_filled(F.col("id")), "malformed_case")
        .when(~_filled(F.col("source")), "missing_source")
        .when(~_filled(F.col("reference")), "missing_reference")
        .when(~F.coalesce(F.col("mode").isin(*ROLES), F.lit(False)), "unsupported_mode")
        .when(~(single & ((F.col("mode") == "single") | _filled(F.col("candidate_b")))), "missing_hypothesis")
    )


def skip_reasons(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce(skip_reason(), F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


def flatten_hypotheses(cases: DataFrame) -> DataFrame:
    """(id, case_id, role, source, hypothesis, reference): one row for a single case, two for a pair; all or nothing of a case."""
    one = F.array(F.struct(F.lit("candidate").alias("role"), F.col("candidate_a").alias("text")))
    two = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("text")) for r in ROLES["pairwise"]])
    return (
        cases.where(skip_reason().isNull())
        .select("id", "mode", "source", "reference", F.explode(F.when(F.col("mode") == "single", one).otherwise(two)).alias("h"))
        .select(
            F.when(F.col("mode") == "single", F.col("id")).otherwise(F.concat("id", F.lit("::"), F.col("h.role"))).alias("id"),
            F.col("id").alias("case_id"),
            F.col("h.role").alias("role"),
            "source",
            F.col("h.text").alias("hypothesis"),
            "reference",
        )
    )


def score_hypotheses(hypotheses: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]], *, mode: str = "reference", batch_size: int = 64, metric: str | None = None, lower_is_better: bool | None = None) -> DataFrame:
    """(id, score): a user's batch scorer, built once per task, over all hypotheses. A non-finite score fails the job.

    With `metric` and `lower_is_better` the scores carry their metric's name and direction.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                scores = pd.Series(scorer(part)).astype("float64")
                if len(scores) != len(part) or not scores.map(lambda x: x == x and abs(x) != float("inf")).all():
                    raise ValueError("a scorer must give one finite score per hypothesis")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "score": scores.to_numpy()})

    columns = ["id", "source", "hypothesis", *(["reference"] if mode == "reference" else [])]
    scored = hypotheses.select(*columns).mapInPandas(run, "id string, score double")
    if metric is None and lower_is_better is None:
        return scored
    direction = None if lower_is_better is None else "lower_is_better" if lower_is_better else "higher_is_better"
    return scored.withColumns({"metric": F.lit(metric).cast("string"), "mode": F.lit(mode), "direction": F.lit(direction).cast("string")})


def _summary() -> list[Column]:
    return [F.count("*").alias("n"), (F.sum("ms") / F.count("*") / 1000).alias("mean"), (F.min("ms") / 1000).alias("minimum"), (F.max("ms") / 1000).alias("maximum")]


def score_summary(scores: DataFrame) -> DataFrame:
    """n, mean, minimum and maximum of scores given in thousandths (ms), per metric."""
    return scores.groupBy("metric").agg(*_summary())


def score_summary_by(scores: DataFrame, *keys: str) -> DataFrame:
    """The same by each of several keys in one pass: (metric, key, value, ...)."""
    sets = [[F.col("metric"), F.col(k)] for k in keys]
    grouped = scores.groupingSets(sets, F.col("metric"), *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *_summary())
    width = len(keys)
    # grouping_id has a bit per key, from the left, that is set for keys left out
    which = {((1 << width) - 1) ^ (1 << (width - 1 - i)): k for i, k in enumerate(keys)}
    pick = lambda value: F.coalesce(*[F.when(F.col("_g") == g, value(k)) for g, k in which.items()])
    return grouped.select("metric", pick(F.lit).alias("key"), pick(lambda k: F.col(k).cast("string")).alias("value"), "n", "mean", "minimum", "maximum")


def metric_pairwise_verdict(scores: DataFrame, *, lower_is_better: dict[str, bool], strict: bool = True) -> DataFrame:
    """(metric, case_id, verdict, margin_ms) of cases with a score for either candidate; equal scores tie.

    `strict`: a pair with one score only fails the job and is named; else it is left out.
    """
    a, b = (F.max(F.when(F.col("role") == r, F.col("ms"))) for r in ROLES["pairwise"])
    sign = F.when(F.col("metric").isin(*[m for m, low in lower_is_better.items() if low]), -1).otherwise(1)
    both = scores.where(F.col("role").isin(*ROLES["pairwise"])).groupBy("metric", "case_id").agg(a.alias("a"), b.alias("b"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = both.withColumn("a", required(whole, F.col("a"), "incomplete pairwise scores of ", F.col("metric"), " for ", F.col("case_id"))) if strict else both.where(whole)
    gap = sign * (F.col("a") - F.col("b"))
    return both.select("metric", "case_id", F.when(gap > 0, "candidate_a").when(gap < 0, "candidate_b").otherwise("tie").alias("verdict"), F.abs(F.col("a") - F.col("b")).alias("margin_ms"))


def judged_pairs(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    return verdicts.join(cases.select("case_id", "gold_verdict", "language_pair", "phenomenon"), "case_id").withColumn("correct", F.col("verdict") == F.col("gold_verdict"))


def _pairwise() -> list[Column]:
    right = F.count_if("correct")
    return [F.count("*").alias("n"), right.alias("correct"), (right / F.count("*")).alias("accuracy"), F.count_if(F.col("verdict") == "tie").alias("ties")]


def metric_pairwise_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("metric").agg(*_pairwise())


def metric_pairwise_by(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy("metric", F.col(key).alias("value")).agg(*_pairwise(), (F.sum("margin_ms") / F.count("*") / 1000).alias("mean_margin"))


def _cells(scores: DataFrame, lower_is_better: bool, pass_fail: bool) -> DataFrame:
    """(metric, stratum, s, n): how many cases of a stratum have a score, the better one the larger; rows without metric, score or severity are left out."""
    held = scores.where("metric is not null and ms is not null and gold_rank is not null")
    stratum = F.when(F.col("gold_rank") > 0, 1).otherwise(0) if pass_fail else F.col("gold_rank")
    return held.groupBy("metric", stratum.alias("stratum"), (-F.col("ms") if lower_is_better else F.col("ms")).alias("s")).agg(F.count("*").alias("n"))


def _ranged(cells: DataFrame, ranges: int) -> DataFrame:
    """Adds `range`: scores of a metric cut into about so many ranges of as many distinct scores, by a quantile sketch.

    A sketch merges over tasks and a metric's cuts are one small row, so any
    scale of scores gives ranges, and equal scores share one.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array().cast("array<double>")
    cuts = cells.groupBy("metric").agg((F.percentile_approx("s", shares, F.lit(ACCURACY)) if ranges > 1 else F.first(F.array().cast("array<double>"))).alias("_cuts"))
    # A row per metric, each a list of `ranges` numbers at most.
    cut = cells.join(F.broadcast(cuts), "metric")
    return cut.withColumn("range", F.size(F.filter("_cuts", lambda c: c < F.col("s")))).drop("_cuts")


def _ranking(cells: DataFrame, ranges: int) -> DataFrame:
    """comparisons, correct, ties over all pairs of strata: a better stratum is the smaller number.

    What stands below a score is the total of lower ranges and a prefix sum
    within its own, so a metric's distinct scores do not meet in one task.
    """
    h = _ranged(cells, ranges)
    own = {r: F.sum(F.when(F.col("stratum") == r, F.col("n")).otherwise(0)).alias(f"own_{r}") for r in STRATA}
    by_score = h.groupBy("metric", "range", "s").agg(*own.values())
    lower = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("metric", "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    totals = by_score.groupBy("metric", "range").agg(*[F.sum(f"own_{r}").alias(f"own_{r}") for r in STRATA])
    below = totals.select("metric", "range", *[F.coalesce(F.sum(f"own_{r}").over(lower), none).alias(f"below_{r}") for r in STRATA])
    by_score = by_score.join(below, ["metric", "range"]).select("*", *[(F.col(f"below_{r}") + F.coalesce(F.sum(f"own_{r}").over(within), none)).alias(f"low_{r}") for r in STRATA])
    total = lambda expr: F.sum(sum((expr(i, j) for i, j in BETTER), F.lit(0)))
    out = by_score.groupBy("metric").agg(
        total(lambda i, j: F.col(f"low_{j}") * F.col(f"own_{i}")).alias("correct"),
        total(lambda i, j: F.col(f"own_{i}") * F.col(f"own_{j}")).alias("ties"),
        *[F.sum(f"own_{r}").alias(f"n_{r}") for r in STRATA],
    )
    comparisons = sum((F.col(f"n_{i}") * F.col(f"n_{j}") for i, j in BETTER), F.lit(0))
    return out.select("metric", comparisons.alias("comparisons"), "correct", "ties").withColumn("accuracy", F.col("correct") / F.nullif(F.col("comparisons"), F.lit(0)))


BETTER = [(i, j) for i in STRATA for j in STRATA if i < j]


def severity_ranking(scores: DataFrame, *, lower_is_better: bool = False, pass_fail: bool = False, ranges: int = RANGES) -> DataFrame:
    """How often the better of two differently severe cases has the better score, over all pairs, from prefix sums of the score histogram.

    Reads metric, ms (a number on any scale) and gold_rank; rows without one of
    them are left out. The windows run over the distinct scores of one of about
    `ranges` ranges, not over cases. `pass_fail`: only whether there is an error
    at all counts.
    """
    return _ranking(_cells(scores, lower_is_better, pass_fail), ranges)


def severity_ranking_theta(scores: DataFrame, *, lower_is_better: bool = False, ranges: int = RANGES) -> DataFrame:
    """The same by comparing pairs, for cross-checks: ranges of scores with one another by their totals, and only the scores of one range score by score."""
    h = _ranged(_cells(scores, lower_is_better, False), ranges)
    totals = h.groupBy("metric", "range", "stratum").agg(F.sum("n").alias("n"))

    def met(rows: DataFrame, same: str, won: str, tied: str) -> DataFrame:
        n = F.expr("g.n * w.n")
        both = rows.alias("g").join(rows.alias("w"), F.expr(f"g.metric = w.metric and g.stratum < w.stratum and {same}"))
        return both.select(F.col("g.metric").alias("metric"), n.alias("n"), F.when(F.expr(won), n).otherwise(0).alias("won"), F.when(F.expr(tied), n).otherwise(0).alias("tied"))

    pairs = met(totals, "g.range <> w.range", "g.range > w.range", "false").unionByName(met(h, "g.range = w.range", "g.s > w.s", "g.s = w.s"))
    out = pairs.groupBy("metric").agg(F.sum("n").alias("comparisons"), F.sum("won").alias("correct"), F.sum("tied").alias("ties"))
    return out.withColumn("accuracy", F.col("correct") / F.nullif(F.col("comparisons"), F.lit(0)))
