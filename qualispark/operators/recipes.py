"""Runs of translation recipes: status, findings, and head-to-head comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.columns import canonical_json, canonical_text, quoted, safe_rate, slugify, stable_digest, swap_verdict
from qualispark.operators.checks import refuse, repeated


def execution_status(execution_failure: Column, parsed: Column, item_count_match: Column) -> Column:
    """execution_failure first, then structured_output_failure unless both flags are true, then completed."""
    ok = F.coalesce(parsed & item_count_match, F.lit(False))
    return F.when(F.coalesce(execution_failure, F.lit(False)), "execution_failure").when(~ok, "structured_output_failure").otherwise("completed")


def hard_pass_flag(status: Column, passed: Column) -> Column:
    """Three-valued: null unless completed."""
    return F.when(status == "completed", passed)


def eligible(status: Column | str = "status", passed: Column | str = "passed") -> Column:
    s, p = (F.col(x) if isinstance(x, str) else x for x in (status, passed))
    return F.coalesce((s == "completed") & p, F.lit(False))


def explode_findings(runs: DataFrame, items: DataFrame) -> DataFrame:
    """(recipe, case_no, item_no, source, code): validation findings, failed parity checks, and one made-up finding where a hard failure has neither."""
    own = items.where("has_finding").select("recipe", "case_no", "item_no", F.lit("validation").alias("source"), "code")
    parity = items.where("parity_failed").select("recipe", "case_no", "item_no", F.lit("token_parity").alias("source"), F.lit(None).cast("string").alias("code"))
    found = own.unionByName(parity)
    bare = (
        runs.where("passed = false")
        .join(found.select("recipe", "case_no").distinct(), ["recipe", "case_no"], "left_anti")
        .select("recipe", "case_no", F.lit(None).cast("int").alias("item_no"), F.lit("hard_validation").alias("source"), F.lit("no_structured_finding").alias("code"))
    )
    return found.unionByName(bare)


def automatic_metrics(results: DataFrame, score: str = "score") -> DataFrame:
    """The score's fields but its items as columns, with the elapsed seconds."""
    return results.select("*", f"{score}.*").drop(score, "items")


def recipe_snapshot(runs: DataFrame, prompts: str = "prompt_sha256") -> DataFrame:
    """(recipe, prompts, snapshot_sha256, recipe_id): distinct sorted prompt hashes and a compact digest of them with the name."""
    sets = runs.groupBy("recipe").agg(F.array_join(F.sort_array(F.collect_set(prompts)), ",").alias("prompts"))
    digest = stable_digest(canonical_json({"prompts": F.col("prompts"), "recipe": F.col("recipe")}, compact=True))
    return sets.withColumn("snapshot_sha256", digest).withColumn("recipe_id", F.concat(slugify("recipe"), F.lit("-"), F.left("snapshot_sha256", F.lit(12))))


SNAPSHOT = ("fixture_sha256", "model_id", "model_label", "provider", "track")


def artifact_recipes(results: DataFrame, *, revision: str, prompts: str = "prompt_sha256", policy: str = "policy") -> DataFrame:
    """(provider, model_id, model_label, track, fixture_sha256, policy, prompts, snapshot, snapshot_sha256, recipe_id) of benchmark results.

    `snapshot` is the compact JSON of all that makes a recipe: adapter revision,
    fixture, model, provider, track, policy (any type; null: an empty object) and the sorted distinct
    prompt hashes (null and empty ones left out); its digest is the recipe's, its
    id is made of provider, model and track.
    """
    kind = results.schema[policy].dataType
    rules = F.when(F.col(policy).isNotNull(), canonical_text(policy, kind, compact=True)).otherwise("{}").alias("policy")
    keyed = results.select(*SNAPSHOT, rules, F.nullif(F.col(prompts), F.lit("")).alias("_prompt")).distinct()
    sets = keyed.groupBy(*SNAPSHOT, "policy").agg(F.sort_array(F.collect_set("_prompt")).alias("prompts"))
    text = lambda n: F.coalesce(quoted(n), F.lit("null"))
    members = {n: text(n) for n in SNAPSHOT} | {"adapter_revision": quoted(F.lit(revision)), "policy": F.col("policy"), "prompt_sha256": canonical_text("prompts", "array<string>", compact=True)}
    body = F.array_join(F.array(*[F.concat(F.lit(f'"{n}":'), members[n]) for n in sorted(members)]), ",")
    snapshot = F.concat(F.lit("{"), body, F.lit("}"))
    return sets.withColumn("snapshot", snapshot).withColumn("snapshot_sha256", stable_digest(F.col("snapshot"))).withColumn("recipe_id", F.concat_ws(".", slugify("provider"), slugify("model_id"), slugify("track")))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("recipe").agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "execution_failure").alias("execution_failures"),
        F.count_if(F.col("status") == "structured_output_failure").alias("structured_failures"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("hard_pass"),
    )


def paired_runs(runs: DataFrame, *, strict: bool = True) -> DataFrame:
    """Every case of every two recipes (left before right by name), joined on the case.

    `strict`: recipes that share a hash (`recipe_sha256`, if there), a case that not every
    recipe has, and a case that a recipe has twice fail the job and are named; else cases are joined where both have them.
    """
    r = runs.withColumn("eligible", eligible()).select("recipe", "case_id", "track", "eligible")
    one, two = r.alias("a"), r.alias("b")
    out = one.join(two, F.expr("a.case_id = b.case_id and a.recipe < b.recipe")).select(
        F.col("a.recipe").alias("left"), F.col("b.recipe").alias("right"), F.col("a.case_id").alias("case_id"), F.col("a.track").alias("track"), F.col("a.eligible").alias("left_eligible"), F.col("b.eligible").alias("right_eligible")
    )
    if not strict:
        return out
    many = F.broadcast(r.agg(F.count_distinct("recipe").alias("recipes")))
    held = r.groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct("recipe").alias("own")).crossJoin(many)
    out = refuse(out, held.where("n <> own or own <> recipes"), "case_id", "runs must hold the same case ids, each once")
    if "recipe_sha256" in runs.columns:
        out = refuse(out, repeated(runs.select("recipe", "recipe_sha256").distinct(), "recipe_sha256"), "recipe_sha256", "a comparison needs distinct recipe hashes")
    return out


def hard_veto_decisions(pairs: DataFrame) -> DataFrame:
    """Pairs that hard validation decides: the one eligible side wins, or neither."""
    l, r = F.col("left_eligible"), F.col("right_eligible")
    return pairs.where(~(l & r)).withColumn("winner", F.when(l, "left").when(r, "right").otherwise("neither")).withColumn("decision_source", F.lit("hard_validation"))


def soft_comparison_cases(pairs: DataFrame) -> DataFrame:
    """Pairs of eligible outputs for a judge, with an id for each two recipes: sixteen hexadecimal digits."""
    pair = F.left(F.sha2(F.concat_ws(":", "left", "right"), 256), F.lit(16))
    kind = F.when(F.col("track") == "repair", "repair").otherwise("translate")
    return pairs.where("left_eligible and right_eligible").select("left", "right", pair.alias("pair_id"), "case_id", "track", kind.alias("instruction"))


def over_edited_cases(runs: DataFrame) -> DataFrame:
    """(recipe, case_id): completed cases of the repair track whose text should have stayed but was changed, a row each."""
    return runs.where("track = 'repair' and status = 'completed' and unchanged = false").select("recipe", "case_id")


def repair_restraint(runs: DataFrame, *, list_ids: bool = False) -> DataFrame:
    """Per recipe on the repair track: restraint and exactness over completed cases, hard passes over all. Reads `unchanged` and `exact` (null: neither).

    `list_ids` adds the ids of over-edited cases as one string, for small runs;
    `over_edited_cases` gives them as rows.
    """
    done = F.col("status") == "completed"
    over = done & (F.col("unchanged") == F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ids = [F.array_join(F.array_sort(F.collect_list(F.when(over, F.col("case_id")))), ",").alias("over_edited_ids")] if list_ids else []
    return runs.where("track = 'repair'").groupBy("recipe").agg(
        F.count("*").alias("case_count"),
        n(done).alias("completed"),
        n(eligible()).alias("hard_pass"),
        n(done & F.col("unchanged")).alias("unchanged"),
        n(over).alias("over_edited"),
        n(done & F.col("exact")).alias("exact_matches"),
        safe_rate(n(over), n(done)).alias("over_edit_rate"),
        *ids,
    )


def judge_pair_decision(base: Column, swap: Column) -> Column:
    """left, right, tie, neither or uncertain where base and swapped verdict agree; else unresolved. Null verdicts are missing or invalid."""
    agreed = base == swap_verdict(swap)
    named = F.when(base == "candidate_a", "left").when(base == "candidate_b", "right").otherwise(base)
    return F.when(F.coalesce(agreed, F.lit(False)), named).otherwise("unresolved")


def judged_decisions(soft: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Soft cases with a judge's decision. `verdicts` has left, right, case_id, base and swap."""
    j = soft.join(verdicts, ["left", "right", "case_id"], "left")
    missing = F.col("base").isNull() | F.col("swap").isNull()
    winner = judge_pair_decision(F.col("base"), F.col("swap"))
    source = F.when(missing, "judge_missing_or_invalid").when(winner == "unresolved", "judge_position_inconsistent").otherwise("judge_position_consistent")
    return j.withColumn("winner", winner).withColumn("decision_source", source)


def pairwise_report(decisions: DataFrame) -> DataFrame:
    """Counts by winner and source for every two recipes; `uncertain` is counted too."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    return decisions.groupBy("left", "right").agg(
        F.count("*").alias("case_count"),
        *[n("winner", w).alias(f"{w}_count") for w in ("left", "right", "tie", "neither", "unresolved", "uncertain")],
        *[n("decision_source", s).alias(s) for s in ("hard_validation", "judge_position_consistent", "judge_position_inconsistent", "judge_missing_or_invalid")],
    )


def tournament_standings(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Wins, losses, ties, neither, unresolved and hard passes of each recipe over all pairs, ranked by wins, then fewer losses."""
    sides = decisions.select(F.explode(F.array(*[F.struct(F.col(s).alias("recipe"), F.lit(s).alias("side")) for s in ("left", "right")])).alias("s"), "winner")
    own = F.col("s.side")
    won = (F.col("winner") == own)
    lost = F.col("winner").isin("left", "right") & (F.col("winner") != own)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    table = sides.groupBy("s.recipe").agg(n(won).alias("wins"), n(lost).alias("losses"), n(F.col("winner") == "tie").alias("ties"), n(F.col("winner") == "neither").alias("neither"), n(F.col("winner").isin("unresolved", "uncertain")).alias("unresolved"))
    passes = runs.groupBy("recipe").agg(n(eligible()).alias("hard_passes"))
    return table.join(passes, "recipe").withColumn("rank", F.rank().over(Window.orderBy(F.desc("wins"), "losses")).cast("long"))
