"""Grouping of annotations and deterministic sampling by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.columns import (
    is_even_digest,
    json_array,
    max_severity_of_errors,
    normalize_category_lenient,
    normalize_phenomenon,
    parse_span_markup,
    primary_category_of_errors,
    severity_name,
    severity_rank,
    stable_digest,
)
from qualispark.operators.checks import one_sided, refuse, repeated, required

#: Hexadecimal digits of a digest by which rows are counted before they are ranked: 4,096 buckets of like size.
PREFIX = 3
#: Rows that may be ranked in one task, and rounds that are added up together.
AT_ONCE, ROUNDS = 10_000, 100_000


def key_digest(*keys: Column | str) -> Column:
    """SHA-256 of the JSON array of key values as strings."""
    return stable_digest(json_array([(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def group_mqm_ratings(rows: DataFrame, *, keys: tuple[str, ...] = ("system", "doc_id", "seg_id", "rater", "source", "target"), position: str = "pos") -> DataFrame:
    """Annotation rows as one row per rated segment: highest severity, and category and phenomenon of the first row that has it.

    The severity counts after trimming, but the first row is looked for without;
    if none matches, it is the group's first row.
    """
    severity = F.coalesce("severity", F.lit(""))
    rank = F.coalesce(severity_rank(F.lower(F.trim(severity))), F.lit(0))
    top = rows.withColumn("_rank", rank).groupBy(*keys).agg(F.max("_rank").alias("_top"), F.collect_list(F.struct(F.col(position).alias("p"), F.lower(severity).alias("s"), F.col("category").alias("c"))).alias("_rows"))
    ordered = F.array_sort("_rows")
    first = F.coalesce(F.get(F.filter(ordered, lambda r: r["s"] == severity_name("_top")), F.lit(0)), F.get(ordered, F.lit(0)))["c"]
    return top.select(*keys, severity_name("_top").alias("severity"), normalize_category_lenient(first).alias("category"), normalize_phenomenon(first, "no-error").alias("phenomenon"))


def gold_from_spans(rated: DataFrame, errors: str = "errors") -> DataFrame:
    """Adds gold_verdict, gold_severity and gold_category; any error at all is a fail, also a neutral one."""
    return rated.withColumn("gold_verdict", F.when(F.size(errors) > 0, "fail").otherwise("pass")).withColumn("gold_severity", max_severity_of_errors(errors)).withColumn("gold_category", primary_category_of_errors(errors))


def rated_segments(segments: DataFrame, outputs: DataFrame, ratings: DataFrame, *, raters: DataFrame | None = None, systems: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Sources, outputs, ratings and raters of a segment side by side; unrated segments (errors null) are left out.

    `segments` has a row per segment (with its source, reference, document,
    domain), `outputs` and `ratings` a row per system and segment, `raters` too
    (its `rater` column is carried). `systems` chooses systems of the ratings.
    `strict`: a system without outputs or raters, one whose rows do not match the
    segments one by one, a system asked for that has no ratings, and a
    segment that comes twice fail the job; else what has no partner is dropped.
    """
    keys = ["system", "segment"]
    chosen = ratings if systems is None else filter_systems(ratings, systems)
    out = chosen.where("errors is not null").join(outputs, keys).join(segments, "segment")
    if raters is not None:
        out = out.join(raters.select(*keys, "rater"), keys)
    if not strict:
        return out
    parts = {"ratings": chosen, "outputs": outputs} | ({} if raters is None else {"raters": raters})
    names = chosen.select("system").distinct()
    # Every system needs every segment once: keys that one of the tables lacks, and tables of another length.
    wanted = {name: df.join(names, "system", "left_semi").select(F.struct(*keys).alias("_key")) for name, df in parts.items()}
    out = refuse(out, one_sided(wanted, "_key"), F.struct("_key", "missing").cast("string"), "segments of a system lack ratings, outputs or raters")
    held = chosen.select("segment").distinct()
    out = refuse(out, one_sided({"ratings": held, "segments": segments.select("segment")}, "segment"), F.struct("segment", "missing").cast("string"), "segments and ratings do not match")
    counts = chosen.groupBy("system").agg(F.count("*").alias("n")).crossJoin(F.broadcast(segments.agg(F.count("*").alias("all"))))
    out = refuse(out, counts.where("n <> all"), "system", "the segments of a system are not as many as there are")
    for name, df in (*wanted.items(), ("segments", segments.select(F.col("segment").alias("_key")))):
        out = refuse(out, repeated(df, "_key"), F.col("_key").cast("string"), f"{name} come twice for a segment")
    if systems is not None:
        out = refuse(out, unknown_systems(ratings, systems), "system", "no ratings of a system")
    return out


def rated_cases(rated: DataFrame, prefix: str) -> DataFrame:
    """Rated segments as cases; the id is the prefix and twelve hexadecimal digits of the key's digest."""
    d = key_digest("system", "segment")
    return gold_from_spans(rated).withColumn("case_id", F.concat(F.lit(prefix), F.left(d, F.lit(12))))


def filter_systems(df: DataFrame, systems: list[str], column: str = "system") -> DataFrame:
    return df.where(F.col(column).isin(systems))


def unknown_systems(df: DataFrame, systems: list[str], column: str = "system") -> DataFrame:
    """The asked-for names that no row has."""
    asked = df.sparkSession.createDataFrame([(s,) for s in systems], f"{column} string")
    return asked.join(df.select(column).distinct(), column, "left_anti")


def filter_strata(df: DataFrame, strata: DataFrame, *columns: str) -> DataFrame:
    return df.join(strata.select(*columns).distinct(), list(columns), "left_semi")


def _ranked(df: DataFrame, keys: list[str], limit: int | Column) -> DataFrame:
    """Adds `round`, the place of a row in its group by `digest`, and keeps the first `limit` of each group.

    Rows are counted by group and leading digits of the digest. Buckets that
    start beyond the limit are dropped before rows meet, and a row's place is
    the number before its bucket and its place within. So no group, however
    large, is sorted in one task, whatever the limit.
    """
    d = df.withColumn("_prefix", F.left("digest", F.lit(PREFIX)))
    counts = d.groupBy(*keys, "_prefix").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < limit)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_prefix")]
    joined = d.alias("a").join(counts.select(*keys, "_prefix", "_before").alias("b"), same).select("a.*", "b._before")
    place = F.row_number().over(Window.partitionBy(*keys, "_prefix").orderBy("digest"))
    return joined.withColumn("round", F.col("_before") + place).where(F.col("round") <= limit).drop("_prefix", "_before")


def severity_round_robin(df: DataFrame, limit: int, *, severity: str = "gold_severity", digest: Column) -> DataFrame:
    """Rounds of one row per severity, the most severe first, in the order of digests, until `limit` rows."""
    return _rounds(_ranked(df.withColumn("digest", digest), [severity], limit), limit, -severity_rank(severity))


def _rounds(ranked: DataFrame, limit: int, order: Column) -> DataFrame:
    """The first rows by round and `order`, with their place from 1.

    Rounds are windows of their own, a row per group; the rows of earlier rounds
    are added up by ranges of rounds.
    """
    sizes = ranked.groupBy("round").agg(F.count("*").alias("_n")).withColumn("_range", F.floor(F.col("round") / ROUNDS))
    ranges = sizes.groupBy("_range").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = ranges.select("_range", before(Window.orderBy("_range")).alias("_shift"))
    sizes = sizes.withColumn("_before", before(Window.partitionBy("_range").orderBy("round"))).join(shift, "_range").select("round", (F.col("_before") + F.col("_shift")).alias("_before"))
    placed = ranked.join(sizes.where(F.col("_before") < limit), "round")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("round").orderBy(order, "digest"))
    return placed.withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("_before").select(*ranked.columns, "place")


def stratified_round_robin(df: DataFrame, keys: list[str], limit: int, *, digest: Column) -> DataFrame:
    """Rounds of one row per group; groups go by the digest of their key, rows by their own."""
    ranked = _ranked(df.withColumn("digest", digest), keys, limit)
    return _rounds(ranked.withColumn("group_digest", key_digest(*keys)), limit, F.col("group_digest"))


def slot_quota_sample(df: DataFrame, slots: list[tuple[str, str | None]], *, by: str, digest: Column) -> DataFrame:
    """For each value of `by`: slot after slot (severity, category or any) takes the row of smallest digest that no earlier slot took.

    Rows are cut to as many per (by, severity, category) as there are slots
    before they meet, so what a task resolves is bounded by the slots.
    """
    n = len(slots)
    d = df.withColumn("digest", digest)
    near = Window.partitionBy(by, "gold_severity", "gold_category").orderBy("digest")
    small = d.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= n).select(by, "case_id", "gold_severity", "gold_category", "digest")
    pool = small.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("digest", "case_id", "gold_severity", "gold_category"))).alias("pool"))
    taken = F.array().cast("array<string>")
    out = pool.withColumn("taken", taken)
    for severity, category in slots:
        free = F.filter("pool", lambda r: (r["gold_severity"] == severity) & (F.lit(True) if category is None else r["gold_category"] == category) & ~F.coalesce(F.array_contains("taken", r["case_id"]), F.lit(False)))  # noqa: B023
        out = out.withColumn("taken", F.concat("taken", F.array(F.get(free, F.lit(0))["case_id"])))
    return out.select(by, F.posexplode("taken").alias("slot", "case_id")).withColumn("slot", (F.col("slot") + 1).cast("long"))


def slot_nth_sample(df: DataFrame, slots: DataFrame, keys: list[str], *, digest: Column) -> DataFrame:
    """The k-th slot of a group takes the row with the k-th smallest digest. `slots` has the keys and `occurrence`; no more rows of a group are ranked than the largest asks for."""
    most = slots.groupBy(*keys).agg(F.max("occurrence").alias("_most"))
    ranked = _ranked(df.join(most, keys).withColumn("digest", digest), [*keys, "_most"], F.col("_most"))
    return ranked.withColumnRenamed("round", "occurrence").drop("_most").join(slots, [*keys, "occurrence"])


def holdout_split(df: DataFrame, n: int, *, case_id: str = "case_id") -> DataFrame:
    """Adds `split`: holdout for the cases of the n smallest id digests, calibration for the rest.

    Rows of one id are one case and go together, as many as they are; a null id
    is calibration. The n-th digest is found by counting digests by their first
    digits, then those of the bucket that holds it by the next, until a bucket is small.
    """
    digest = F.when(F.col(case_id).isNotNull(), stable_digest(json_array([F.col(case_id)])))
    last = nth_digest(df.select(digest.alias("d")), "d", n)
    chosen = F.lit(False) if last is None else F.coalesce(digest <= last, F.lit(False))
    return df.withColumn("split", F.when(chosen, "holdout").otherwise("calibration"))


def nth_digest(df: DataFrame, column: str, n: int) -> str | None:
    """The n-th smallest distinct value of a column of hexadecimal digests, the largest if there are fewer; none for n below 1 and for no values.

    A job for each step gives one row to the driver: the bucket of the n-th
    value and how many come before. Buckets are of 65,536 to a step, and only a
    bucket of few values is sorted.
    """
    if n < 1:
        return None
    known = ""
    values = df.where(F.col(column).isNotNull()).select(column)
    if n <= AT_ONCE:  # tasks send no more than so many each
        return values.distinct().orderBy(column).limit(n).agg(F.max(column)).first()[0]
    while True:
        bucket = F.substring(column, len(known) + 1, 4)
        distinct = values.where(F.col(column).startswith(known)).distinct()
        counts = distinct.groupBy(bucket.alias("b")).agg(F.count("*").alias("m"), F.max(column).alias("top"))
        upto = counts.withColumn("upto", F.sum("m").over(Window.orderBy("b")))
        found = upto.agg(F.min_by(F.struct("b", "m", "upto"), F.when(F.col("upto") >= n, F.col("upto"))).alias("hit"), F.max("top").alias("top")).first()
        if found.hit is None:
            return found.top
        known, n = known + found.hit.b, n - (found.hit.upto - found.hit.m)
        if found.hit.m <= AT_ONCE:
            return distinct.where(F.col(column).startswith(known)).orderBy(column).limit(n).agg(F.max(column)).first()[0]


def contrastive_cases(pairs: DataFrame, digest: Column) -> DataFrame:
    """A good and an incorrect text as candidates A and B; which is which goes by the digest's parity."""
    even = is_even_digest(digest)
    return pairs.select(
        "*",
        F.when(even, F.col("good")).otherwise(F.col("incorrect")).alias("first"),
        F.when(even, F.col("incorrect")).otherwise(F.col("good")).alias("second"),
        F.when(even, "candidate_a").otherwise("candidate_b").alias("winner"),
    )


def span_alignment_flag(df: DataFrame, markup: str, incorrect: str) -> DataFrame:
    """Adds `markup` parsed (m) and whether its clean text is the incorrect candidate (aligned)."""
    return df.withColumn("m", parse_span_markup(markup)).withColumn("aligned", F.coalesce(F.col("m.clean") == F.col(incorrect), F.lit(False)))


def content_digest(sample: DataFrame, *, place: str, digest: str) -> DataFrame:
    """One row: the digest of a sample's digests in order. The sample is bounded by its limit."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(digest).alias("d"))))
    return sample.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["d"]), "\n"), 256).alias("content_sha256"), F.count("*").alias("n"))


def select_cases(cases: DataFrame, ids: DataFrame | None = None, first: int | None = None, *, order: str = "k", strict: bool = True) -> DataFrame:
    """The cases of given ids, and of these the first by `order`. `strict`: an id that no case has fails the job."""
    if ids is None:
        return cases if first is None else cases.orderBy(order).limit(first)
    asked = ids.select("case_id").distinct()
    chosen = cases.join(asked, "case_id", "left_semi")
    out = chosen if first is None else chosen.orderBy(order).limit(first)
    return refuse(out, asked.join(cases, "case_id", "left_anti"), "case_id", "unknown case ids") if strict else out


def assemble_mixed_pack(parts: dict[str, DataFrame], holdout: int) -> DataFrame:
    """The union of several origins' cases, tagged with their origin and split; judge outputs are dropped."""
    out = None
    for origin, df in parts.items():
        tagged = df.drop("judge_output", "swap_judge_output", "origin").withColumn("origin", F.lit(origin))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return holdout_split(out, holdout)


def pack_profile(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n): counts by each key in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return cases.select(pairs.alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))
