"""Removal of boilerplate lines that spread over many sites (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 5
LG_K = 10
#: Sketch estimates within this share of the threshold are counted exactly.
BAND = 0.35
_KEY = ["_line_a", "_line_b"]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    band: float = BAND,
) -> DataFrame:
    """(_line_a, _line_b, _line_first): 96-bit keys of the lines on `min_sites` distinct sites or more, and their smallest doc_id.

    Repeats of a line on a site collapse before the shuffle, so a hot site or
    line costs no more than any other. Lines of a single site are dropped by a
    min/max aggregate; the others get one HyperLogLog sketch of their sites per
    line hash, merged by aggregation. Estimates clearly above or below the
    threshold decide; lines near it get an exact distinct count. A null site is
    no site; blank lines are never boilerplate.
    """
    pairs = (
        docs.select(F.col(doc_id).alias("_doc"), F.col(site).alias("_site"), F.explode(_split(F.col(text))).alias("_l"))
        .where(F.col("_site").isNotNull() & (F.trim("_l") != ""))
        .select("_doc", F.xxhash64("_l").alias("_line_a"), F.hash("_l").alias("_line_b"), F.xxhash64("_site").alias("_site"))
        .groupBy(*_KEY, "_site")
        .agg(F.min("_doc").alias("_line_first"))
    )
    sketched = (
        pairs.groupBy(*_KEY)
        .agg(F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
        .where("_lo <> _hi" if min_sites > 1 else "true")
        .select(*_KEY)
        .join(pairs, _KEY)
        .groupBy(*_KEY)
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_guess"),
            F.min("_line_first").alias("_line_first"),
        )
    )
    sure = sketched.where(F.col("_guess") >= min_sites * (1 + band)).select(*_KEY, "_line_first")
    near = sketched.where((F.col("_guess") >= min_sites * (1 - band)) & (F.col("_guess") < min_sites * (1 + band)))
    exact = (
        pairs.join(near.select(*_KEY), _KEY, "left_semi")
        .groupBy(*_KEY)
        .agg(F.count("*").alias("_sites"), F.min("_line_first").alias("_line_first"))
        .where(F.col("_sites") >= min_sites)
        .select(*_KEY, "_line_first")
    )
    return sure.unionByName(exact)


def remove_boilerplate(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    band: float = BAND,
) -> DataFrame:
    """The documents without repeats of the lines that spread over `min_sites` or more sites.

    Every column of `docs` stays; of each boilerplate line only the first
    occurrence is left (in the smallest `doc_id`, at its first place there; for
    a line that also occurs without a site, the smallest with one), and the
    columns `lines_total` and `lines_removed` are added. Null and empty text:
    one blank line, nothing removed, text as it was. A document that was all
    repeats keeps an empty text. Rows with a null `doc_id` are kept as they are. `doc_id` must be unique. Repeated rows of equal text count once
    per site. Names that begin with `_line` are reserved.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    flagged = boilerplate_lines(known, doc_id=doc_id, text=text, site=site, min_sites=min_sites, lg_k=lg_k, band=band)
    # The places of boilerplate lines; where a document is the first of a line, its first place stays.
    gone = (
        known.select(F.col(doc_id).alias("_line_doc"), F.posexplode(_split(F.col(text))).alias("_line_at", "_l"))
        .where(F.trim("_l") != "")
        .select("_line_doc", "_line_at", F.xxhash64("_l").alias("_line_a"), F.hash("_l").alias("_line_b"))
        .join(flagged, _KEY)
        .groupBy("_line_doc", *_KEY)
        .agg(F.collect_list("_line_at").alias("_line_at"), F.min("_line_at").alias("_line_stays"), (F.first("_line_first") == F.col("_line_doc")).alias("_line_own"))
        .select("_line_doc", F.when(F.col("_line_own"), F.array_remove("_line_at", F.col("_line_stays"))).otherwise(F.col("_line_at")).alias("_line_at"))
        .groupBy("_line_doc")
        .agg(F.flatten(F.collect_list("_line_at")).alias("_line_gone"))
    )
    hit = F.size("_line_gone") > 0
    # Sets of whole numbers are told apart by hashing, so work is in proportion to the lines.
    kept = F.array_except(F.sequence(F.lit(0), (F.col("lines_total") - 1).cast("int")), F.col("_line_gone"))
    return (
        docs.join(gone, docs[doc_id] == gone["_line_doc"], "left")
        .withColumn("_line_all", _split(F.col(text)))
        .withColumn("lines_total", F.size("_line_all").cast("long"))
        .withColumn("lines_removed", F.when(hit, F.size("_line_gone")).otherwise(F.lit(0)).cast("long"))
        .withColumn(text, F.when(hit, F.array_join(F.transform(kept, lambda i: F.get("_line_all", i)), "\n")).otherwise(F.col(text)))
        .drop("_line_doc", "_line_gone", "_line_all")
    )
