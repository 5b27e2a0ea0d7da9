"""From raw documents to piece ids: language, boilerplate lines, near duplicates, benchmark passages, encoding.

For every stage: an empty table gives an empty table; columns beside those of
`documents` are left out, whatever their names; rows with a null id are judged
by their text like any other, but group with nothing and stay in MinHash
near-dedup; rows that share an id are one document to MinHash near-dedup, which
keeps or drops them together, and documents of their own elsewhere. Whole texts
count, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualispark.llm.common import checkpoint
from qualispark.llm.decontaminate import contaminated
from qualispark.llm.language import fit, identify, sample_labelled
from qualispark.llm.line_dedup import remove_boilerplate
from qualispark.llm.minhash import near_duplicates
from qualispark.llm.pieces import encode_documents

#: A text in which no language stands out: the best of its class shares is below this.
LEAST_SHARE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among `ids`; those with a null id stay."""
    return docs.select(*COLUMNS).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts, and texts in which no language stands out.

    Ties between languages go to the first in order. Without a labelled text
    every text is rejected.
    """
    model = fit(*sample_labelled(docs))
    return identify(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of lines on many sites go; so do documents of which they leave nothing.

    Null, empty and blank texts stay as they are. A null source is no site. Of a
    line on many sites, its first place in the document of smallest id stays.
    """
    cleaned = remove_boilerplate(docs.select(*COLUMNS))
    return (
        cleaned.where((F.col("lines_removed") == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
        .withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id.

    Null, empty and blank texts are like nothing and stay.
    """
    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; null and blank items are in no text."""
    found = contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding them gives the text back. Null text: null ids, none of them, true."""
    encoded = encode_documents(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        "piece_ids",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.translate("text", "▁", " ")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: Stages 1 and 3 to 5 have no SQL form; tests/llm/test_pipeline.py holds all rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps is written to the checkpoint folder, so that later passes do not make it anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
