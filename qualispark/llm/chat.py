"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Backslashes doubled and `<|` broken up, so that no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\/", "$1\n"))


def expand_conversations(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply: str = "assistant"
) -> DataFrame:
    """(conv_id, example, is_last, formatted, loss_start, loss_end): one example for each reply of a conversation.

    `formatted` holds all turns before the reply and the reply itself; only the
    reply's text, from code point `loss_start` up to `loss_end`, is to be trained
    on. Turns after the last reply, or of a conversation without one, make a last
    example with an empty loss span, so that no turn is lost. Turns go by
    `turn` (null first; ties by role, then text); null role and text are empty.
    Rows with a null conversation are left out; an empty table gives no example.
    A conversation is put together in one row, and its examples are streamed from
    there: an example is never longer than its conversation.
    """
    said = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    gathered = (
        turns.where(F.col(conv_id).isNotNull())
        .groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.array_sort(F.collect_list(said)).alias("said"))
    )
    heads = F.transform("said", lambda s: F.concat(F.lit(START), _escape_role(s["r"]), F.lit("\n")))
    bodies = F.transform("said", lambda s: escape(s["x"]))
    places = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: (F.get("said", i - 1)["r"] == reply) | (i == F.size("said")))
    parts = (
        gathered.select("conv_id", places.alias("places"), F.transform("said", lambda s: s["r"]).alias("roles"), heads.alias("heads"), bodies.alias("bodies"))
        .withColumn("parts", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
        .select("*", F.posexplode("places").alias("example", "place"))
    )
    return (
        parts.withColumn("formatted", F.array_join(F.slice("parts", F.lit(1), F.col("place")), ""))
        .withColumn("_end", F.length("formatted") - len(END))
        .withColumn("loss_end", F.col("_end"))
        .withColumn("loss_start", F.when(F.get("roles", F.col("place") - 1) == reply, F.col("_end") - F.length(F.get("bodies", F.col("place") - 1))).otherwise(F.col("_end")))
        .select("conv_id", F.col("example").cast("long").alias("example"), (F.col("example") == F.size("places") - 1).alias("is_last"), "formatted", F.col("loss_start").cast("long").alias("loss_start"), F.col("loss_end").cast("long").alias("loss_end"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array<struct<role, text>>."""
    chunks = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), lambda c: F.substring(c, len(START) + 1, 2147483647))
    return F.transform(
        bodies,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + F.lit(2), F.lit(2147483647))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))
