"""Refusals: conditions that fail a job and name an example, checked within the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(sound: Column, value: Column, *message: Column | str) -> Column:
    """`value`, or an error that fails the job; null is not sound."""
    said = F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message])
    return F.when(F.coalesce(sound, F.lit(False)), value).otherwise(F.raise_error(said))


def refuse(df: DataFrame, found: DataFrame, example: Column | str, message: str) -> DataFrame:
    """`df`, but if `found` has rows the job fails with their number and the smallest example.

    The check is one small aggregate; it is a branch of the plan of its own, so it holds for an empty `df` too.
    """
    one = found.agg(F.count("*").alias("n"), F.min(F.col(example) if isinstance(example, str) else example).alias("first"))
    said = F.concat(F.lit(f"{message}: "), F.coalesce(F.col("first").cast("string"), F.lit("null")), F.lit(" ("), F.col("n").cast("string"), F.lit(" in all)"))
    none = one.where(F.when(F.col("n") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that rows share."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_sided(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, missing) for keys that not all tables have: each table sends a key once for each of its tasks, no rows are joined."""
    names = list(tables)
    sides = [df.select(F.col(key), F.lit(1 << i).alias("_side")) for i, df in enumerate(tables.values())]
    held = reduce(DataFrame.unionByName, sides).groupBy(key).agg(F.bit_or("_side").alias("_held"))
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.col("_held").bitwiseAND(1 << i) == 0, F.lit(n)) for i, n in enumerate(names)])), ", ")
    return held.where(F.col("_held") != (1 << len(names)) - 1).select(key, lacks.alias("missing"))
