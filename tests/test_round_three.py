"""Findings of round 3."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from qualispark.functions import columns as C
from qualispark.plans import artifacts  # noqa: F401
from qualispark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_repair_restraint_lists_over_edited_cases(spark):
    rows = QUERIES["repair_restraint"](spark, SF).collect()
    cases = QUERIES["over_edited_cases"](spark, SF).collect()
    assert rows and cases
    for r in rows:
        assert r.over_edited_ids.split(",") == sorted(c.case_id for c in cases if c.recipe == r.recipe)


def test_canonical_text_works_each_value_out_once(spark):
    text = spark.range(1).select(C.double_text(F.rand()).alias("t"))
    assert text._jdf.queryExecution().optimizedPlan().toString().count("format_string(") <= 4
    nested = spark.range(1).select(C.canonical_text(F.struct(F.create_map(F.lit("a"), F.rand()).alias("m")), "struct<m:map<string,double>>").alias("t"))
    assert nested._jdf.queryExecution().optimizedPlan().toString().count("rand(") == 1
    rows = spark.createDataFrame([(1.0,), (None,), (1e7,), (1e-3,), (123456789012345.0,), (4e-7,)], "x double").select(C.double_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["1.0", None, "10000000.0", "0.001", "123456789012345.0", "4e-07"]
