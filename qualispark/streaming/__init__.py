"""Stateless evaluation operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qualispark.operators.contracts import parsed_judge


def classified_stream(stream: DataFrame, *, case_id: str = "case_id", output: str = "judge_output") -> DataFrame:
    """A stream of judge outputs with base_failure and the parsed members, row by row, without state."""
    return parsed_judge(stream, case_id, output, "base")
