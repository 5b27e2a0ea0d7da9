from __future__ import annotations

from qualispark.streaming import classified_stream


def test_judge_outputs_are_classified_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "{}"), ("b", "no")], "case_id string, judge_output string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case_id string, judge_output string").parquet(str(tmp_path / "in"))
    query = classified_stream(stream).select("case_id", "base_failure").writeStream.format("memory").queryName("classified").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.case_id: r.base_failure for r in spark.table("classified").collect()}
    assert got == {"a": "schema_failure", "b": "json_parse_failure"}
