"""The metric tables' documents are written from one pass over the scores."""

from qualispark.plans import artifacts, catalog


def test_scores_are_gathered_once(spark, monkeypatch):
    gathered, whole = [], artifacts._gathered
    monkeypatch.setattr(artifacts, "_gathered", lambda *a: gathered.append(a) or whole(*a))
    rows = catalog.QUERIES["read_metric_tables"](spark, "/root/testdata/sf0.001").collect()
    assert len(gathered) == 1
    assert {r.metric for r in rows} == {"up", "down"} and len({(r.id, r.metric) for r in rows}) == len(rows) > 0
    assert all(r.source == r.id.split("/")[0] for r in rows)
