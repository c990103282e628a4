"""A round of label propagation needs one aggregate per item and one per unit."""

from barwright.llm import shards


def test_rounds_aggregate_items_and_units_once(spark, monkeypatch):
    plans, cut = [], shards.materialize
    monkeypatch.setattr(shards, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    line = "a line that is long enough to link its texts"
    rows = spark.createDataFrame([(i, f"{line} {i % 3}\nown words {i}") for i in range(12)], "doc_id bigint, text string")
    assert shards.assign(rows, shards=2, rounds=1).count() == 12
    assert len(plans) > 3 and not any(part in plan for plan in plans for part in ("max_by", "map_from_entries"))
