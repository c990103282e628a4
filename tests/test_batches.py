"""Numbering of overlapping polls, batches beyond the row limit included."""

from collections import defaultdict

from barwright.operators import custody


def test_batches_beyond_the_limit_are_numbered_whole(spark, monkeypatch):
    monkeypatch.setattr(custody, "ROW_LIMIT", 50)
    # One hot batch of 700 ticks, a symbol without a name, a tick without a number, and ticks in two batches.
    rows = [("A", i, 10 + i % 700 / 100) for i in range(700)] + [("A", 1000 + i, 100.0 + i * 7) for i in range(40)] + [(None, 5 * i, 11.0) for i in range(60)] + [("B", None, 12.0), ("B", -3, 12.0), ("B", 4, 12.0)]
    ticks = spark.createDataFrame(rows, "symbol string, tick_id bigint, at double").selectExpr("symbol", "tick_id", "timestamp_micros(cast(at * 1000000 as bigint)) as ts")
    width, overlap = 60_000_000, 10_000_000
    got = custody.assign_batches(ticks, width, overlap, "tick_id").collect()
    want = defaultdict(list)
    for symbol, tick, at in rows:
        us = int(round(at * 1_000_000))
        for batch in [us // width, us // width + 1] if us % width >= width - overlap else [us // width]:
            want[symbol, batch].append(tick)
    want = {(symbol, batch, index): tick for (symbol, batch), ids in want.items() for index, tick in enumerate(sorted(ids, key=lambda i: (i is not None, i)))}
    assert {(r["symbol"], r["batch"], r["response_index"]): r["tick_id"] for r in got} == want and len(got) == len(want)
    sizes = custody.limit_status(custody.batch_table(custody.assign_batches(ticks, width, overlap, "tick_id"), width), 50).collect()
    assert {r["rows"] for r in sizes if r["status"] == "ROW_LIMIT_EXCEEDED_RAW_PRESERVED"} == {700, 60}
    assert custody.assign_batches(ticks.limit(0), width, overlap, "tick_id").count() == 0
