"""The certificate in one pass says what the single checks say, for hand-made faults and for copies of one row in masses."""

import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from barwright.operators import quality as Q

META = {"symbol": "EVT", "point": 0.01, "broker": "HOME"}
SCHEMA = "dataset string, source_row long, symbol string, ts timestamp, open double, high double, low double, close double, tick_volume double, spread double, real_volume double, broker string"
START = dt.datetime(2024, 1, 2)


def rows(seed, n):
    rng, out, last = random.Random(seed), [], None
    for i in range(n):
        if last and rng.random() < 0.2:
            row = list(last)
        else:
            close = rng.choice([20.0, 20.0, 20.0, 20.5, 31.0, -1.0, None])
            low = close if close is not None else 1.0
            row = ["EVT" if rng.random() > 0.1 else "ALT", START + dt.timedelta(minutes=rng.choice([i, i, i, i - 2, i + 3]), seconds=rng.choice([0, 0, 0, 7])), low, low, low, close,
                   float(rng.randint(-1, 3)), float(rng.randint(-1, 40)), 0.0, rng.choice(["HOME", "HOME", "OTHER"])]
        out.append((rng.choice("AB"), i, *row))
        last = row
    return out


CASES = {"mixed": rows(1, 160), "copies": [("A", i, "EVT", START, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 0.0, "HOME") for i in range(50)], "none": []}


@pytest.mark.parametrize("case", CASES)
def test_certificate_equals_the_single_checks(spark, monkeypatch, case):
    calls, cut = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df: calls.append(df.columns) or cut(df))
    df, keys = spark.createDataFrame(CASES[case], SCHEMA), ["dataset"]
    certified = Q.certify(df, META, 1, keys)
    single = reduce(DataFrame.unionByName, [Q.row_findings(df, META, 1, keys), Q.duplicate_findings(df, keys), Q.conflict_findings(df, keys), Q.disorder_findings(df, keys),
                                            Q.series_findings(df, 1, keys)])
    found = sorted(map(tuple, Q.findings_of(certified, keys).collect()))
    assert found == sorted(map(tuple, single.collect()))
    assert certified.count() == len(CASES[case])
    assert calls == [["dataset", "source_row", "ts", "close"]]
    if case == "copies":
        assert certified.where("is_duplicate").count() == 49
    if case == "mixed":
        assert len({code for *_, code, _, _ in found}) >= 12
