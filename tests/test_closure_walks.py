"""The ancestor closure where tasks hold the edges, and the same by joins where there are too many of them."""

import pytest

from barwright.operators import scope as A
from test_closure import CASES, closure, plain
from test_closure_dense import supplier_like


def test_no_pair_is_joined_or_shuffled(spark):
    """Only certificates are dealt out: the plan has no join, and pairs come out of the tasks that walk."""
    nodes, edges = supplier_like(300)
    n, e = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "child string, parent string")
    plan = A.ancestor_closure(n, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.lstrip().startswith("MapInArrow")


@pytest.mark.parametrize("limit, held, spread", [(6, 10, None), (6, None, None), (32, None, None), (6, 0, None), (6, 0, 1)])
def test_walks_equal_plain_walking(spark, monkeypatch, limit, held, spread):
    """held: few pairs at a time, or with 0 no edges in tasks, so joins; spread: short steps in the joins."""
    if held == 0:
        monkeypatch.setattr(A, "EDGES_HELD", 0)
    elif held:
        monkeypatch.setattr(A, "PAIRS_HELD", held)
    if spread:
        monkeypatch.setattr(A, "SPREAD", spread)
    nodes = [f"{case}:{name}" for case, (names, _) in CASES.items() for name in names]
    edges = [(f"{case}:{a}", f"{case}:{b}") for case, (_, pairs) in CASES.items() for a, b in pairs] + [("stray", "self:a"), ("stray", "stray2"), ("ringed", "ringed")]
    assert closure(spark, nodes, edges, limit) == plain(nodes, edges, limit)
