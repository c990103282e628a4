"""The ancestor closure where many ways lead to the same ancestors: the same pairs and depths, and joins that stay in proportion to the pairs."""

import random

import pytest

from barwright.operators import scope as A
from test_closure import CASES, closure, plain


@pytest.mark.parametrize("limit, spread", [(6, 0), (6, 1), (32, 0)])
def test_short_steps_equal_plain_walking(spark, monkeypatch, limit, spread):
    monkeypatch.setattr(A, "SPREAD", spread)
    nodes = [f"{case}:{name}" for case, (names, _) in CASES.items() for name in names]
    edges = [(f"{case}:{a}", f"{case}:{b}") for case, (_, pairs) in CASES.items() for a, b in pairs]
    assert closure(spark, nodes, edges, limit) == plain(nodes, edges, limit)


def supplier_like(count):
    edges = set()
    for k in range(count):
        edges |= {(f"{k}", f"{p}") for p in [k // 2] * (k > 1) + [k // 3] * (k > 2) + [k - 1] * (51 <= k % 100 <= 95) + [k] * (k % 100 == 97) + [2 * k] * (k % 100 == 48)}
        edges |= {(f"{k}", f"missing-{k}")} if k % 100 == 49 else set()
    return [f"{k}" for k in range(count)], sorted(edges)


def test_ways_are_not_joined_to_all_they_reach(spark, monkeypatch):
    """Rows of every join of ways: a small multiple of the pairs, although a certificate has many ways to each of its ancestors."""
    nodes, edges = supplier_like(400)
    joined, onward = [], A._onward
    monkeypatch.setattr(A, "_onward", lambda *a: joined.append(onward(*a).count()) or onward(*a))
    found = closure(spark, nodes, edges, 32)
    assert found == plain(nodes, edges, 32) and sum(joined) < 4 * len(found)
