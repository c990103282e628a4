"""The ancestor closure against plain walking: chains, cycles, short cuts beside long chains, random graphs, and how often it joins."""

import random

import pytest

from barwright.operators import scope as A


def plain(nodes, edges, limit):
    """Longest walk of at most `limit` steps per pair, and the limit where a walk is longer."""
    out = {}
    parents = {}
    for child, parent in edges:
        parents.setdefault(child, set()).add(parent)
    for start in set(nodes) | {child for child, _ in edges}:
        seen, at, depth = {}, {start}, 0
        if start in nodes:
            seen[start] = 0
        history = set()
        while at and (frozenset(at), min(depth, limit)) not in history:
            history.add((frozenset(at), min(depth, limit)))
            at, depth = {p for a in at for p in parents.get(a, ())}, depth + 1
            for a in at:
                seen[a] = max(seen.get(a, 0), min(depth, limit))
        out.update({(start, a): d for a, d in seen.items()})
    return out


def closure(spark, nodes, edges, limit):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "child string, parent string")
    return {(r["id"], r["ancestor"]): r["depth"] for r in A.ancestor_closure(n, e, limit).collect()}


def graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    return nodes, [(rng.choice(nodes), rng.choice([*nodes, "missing"])) for _ in range(rng.randint(5, 22))]


SHORTCUT = ([f"c{i}" for i in range(30)], [(f"c{i}", f"c{i + 1}") for i in range(29)] + [("c0", "c20"), ("c0", "c29"), ("c5", "c28")])
CASES = {"alone": (["a"], []), "self": (["a", "b"], [("a", "a"), ("a", "b")]), "ring": (["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]),
         "repeated": (["a", "b"], [("a", "b"), ("a", "b")]), "shortcut": SHORTCUT} | {f"random{i}": graph(i) for i in range(12)}


@pytest.mark.parametrize("limit", [4, 6])
def test_closure_equals_plain_walking(spark, limit):
    """All cases as parts of one graph, each under its own names."""
    nodes = [f"{case}:{name}" for case, (names, _) in CASES.items() for name in names]
    edges = [(f"{case}:{a}", f"{case}:{b}") for case, (_, pairs) in CASES.items() for a, b in pairs]
    assert closure(spark, nodes, edges, limit) == plain(nodes, edges, limit)


def test_closure_of_nothing(spark):
    assert closure(spark, [], [], 4) == {}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 1,000 certificates: ten doublings; the rest are the start and the steps that deal with the limit."""
    calls, cut = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: calls.append(1) or cut(df))
    chain = spark.range(1001).selectExpr("id")
    links = spark.range(1000).selectExpr("id AS child", "id + 1 AS parent")
    got = A.ancestor_closure(chain, links, 32)
    assert got.count() == 1001 * 1002 // 2
    assert got.where("depth <> least(32, ancestor - id)").isEmpty()
    assert len(calls) <= 20
