"""What ancestors merge to, without the closure: the same status and scope as by plain walking."""

from pyspark.sql import functions as F

from barwright.operators import scope as A
from test_closure import CASES, plain

LIMIT = 4


def test_folds_equal_plain_walking(spark, monkeypatch):
    names = [f"{case}:{name}" for case, (nodes, _) in CASES.items() for name in nodes]
    links = [(f"{case}:{a}", f"{case}:{b}") for case, (_, pairs) in CASES.items() for a, b in pairs]
    own = {n: ([x for j, x in enumerate("abcd") if (i * 7 + j) % 4], i % 5 == 0, i * 37 % 101) for i, n in enumerate(names)}
    nodes = spark.createDataFrame([(n, *facts) for n, facts in own.items()], "id string, capabilities array<string>, revoked boolean, valid_to int")
    closed = []
    monkeypatch.setattr(A, "_longest", lambda ways: closed.append(1))
    merges = {"capabilities": F.array_sort(A.common("capabilities")), "revoked": F.max("revoked"), "valid_to": F.min("valid_to")}
    found = {r["id"]: r for r in A.folded(nodes, spark.createDataFrame(links, "child string, parent string"), merges, LIMIT).collect()}
    ways, above = plain(names, links, LIMIT), {}
    for (start, ancestor), depth in ways.items():
        above.setdefault(start, {})[ancestor] = depth
    assert found.keys() == above.keys() and len({r["graph_status"] for r in found.values()}) == 3 and not closed
    for name, reached in above.items():
        status = "UNKNOWN_CERTIFICATE" if any(a not in own for a in reached) else "INVALID_PARENT_GRAPH" if max(reached.values()) >= LIMIT else "OK"
        assert found[name]["graph_status"] == status
        if status == "OK":
            facts = [own[a] for a in reached]
            assert found[name]["capabilities"] == sorted(set.intersection(*(set(f[0]) for f in facts)))
            assert (found[name]["revoked"], found[name]["valid_to"]) == (any(f[1] for f in facts), min(f[2] for f in facts))
