"""Near-duplicate vectors and documents against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import caps, cells, components, jaccard


def groups_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160)) and found[300] == found[301] == 300
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("size", [3, 1000])
def test_cells_meet_every_pair_once(spark, size):
    rows = [(b, 10 * b + i) for b, n in ((1, 12), (2, 2), (3, 1)) for i in range(n)]
    dealt = cells.deal(spark.createDataFrame(rows, "bucket bigint, number bigint"), "bucket", "number", size, 3).toPandas()
    met = []
    for (bucket, low, high), cell in dealt.groupby(["bucket", "low", "high"]):
        cell = cell.reset_index(drop=True)
        low_, high_, part = (cell[c].to_numpy() for c in ("low", "high", "part"))
        for a, b in cells.pairs_of(np.array([0]), len(cell), low_, high_, part):
            met += [tuple(sorted((int(cell.number[i]), int(cell.number[j])))) for i, j in zip(a, b)]
    want = [p for b, n in ((1, 12), (2, 2)) for p in itertools.combinations(range(10 * b, 10 * b + n), 2)]
    assert sorted(met) == sorted(want)


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=32) for _ in range(150)]
    for centre in range(12):
        rows += [rows[centre] + rng.normal(scale=s, size=32) for s in (0.05, 0.2, 0.45, 0.5)]
    rows += [rows[0], rows[0] * 3, rows[1]]
    return [[float(v) for v in row] for row in rows]


def brute_vectors(rows, threshold=0.9):
    def usable(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if usable(rows[i]) and usable(rows[j]) and len(rows[i]) == len(rows[j])
             and np.dot(rows[i], rows[j]) / np.linalg.norm(rows[i]) / np.linalg.norm(rows[j]) >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, groups_of(len(rows), links)


def test_vectors_against_brute_force(spark):
    rows = vectors() + [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0], [1.0, 2.1]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, number string")
    got = {r["vec_id"]: r for r in caps.near_vectors(df).collect()}
    count, group = brute_vectors(rows)
    assert len(got) == len(rows)
    assert sum(got[i]["n_links"] for i in range(len(rows))) >= 0.98 * sum(count) and all(got[i]["n_links"] <= count[i] for i in range(len(rows)))
    same = [i for i in range(len(rows)) if got[i]["component_id"] == group[i]]
    assert len(same) >= 0.98 * len(rows) and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))
    assert all(got[i]["n_links"] == 0 for i in range(len(vectors()), len(rows) - 2)) and got[len(rows) - 1]["component_id"] == len(rows) - 2


def test_vectors_hot_group_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(caps, "PART", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [[float(x) for x in centre + rng.normal(scale=0.02, size=16)] for _ in range(90)] + [[float(x) for x in centre]] * 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)] + [(None, rows[0])], "vec_id bigint, embedding array<double>")
    got = caps.near_vectors(df).collect()
    assert {r["n_links"] for r in got} == {110} and {r["component_id"] for r in got} == {0} and len(got) == 111
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_every_exceeding_direction_is_decoded():
    code = caps.code_for(12, 300)
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ code.rotation
    parts = [turned[:, a:b] @ w for a, b, w in zip(code.cuts, code.cuts[1:], code.words)]
    total = parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]
    want = {(r, (a * parts[1].shape[1] + b) * parts[2].shape[1] + c) for r, a, b, c in zip(*np.nonzero(total >= code.bound))}
    row, number = caps.exceeding(parts, code.bound)
    assert {*zip(row.tolist(), number.tolist())} == want and len(row) == len(want)
    row, number = caps.decode(unit, code)
    assert want <= {*zip(row.tolist(), number.tolist())} and np.bincount(row, minlength=20).min() >= caps.LEAST


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(8, 200))]
        out.append(" ".join(base))
        for changes in (1, 2, 4):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(base[:5] + passage + base[5:20]))
    return out + [out[0], out[0].upper(), None, "", "?! ...", "one", "one", "one two", "one two three four", "ünï cödé wörds älso cöunt tö"] + ["long " * 3000, "long " * 3001]


def sets_of(rows):
    import re
    out = []
    for text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        out.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def brute_texts(rows):
    sets = sets_of(rows)
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, groups_of(len(rows), links)


@pytest.mark.parametrize("filtered", [0, 500_000])
def test_documents_against_brute_force(spark, monkeypatch, filtered):
    monkeypatch.setattr(jaccard, "FILTERED", filtered)
    monkeypatch.setattr(jaccard, "GROUP_PART", 2)
    monkeypatch.setattr(jaccard, "BUCKET_PART", 2)
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(rows)], "doc_id bigint, text string, number int, set_key string")
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df).collect()}
    count, group = brute_texts(rows)
    assert [got[i]["n_links"] for i in range(len(rows))] == count and [got[i]["component_id"] for i in range(len(rows))] == group
    assert all(got[i]["kept"] == (group[i] == i) for i in range(len(rows)))
    stay = jaccard.distinct_documents(df)
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(group)) and stay.columns == df.columns


def test_documents_repeated_rows_null_keys_and_empty(spark):
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (3, "another text of six words here"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [("3", 0, "3", True), ("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "3", False)]
    assert jaccard.distinct_documents(df).count() == 3
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_PART", 32)
    monkeypatch.setattr(jaccard, "BUCKET_PART", 32)
    base = [f"w{i}" for i in range(80)]
    rows = [" ".join(base[:70] + [f"end{i}"]) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    got = jaccard.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component_id"] for r in got} == {0}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    rule = jaccard.least_matches()
    equal = rng.random((20_000, jaccard.VALUES)) < 0.8
    lost = sum((equal[:, :n].sum(axis=1) < m).astype(int) for n, m in rule) > 0
    assert lost.mean() < 1e-3 and rule == sorted(rule)
    rare = rng.random((20_000, jaccard.VALUES)) < 0.3
    assert np.mean([(rare[:, :n].sum(axis=1) >= m).all() for n, m in rule[-1:]]) == 0
