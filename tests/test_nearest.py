"""Pruned nearest-neighbour search against comparing everything with everything."""

import numpy as np
import pytest

from barwright.operators import retrieval


def plain(rows, asked, k):
    ids, x = np.array([i for i, v in rows if v is not None]), np.array([v for _, v in rows if v is not None], dtype=float)
    spans = x.max(axis=0) - x.min(axis=0)
    spans = np.where(spans > 0, spans, 1.0)
    out = {}
    for q, v in asked:
        distance = (np.abs(x - np.array(v)) / spans).mean(axis=1)
        best = np.lexsort((ids, distance))[:k]
        out.update({(q, int(rank + 1)): (int(ids[j]), round(float(distance[j]), 9)) for rank, j in enumerate(best)})
    return out


def clustered(seed=3, clusters=12, each=60, size=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size)) * 10
    x = (centres[:, None, :] + rng.normal(size=(clusters, each, size)) * 0.2).reshape(-1, size)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    # Repeated vectors are ties; a constant position has no span; one row has no vector.
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    return [(i, [*v, 1.0]) for i, v in rows] + [(2000, None)]


@pytest.mark.parametrize("sizes", [{}, {"rows_per_cell": 16, "queries_per_cell": 3, "pivots": 5, "rings": 4}])
def test_pruned_search_is_exact(spark, sizes):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = [row for row in rows if row[0] % 37 == 0 or row[0] == 1003]
    asked_df = spark.createDataFrame(asked, "vec_id bigint, embedding array<double>")
    got = retrieval.nearest_vectors_of(df, asked_df, "embedding", "vec_id", 10, **sizes).collect()
    assert {(r["query"], r["rank"]): (r["vec_id"], round(r["distance"], 9)) for r in got} == plain(rows, asked, 10) and len(got) == 10 * len(asked)
    assert 0 < retrieval.compared_share(df, asked_df, "embedding", "vec_id", 10, **sizes) < 0.6


def test_pruned_search_with_fewer_rows_than_asked_for(spark):
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, None)], schema)
    got = retrieval.nearest_vectors_of(df, df, "embedding", "vec_id", 5).orderBy("query", "rank").collect()
    assert [(r["query"], r["vec_id"], r["distance"], r["rank"]) for r in got] == [(1, 1, 0.0, 1), (1, 2, 0.5, 2), (2, 2, 0.0, 1), (2, 1, 0.5, 2)]
    assert retrieval.nearest_vectors_of(df.limit(0), df, "embedding", "vec_id", 5).count() == 0
    assert retrieval.nearest_vectors_of(df, df.limit(0), "embedding", "vec_id", 5).count() == 0
