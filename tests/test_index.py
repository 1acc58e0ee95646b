"""The stored vector index against exact search over all vectors."""

import numpy as np
import pytest

from passwatch.operators import index, retrieve
from passwatch.sources import versioned

VECTORS = "id long, embedding array<double>"
QUERIES = "q_id long, q_embedding array<double>"


def clusters(n, seed=3, dim=12):
    r = np.random.default_rng(seed)
    base = r.standard_normal((8, dim))
    v = base[r.integers(0, 8, n)] + 0.15 * r.standard_normal((n, dim))
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_exact_search(spark, tmp_path, k):
    """With ties, repeated, zero and null vectors; and with fewer vectors than k in the first cells."""
    rows = clusters(400)
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, [0.0] * 12), (1003, None), (1004, [])]
    v = spark.createDataFrame(rows, VECTORS)
    q = spark.createDataFrame([(i, e) for i, e in rows[:40]] + [(2000, [0.0] * 12), (2001, [1.0] + [0.0] * 11), (2002, None)], QUERIES)
    path = f"file://{tmp_path}/index"
    assert index.load_or_build(v, path)
    found, looked = index.search(q, path, k, -1.0)
    want = retrieve.retrieve_topk(q.where("q_embedding is not null"), v.where("size(embedding) > 0"), k, -1.0)
    rows_of = lambda d: sorted((r.q_id, r["rank"], r.id, r.score) for r in d.collect())
    assert rows_of(found) == rows_of(want)
    into = looked.collect()
    assert all(r.looked_into <= r.cells for r in into)
    if k < 50:
        assert sum(r.looked_into for r in into) < 0.7 * sum(r.cells for r in into)  # cells are left out


def test_load_and_rebuild(spark, tmp_path):
    path, v = f"file://{tmp_path}/index", spark.createDataFrame(clusters(60), VECTORS)
    assert index.load_or_build(v, path)  # absent
    assert not index.load_or_build(v, path)
    assert index.load_or_build(v, path, force=True)
    assert index.load_or_build(v, path, "another backend")
    assert index.load_or_build(v.where("id < 50"), path, "another backend")  # other vectors
    assert versioned.read(spark, path, "vectors").count() == 50
    assert versioned.manifest(spark, path)["version"] == 4
    with pytest.raises(ValueError):
        index.load_or_build(v.unionByName(spark.createDataFrame([(99, [1.0])], VECTORS)), path)
    empty = f"file://{tmp_path}/empty"
    assert index.load_or_build(v.limit(0), empty) and not index.load_or_build(v.limit(0), empty)
    found, _ = index.search(spark.createDataFrame([(1, [1.0, 2.0])], QUERIES), empty)
    assert found.count() == 0
