"""The kept vector index against a plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def plain(rows, q, k, keep=lambda label: True, wide=8):
    each = sorted(((-(round(sum(float(np.float32(a)) * float(b) for a, b in zip(v, q, strict=True)), 4)), i, label) for i, v, label, _ in rows))[: wide * k]
    return [(i, label, -s + 0.0) for s, i, label in each if keep(label)][:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(12, 8)) * 4
    x = np.vstack([m + draw.normal(size=(60, 8)) * 0.2 for m in middles] + [np.zeros((5, 8)), np.tile(middles[0], (7, 1))])
    rows = [(i, [float(np.float32(a)) for a in v], i % 3, 7) for i, v in enumerate(x)]
    folder = str(tmp_path_factory.mktemp("vectors") / "index")
    index = VectorIndex(spark, folder, sample=500)
    bad = [(None, rows[0][1], 1, 7), (2000, None, 1, 7), (2001, [float("nan")] + [1.0] * 7, 1, 7), (2002, [None] + [1.0] * 7, 1, 7)]
    for part in (rows[:400] + bad, rows[400:]):
        index.add(spark.createDataFrame(part, SCHEMA))
    return index, rows, middles


def test_search_is_that_of_a_scan(spark, built):
    index, rows, middles = built
    for q, k in ((list(middles[0]), 3), (list(-middles[5]), 10), ([0.0] * 8, 4), (list(middles[3] + middles[4]), 200)):
        got = index.search([float(a) for a in q], k).collect()
        assert [(r.vec_id, r.label, r.score) for r in got] == plain(rows, q, k)
    got = VectorIndex(spark, index.folder).search([float(a) for a in middles[1]], 5, F.col("label") == 1).collect()
    assert [(r.vec_id, r.label, r.score) for r in got] == plain(rows, list(middles[1]), 5, lambda label: label == 1)


def test_far_clusters_are_not_read(built):
    index, rows, middles = built
    q = [float(a) for a in middles[2]]
    assert index.read_share(q, 3) < 0.35
    chosen, each, _ = index._plan(q, 24)
    files = index._read(chosen)
    assert {r.c for r in files.select(F.col("vector_cluster").alias("c")).distinct().collect()} == {c[1] for c in chosen} < {c[1] for c in each}
    assert "vector_cluster" in files._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert sum(c[2] for c in each) == len(rows)


def test_uncommitted_empty_and_wrong_lengths(spark, tmp_path):
    one = spark.createDataFrame([(1, [1.0, 0.0], 1, 1)], SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.add(one.limit(0)).search([1.0, 0.0]).count() == 0
    index.add(one).add(one.limit(0))
    index.add(spark.createDataFrame([(2, [2.0, 0.0], 1, 1)], SCHEMA), commit=False)  # as if its job had died
    assert [(r.vec_id, r.score) for r in index.search([1.0, 1.0]).collect()] == [(1, 1.0)]
    index.add(spark.createDataFrame([(1, [1.0, 0.0], 5, 1), (3, [5.0, 5.0], 1, 1)], SCHEMA))  # repeated rows stay
    assert [(r.vec_id, r.score) for r in index.search([1.0, 1.0]).collect()] == [(3, 10.0), (1, 1.0), (1, 1.0)]
    with pytest.raises(ValueError):
        index.search([1.0])
    with pytest.raises(ValueError):
        index.add(one.withColumn("Vector_Away", F.lit(1)))
    with pytest.raises(Exception, match="have 2 elements"):
        index.add(spark.createDataFrame([(4, [1.0, 2.0, 3.0], 1, 1)], SCHEMA))
