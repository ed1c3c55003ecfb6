"""Batch search exchanges no postings and counts null texts, whether queries are sent to the tasks or not."""

import pytest

from corvane.operators import search


@pytest.mark.parametrize("few", [500_000, 0])
def test_f10_batch_search(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    docs = spark.createDataFrame([(1, "cat sat cat"), (2, "dog sat"), (3, None), (4, ""), (5, "a bird")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, "sat dog dog"), (3, "fish"), (4, None)], "item_id long, text string")
    got = search.bm25_batch(docs, queries, 2)
    assert few == 0 or got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 3  # texts, each task's best, the counts' join
    one = [tuple(r) for r in search.bm25(docs.where("doc_id <> 3"), ["cat"]).select("doc_id").collect()]
    rows = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()}
    assert set(rows) == {(1, 1), (2, 1), (2, 2)} and one == [(1,)] and rows[1, 1][0] == 1 and rows[2, 1][0] == 2
    n, avg = 5, (3 + 2 + 0 + 2) / 4  # the null text is a document without a length
    import math

    assert rows[1, 1][1] == pytest.approx(math.log(1 + (n - 0.5) / 1.5) * (2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))), abs=1e-6)
