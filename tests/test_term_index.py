"""The kept term index against a plain scan."""

import math
import random
from collections import Counter

import pytest

from corvane.operators import term_index
from corvane.operators.term_index import TermIndex


def plain(rows, terms, k, k1=1.5, b=0.75):
    held = [(i, Counter((t or "").split())) for i, t in rows if i is not None]
    n, avg = len(held), sum(sum(c.values()) for _, c in held) / len(held)
    score = Counter()
    for term in set(terms):
        df = sum(term in c for _, c in held)
        for i, c in held:
            if c[term]:
                score[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[term] * (k1 + 1) / (c[term] + k1 * (1 - b + b * sum(c.values()) / avg))
    return sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(1, 40)))) for i in range(600)] + [(900, None), (901, ""), (None, "w0 w1")]
    rows.append((902, "w59 " * 30 + "w50"))
    folder = str(tmp_path_factory.mktemp("terms") / "index")
    old, term_index.BLOCK = term_index.BLOCK, 25
    try:
        index = TermIndex(spark, folder)
        for part in (rows[:200], rows[200:]):
            index.add(spark.createDataFrame([(*r, "x", 1) for r in part], "doc_id long, text string, term string, block int"))
    finally:
        term_index.BLOCK = old
    return index, rows, folder


def test_search(spark, built):
    index, rows, folder = built
    for terms, k in ((["w0"], 5), (["w3", "w40", "w59", "w3"], 10), (["w59", "nothing"], 3), (["nothing"], 4), (["w1", "w2"], 1000)):
        assert [tuple(r) for r in TermIndex(spark, folder).search(terms, k).collect()] == plain(rows, terms, k)
    assert index.search([], 5).count() == 0
    assert index.read_share(["w59", "w50"], 1) < 0.5


def test_reads_only_its_buckets(built):
    rows, _, _ = built[0].postings(["w7"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in rows.inputFiles()}) > 1  # there are more, which the filter leaves out
    assert {r.bucket for r in rows.select("bucket").distinct().collect()} == {rows.first().bucket}


def test_half_written_parts_do_not_count(spark, built, tmp_path):
    folder = str(tmp_path / "index")
    one = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    index = TermIndex(spark, folder).add(one)
    index.add(spark.createDataFrame([(2, "alpha alpha")], "doc_id long, text string"), commit=False)  # as if its job had died
    assert [r.doc_id for r in index.search(["alpha"]).collect()] == [1]
    index.add(one.limit(0)).add(spark.createDataFrame([(3, "alpha")], "doc_id long, text string"))
    assert {r.doc_id for r in TermIndex(spark, folder).search(["alpha"]).collect()} == {1, 3}
