"""A library under a folder: commits, readers, repeats, postings after deletions."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, term_index
from corvane.plans.commits import Conflict, StoredLibrary
from tests.test_term_index import plain

ROW = "doc_id long, text string, name string, source string, title string, domain string"


def rows(spark, *given):
    return spark.createDataFrame([(i, text, name, f"/in/{name}", f"T {name}", domain) for i, text, name, domain in given], ROW)


def report(df):
    return sorted((r.key, r.status, r.doc_id) for r in df.collect())


@pytest.fixture
def library(spark, tmp_path):
    return StoredLibrary(spark, str(tmp_path / "library"), most=5, overlap=2)


def test_chunks_within_the_row_are_those_of_chunk_documents(spark):
    draw = random.Random(2)
    texts = ["", " \n\n ", "one", "a b c d e f g\n\nh i\n\n\nj k l m n o p q r s t"] + ["".join(draw.choices(["w ", "v\n", "\n\n", "x "], k=draw.randint(0, 90))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, overlap, least in ((5, 2, 1), (7, 0, 3), (3, 2, 3)):
        want = {tuple(r) for r in chunking.chunk_documents(docs, most, overlap, least).select("doc_id", "part", "word_offset", "text", "word_count").collect()}
        got = docs.select("doc_id", F.explode(chunking.chunk_array(F.col("text"), most, overlap, least)).alias("c")).select("doc_id", "c.*")
        assert {tuple(r) for r in got.collect()} == want


def test_import(spark, library):
    first = library.add(rows(spark, (7, "one two three four five six seven", "a.txt", "law"), (9, "ONE two  three four five six seven", "b.txt", None), (8, None, "c.txt", None), (5, "zeta", "d.txt", "auto")))
    assert report(first) == [(5, "added", 1), (7, "added", 2), (8, "empty", None), (9, "duplicate", 2)]
    again = library.add(rows(spark, (1, "Zeta", "e.txt", None), (2, "eta theta", "f.txt", None), (2, "eta theta", "f.txt", None)))
    assert report(again) == [(1, "duplicate", 1), (2, "added", 3), (2, "duplicate", 3)]
    now = library.snapshot()
    assert now.version == 2 and [r.domain for r in now.documents.orderBy("doc_id").collect()] == ["general", "law", "general"]
    chunks = [(r.chunk_id, r.doc_id, r.chunk_index, r.text) for r in now.chunks().orderBy("chunk_id").collect()]
    assert chunks == [(0, 1, 0, "zeta"), (1, 2, 0, "one two three four five"), (2, 2, 1, "four five six seven"), (3, 3, 0, "eta theta")]
    assert library.snapshot(1).documents.count() == 2
    assert report(library.add(rows(spark, (1, " ", "g", None)))) == [(1, "empty", None)] and library.snapshot().version == 2
    assert library.add(rows(spark, (1, "x", "g", None)).limit(0)).count() == 0


def test_change_and_delete(spark, library):
    library.add(rows(spark, (1, "alpha beta", "a", "law"), (2, "beta gamma", "b", "law"), (3, "gamma delta", "c", "law")))
    assert library.update(spark.createDataFrame([(1, " New ", None), (1, "Mew", ""), (2, None, "school"), (3, " ", None), (99, "x", "y")], "doc_id long, title string, domain string")) == 2
    old = library.snapshot()
    assert library.update(spark.createDataFrame([(1, "school")], "doc_id long, domain string")) == 1
    assert library.delete(spark.createDataFrame([(2,), (2,), (77,)], "doc_id long")) == 1
    assert library.delete(spark.createDataFrame([(2,)], "doc_id long")) == 0
    new = library.snapshot()
    assert [(r.doc_id, r.title, r.domain) for r in new.documents.orderBy("doc_id").collect()] == [(1, "New", "school"), (3, "T c", "law")]
    assert [(r.doc_id, r.title, r.domain) for r in old.documents.orderBy("doc_id").collect()] == [(1, "New", "law"), (2, "T b", "school"), (3, "T c", "law")]
    assert [(r.chunk_id, r.title, r.domain) for r in new.chunks().orderBy("chunk_id").collect()] == [(0, "New", "school"), (2, "T c", "law")]
    assert report(library.add(rows(spark, (4, "beta gamma", "d", "law")))) == [(4, "added", 4)]  # gone, so new again; its ids are not used again
    assert library.snapshot().documents.where("doc_id = 4").first().first_chunk == 3


def test_replace_same_name(spark, library):
    library.add(rows(spark, (1, "alpha", "A.txt", "law"), (2, "beta", "b.txt", "law"), (3, "gamma", "c.txt", "law")))
    got = library.add(rows(spark, (1, "ALPHA", "a.TXT", "law"), (2, "beta", "b.txt", "law"), (3, "gamma", "x.txt", "law"), (4, "delta", "c.txt", "law"), (5, "", "b.txt", "law")), replace_same_name=True)
    assert report(got) == [(1, "added", 4), (2, "duplicate", 2), (3, "duplicate", 3), (4, "added", 5), (5, "empty", None)]
    assert sorted((r.doc_id, r.text) for r in library.snapshot().documents.collect()) == [(2, "beta"), (3, "gamma"), (4, "ALPHA"), (5, "delta")]
    assert [r.doc_id for r in library.snapshot().search("alpha").collect()] == [4]


def test_a_writer_that_dies_or_comes_second_changes_nothing(spark, library, monkeypatch):
    library.add(rows(spark, (1, "alpha", "a", "law")))

    def died(*_, **__):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(StoredLibrary, "_commit", died)
        with pytest.raises(OSError):
            library.add(rows(spark, (2, "alpha beta", "b", "law")))
    assert library.snapshot().version == 1 and [r.doc_id for r in library.snapshot().search("alpha beta").collect()] == [1]
    seen = library.snapshot()
    assert report(library.add(rows(spark, (2, "alpha beta", "b", "law")))) == [(2, "added", 2)]
    with pytest.raises(Conflict):
        library._commit(seen, "late", removed=1)
    assert library.snapshot().version == 2 and library.snapshot().documents.count() == 2
    with pytest.raises(ValueError):
        StoredLibrary(spark, library.folder, most=6, overlap=2).snapshot()


def test_search_is_that_of_what_is_left(spark, library, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 8)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    texts = list(dict.fromkeys(" ".join(draw.choices(words, [1 / (j + 1) for j in range(25)], k=draw.randint(2, 12))) for _ in range(90)))
    given = [(i, t, f"n{i}", "law" if i % 3 else "school") for i, t in enumerate(texts)]
    library.add(rows(spark, *given[:50]))
    library.add(rows(spark, *given[50:]))
    library.delete(library.snapshot().documents.where("doc_id % 4 = 1").select("doc_id"))

    def agrees(*asked):
        now = library.snapshot()
        chunks = {r.chunk_id: r for r in now.chunks().collect()}
        for question, k in asked:
            want = plain([(i, c.text) for i, c in chunks.items()], question.split(), 500)
            got = now.search(question, k).collect()
            assert [(r.chunk_id, r.score) for r in got] == want[:k]
            assert all(r.text == chunks[r.chunk_id].text for r in got)
            of_school = [w for w in want if chunks[w[0]].domain == "school"][:k]
            assert [(r.chunk_id, r.score) for r in now.search(question, k, F.col("domain") == "school").collect()] == of_school
        return chunks

    before = agrees(("w0 w3", 5), ("w20 w21 w7", 500))
    library.compact()
    assert {i: c.text for i, c in agrees(("w24 w1", 4)).items()} == {i: c.text for i, c in before.items()}
    library.delete(library.snapshot().documents.select("doc_id"))
    assert library.snapshot().search("w0").count() == 0 and library.snapshot().chunks().count() == 0
    library.add(rows(spark, (1, "w0", "n", "law")))
    found = library.snapshot().search("w0").collect()
    assert len(found) == 1 and found[0].chunk_id > max(before)


def test_chunks_are_counted_without_being_built(spark, tmp_path):
    texts = ["", " ", "\n\n", "one", "a b c\n\nd e", "　x y \n \n z q", " ".join(map(str, range(97))), "\n\n".join(" ".join("w" * k) for k in range(30)), "p\n \n\n" * 40, "tail \n\n ", "\x1cx\x1c\n\n\x85y"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(150).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, overlap, least in ((220, 40, 1), (5, 2, 1), (7, 0, 4), (10, 9, 3), (3, 1, 8), (1, 0, 1)):
        rows = df.select("text", F.size(chunking.chunk_array(F.col("text"), most, overlap, least)).alias("n"), chunking.chunk_count(F.col("text"), most, overlap, least).alias("m")).collect()
        assert [r for r in rows if r.n != r.m] == []
    plan = StoredLibrary(spark, str(tmp_path), indexed=False)._rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "slice(" not in plan
