"""Fingerprints against exact Jaccard similarity, and the order of documents."""

import hashlib
import re

from corvane.llm.fingerprints import fingerprints_with_edits


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_exact(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    top = max(r[0] for r in rows)
    rows += [(top + 1, None), (top + 2, ""), (top + 3, "one two"), (top + 4, "one two"), (top + 5, "日本 é " * 30), (None, rows[0][1])]
    got = {r.doc_id: r for r in fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    errors = []
    for i, (doc_id, text) in enumerate(rows):
        text, nxt, r = text or "", rows[(i + 1) % len(rows)][1] or "", got[doc_id]
        half = len(text) // 2
        changed = text[: len(text) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        errors += [abs(r.near_edited - jaccard(text, changed)), abs(r.near_next - jaccard(text, nxt))]
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.16
    assert got[None].fingerprint == got[0].fingerprint and got[None].near_next == 1
    assert got[top + 1].fingerprint == "" and got[top + 3].near_next == 1


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", "x")], "doc_id long, text string, k string")
    (r,) = fingerprints_with_edits(df).collect()
    assert r.near_next == 1 and r.n_chars == 13
    assert fingerprints_with_edits(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "z"), (6, "a b c d e f g")], "doc_id long, text string")
    got = fingerprints_with_edits(df).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 5, 6] and sum(r.near_next for r in got) == 2  # the last is followed by the first


def test_ids_that_fill_blocks(spark):
    """Null and 7 are the ids of most rows: they are dealt to several blocks, in the order of their texts' hashes."""
    from pyspark.sql import functions as F

    rows = [(None, f"none {i} " * (i % 5)) for i in range(150)] + [(7, f"seven {i * i} words") for i in range(150)] + [(i, f"own {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = []
    for i, (doc_id, text) in enumerate(order):
        half, following = len(text) // 2, order[(i + 1) % len(order)][1]
        want.append((doc_id, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in fingerprints_with_edits(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_below(spark):
    from pyspark.sql import functions as F

    from corvane.llm.fingerprints import below

    for cuts in ([], [5], [-3, 0, 4, 9, 100], list(range(0, 74, 3))):
        got = spark.range(-6, 110).select("id", below(cuts, F.col("id")).alias("n")).collect()
        assert [r.n for r in got] == [sum(c < r.id for c in cuts) for r in got]
