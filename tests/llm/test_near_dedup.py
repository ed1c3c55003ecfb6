"""Near duplicates against brute force."""

import random
import re

import pytest

from corvane.llm import near_dedup
from corvane.llm.near_dedup import aligned_similarity, classes, keep_one


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(rows):
    """Class of each id: connected by equal texts or an alignment of 0.8 or more."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    parts = {d: shingles(t) for d, t in rows}
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            x, y = parts[a], parts[b]
            alike = (s or "") == (t or "")
            if not alike and x and y and len(set(x) & set(y)) > 0.6 * max(len(set(x)), len(set(y))):
                n = lcs(x, y)
                alike = n / (len(x) + len(y) - n) >= 0.8
            if alike:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def corpus():
    r, out = random.Random(3), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    for i in range(40):
        base = [word() for _ in range(r.choice([6, 40, 120, 300]))]
        out.append((i * 10, " ".join(base)))
        for j in range(r.randint(0, 5)):
            changed = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                changed[r.randrange(len(changed))] = word()
            out.append((i * 10 + j + 1, " ".join(changed) if r.random() < 0.8 else " ".join(base)))
    family = [word() for _ in range(200)]
    for j in range(60):  # a large group of different near copies
        out.append((5000 + j, " ".join(w if r.random() > 0.006 else word() for w in family)))
    return out + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "one two"), (9005, "one  two"), (9006, "z " * 3000)]


@pytest.mark.parametrize("small", [24, 2])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = corpus()
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(2, text, "x"), (1, text + " tail", "y"), (3, "other", "z"), (3, "other", "z"), (None, None, None), (4, "", "q")]
    got = sorted(((r.doc_id, r.k) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()), key=str)
    assert got == [(1, "y"), (3, "z"), (None, None)]
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.05]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randrange(12))
        n = lcs(a, b)
        s = n / (len(a) + len(b) - n) if b else 0
        assert aligned_similarity(a, b, 0.8) == (pytest.approx(s) if s >= 0.8 else 0)


def test_long_sequences_align_quickly():
    r = random.Random(8)
    a = [r.randrange(10**9) for _ in range(200_000)]
    b = a[:50_000] + [r.randrange(10**9) for _ in range(300)] + a[50_100:150_000] + a[150_500:]
    n = 200_000 - 600
    assert aligned_similarity(a, b, 0.8) == pytest.approx(n / (len(a) + len(b) - n))
    assert aligned_similarity(a, a[100_000:] + a[:100_000], 0.8) == 0  # same elements, other order


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    from corvane.llm.decontaminate import drop_leaking
    from corvane.llm.mixing import copies, mix_sources
    from corvane.llm.suffix_dedup import clean_documents

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text, "a"), (3, "other words altogether", None), (None, None, "b"), (4, "", "b"), (4, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["k", "K_", "sub", "told", "null", "copy", "_COPY", "its", "rate", "n", "said", "rest"]
    df = df.select("*", *[F.lit(7).alias(c) for c in names])
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    for out, n in ((keep_one(df), 3), (drop_leaking(df, bench), 4), (clean_documents(df), 5)):
        got = out.collect()
        assert out.columns == df.columns and len(got) == n and all(r[c] == 7 for r in got for c in names)
    mixed = mix_sources(df)
    got, want = mixed.collect(), sum(r.copies for r in copies(df).collect())
    assert mixed.columns == [*df.columns, "__copy"] and len(got) == want and all(r[c] == 7 for r in got for c in names)
    for f in (keep_one, clean_documents, mix_sources, lambda d: drop_leaking(d, bench)):
        assert f(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "w " * 9, "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    by = {}
    for r in mix_sources(many).collect():
        by.setdefault(r.doc_id, []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values()) and any(len(c) == 2 for c in by.values())
