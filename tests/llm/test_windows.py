"""Byte and word deduplication against brute force."""

import hashlib
import re

import pytest

from corvane.llm import windows
from corvane.llm.substring_dedup import remove_substrings
from corvane.llm.suffix_dedup import clean_documents, remove_repeats, suffixes

SCHEMA = "doc_id long, text string, run long"


def brute_bytes(rows, t):
    """rows: (doc_id, text), distinct ids; in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - t + 1):
            w = b[p : p + t]
            if w in seen:
                gone[p : p + t] = [True] * t
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc_id] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, t):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone, own = [False] * len(w), []
        for p in range(len(w) - t + 1):
            x = tuple(w[p : p + t])
            own.append(x)
            if x in seen:
                gone[p : p + t] = [True] * t
        seen.update(own)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(spark, sf="0.001"):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    top = max(r[0] for r in rows)
    base = rows[3][1]
    more = [None, "", "ab", "ab " * 400, "Orre " * 900, base, base.upper(), base[:300] + " new words here " + base[300:], "é" * 260, "日本語" * 90 + base[50:400], base.replace(" ", "\n", 7)]
    return rows + [(top + 1 + i, t) for i, t in enumerate(more)] + [(None, base[:500])]


@pytest.mark.parametrize(("hot", "wide"), [(2000, 500), (2, 500), (0, 1)])
def test_bytes(spark, monkeypatch, hot, wide):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "WIDE", wide)
    rows = corpus(spark)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize(("hot", "wide"), [(2000, 500), (2, 500), (0, 1)])
def test_words(spark, monkeypatch, hot, wide):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "WIDE", wide)
    rows = corpus(spark)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_substrings(df).collect()}
    assert got == brute_words(rows, 50)


def repeating(spark):
    """A long passage in several texts, by itself and with others around it, and texts of few different words."""
    rows = corpus(spark)[:60]
    passage = " ".join(f"w{i * i % 7919}" for i in range(700))
    more = [passage, "before " + passage + " after", passage[30:2900], passage + " " + passage, "ab " * 1500, "ab " * 1400 + "c", "x" * 3000, "x" * 2500 + "y" + "x" * 1200]
    return rows + [(10_000 + i, t) for i, t in enumerate(more)]


@pytest.mark.parametrize(("hot", "wide"), [(500, 500), (0, 1)])
@pytest.mark.parametrize("threshold", [1, 5, 40, 256, 340, 400, 1000])
def test_byte_thresholds(spark, monkeypatch, threshold, hot, wide):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "WIDE", wide)
    rows = repeating(spark) if threshold >= 40 else corpus(spark)[-12:]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, threshold).collect()}
    assert got == brute_bytes(rows, threshold)


@pytest.mark.parametrize(("hot", "wide"), [(500, 500), (0, 1)])
@pytest.mark.parametrize("window", [1, 12, 320, 400])
def test_word_windows(spark, monkeypatch, window, hot, wide):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "WIDE", wide)
    rows = repeating(spark)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_substrings(df, window).collect()}
    assert got == brute_words(rows, window)


def test_too_long_windows(spark):
    with pytest.raises(ValueError):
        suffixes(1 << 20)


def test_texts_of_megabytes(spark):
    """Two texts of 3 MB that share their second half, beside a short one that ends like both."""
    word = lambda salt, i: hashlib.md5(f"{salt}{i}".encode()).hexdigest()[: 3 + i % 6]
    half = " ".join(word("b", i) for i in range(220_000))
    rows = [(i, " ".join(word(i, j) for j in range(220_000)) + " " + half) for i in (1, 2)] + [(3, half[-5000:])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    by_bytes = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    by_words = {r.doc_id: r.n_removed for r in remove_substrings(df).collect()}
    n = len(rows[0][1])
    assert by_bytes == {1: (n, 0, 0), 2: (len(rows[1][1]), len(half) + 1, 1), 3: (5000, 5000, 1)}
    assert by_words[1] == 0 and by_words[2] == 220_000 and by_words[3] >= len(half[-5000:].split()) - 1


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (1, text + " more", 3), (2, text, 4)], SCHEMA)
    got = sorted((r.doc_id, r.n_bytes - r.n_removed) for r in remove_repeats(df).collect())
    whole = sorted((r.doc_id, r.n_words - r.n_removed) for r in remove_substrings(df).collect())
    assert got[0][0] == whole[0][0] == 1 and got[3] == (2, 0) and whole[3] == (2, 0)
    assert sorted(x for _, x in whole[:3]) in ([1, 90, 90], [0, 0, 91])
    assert remove_repeats(df.limit(0)).count() == remove_substrings(df.limit(0)).count() == 0


def test_clean_documents(spark):
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, text, 1), (2, "own beginning " + text, 2), (3, text, 3), (4, None, 4), (5, "", 5)], SCHEMA)
    got = {r.doc_id: r.text for r in clean_documents(df).collect()}
    assert got == {1: text, 2: "own beginning ", 4: None, 5: ""}
