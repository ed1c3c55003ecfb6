"""Queries over whole texts and tables against brute force."""

import hashlib
import re

from corvane.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_error_rates(spark):
    text = {r.item_id: re.sub("[^A-Za-z .]", "", r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pairs = {i: (t, text[i + 1]) for i, t in text.items() if i + 1 in text}
    assert max(map(len, text.values())) > 60
    wer = {r.id: r.wer for r in QUERIES["wer"](spark, SF).collect()}
    assert wer == {i: round(edits(a.split(), b.split()) / len(a.split()), 6) for i, (a, b) in pairs.items()}
    some = sorted(pairs)[:40]
    cer = {r.item_id: r.cer for r in QUERIES["cer"](spark, SF).collect()}
    assert set(cer) == set(pairs) and all(cer[i] == round(edits(*pairs[i]) / len(pairs[i][0]), 6) for i in some)


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_byte_tokens(spark):
    got = {r.doc_id: (r.n, r.ids_sha256) for r in QUERIES["byte_tokens"](spark, SF).collect()}
    want = {i: [b + 6 for b in t.encode()] for i, t in texts(spark).items()}
    assert got == {i: (len(w), hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest()) for i, w in want.items()}


def test_ink(spark):
    runs = {i: [m.span() for m in re.finditer("[a-z]+", t)] for i, t in texts(spark).items()}
    got = sorted(tuple(r) for r in QUERIES["ink_runs"](spark, SF).collect())
    assert got == sorted((i, a, b - a) for i, x in runs.items() for a, b in x) and max(x[1] for x in got) > 120
    gaps = sorted(tuple(r) for r in QUERIES["glyph_gaps"](spark, SF).collect())
    assert gaps == sorted((i, y[0], y[0] - x[1]) for i, z in runs.items() for x, y in zip(z, z[1:], strict=False))


def test_replace_same_name(spark):
    got = {r.doc_id: r.name for r in QUERIES["replace_same_name"](spark, SF).collect()}
    every = set(texts(spark))
    new = {i for i in got if got[i].startswith("NAME")}
    assert new and every - new and {i % 300 for i in new}.isdisjoint(i % 300 for i in set(got) - new)
    assert set(got) == new | {i for i in every - new if i % 300 not in {j % 300 for j in new}}
