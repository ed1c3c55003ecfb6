"""Shared helpers: components, word hashes, shingles, fingerprints."""

import random
import re

import numpy as np
import pyarrow as pa

from corvane.llm.common import shingles, slices, spans_hash, utf8, words
from corvane.llm.components import components
from corvane.llm.fingerprints import likeness, packed, sketches


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_hashes():
    texts = ["", "a", " two  words\t", "é\x0bü\x1cx", None, "日本 語", "  ", "two words"]
    data, off = utf8(pa.array(texts, pa.string()))
    begin, end, at = words(data, off)
    found = [data[b:e].tobytes().decode() for b, e in zip(begin, end, strict=True)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found == [w for ws in want for w in ws] and np.diff(at).tolist() == [len(w) for w in want]
    h = dict(zip(found, spans_hash(data, begin, end).tolist(), strict=False))
    assert len(set(h.values())) == len(set(found)) and spans_hash(data, begin, end)[1] == spans_hash(data, begin, end)[-2]
    s, to = shingles(spans_hash(data, begin, end), at)
    assert np.diff(to).tolist() == [1 if w else 0 for w in want] and s[to[2]] == s[to[7]]


def test_slices():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 0, 0, 500, 1, 1)])], ["text"])
    parts = list(slices(b, "text", 60))
    assert sum(p.num_rows for p in parts) == 7 and [p.num_rows for p in parts] == [4, 1, 2]
    assert list(slices(b.slice(0, 0), "text")) == []


def test_likeness_of_few_shingles():
    low, some = sketches(pa.array(["one two", "three", "one two", "", "a b c d e f g h"]))
    j = lambda a, b: likeness(low[a : a + 1], low[b : b + 1], some[a : a + 1], some[b : b + 1])[0]
    assert j(0, 2) == 1 and j(0, 1) < 0.1 and j(3, 3) == 1 and j(0, 3) == 0 and packed(low, some)[3] == "" and len(packed(low, some)[4]) == 512
