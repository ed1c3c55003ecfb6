"""Properties of parsers and measures over generated inputs."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import warc
from corvane.llm.common import utf8, words
from corvane.llm.decontaminate import common_subsequence
from corvane.llm.near_dedup import aligned_similarity
from corvane.llm.suffix_dedup import suffixes
from corvane.llm.windows import gram_hash, repeated_in_buckets, runs_of

texts = st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=6)
rows = st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=2, max_size=2)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(texts)
@settings(deadline=None)
def test_words(given_texts):
    data, off = utf8(pa.array(given_texts, pa.string()))
    begin, end, at = words(data, off)
    assert [data[b:e].tobytes().decode() for b, e in zip(begin, end, strict=True)] == [w for t in given_texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert at[-1] == len(begin)


@given(st.lists(st.tuples(st.text(st.characters(codec="utf-8"), max_size=20), st.binary(max_size=60)), max_size=5), st.sampled_from("12"))
@settings(deadline=None)
def test_arc_round_trip(records, version):
    data = warc.write_arc([(u or "x", "20240101000000", b) for u, b in records], version)
    assert [r["block"] for r in warc.parse_arc(data)] == [b for _, b in records]


@given(rows)
@settings(deadline=None)
def test_subsequences(pair):
    a, b = pair
    n = lcs(a, b)
    assert common_subsequence(a, b) == n
    s = n / (len(a) + len(b) - n) if a and b else 0
    assert abs(aligned_similarity(a, b, 0.5) - (s if s >= 0.5 else 0)) < 1e-12, (a, b)


@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.integers(8, 20))
@settings(deadline=None, max_examples=60)
def test_runs_cover_every_window_once(given_texts, length):
    """Each window of each text is in one run, and equal windows meet in a bucket that tells all but the first."""
    kind = suffixes(length)
    data, off = utf8(pa.array(given_texts, pa.string()))
    tokens, at, _, _ = kind.tokens(data, off)
    gram, first, count = runs_of(kind, tokens, at)
    seen = sorted(p for f, c in zip(first, count, strict=True) for p in range(f, f + c))
    assert seen == [p for a, z in zip(at[:-1], at[1:], strict=True) for p in range(a, max(a, z - length + 1))]
    if not len(gram):
        return
    doc = np.searchsorted(at, first, "right") - 1
    raw = data.tobytes()
    content = [raw[f : f + c + length - 1] for f, c in zip(first.tolist(), count.tolist(), strict=True)]
    row, begin, size = repeated_in_buckets(kind, gram.view(np.int64), doc, np.zeros_like(doc), first - at[doc], content)
    told = sorted((int(doc[r]), p) for r, b, n in zip(row, begin, size, strict=True) for p in range(b, b + (n if n >= 0 else int(count[r]))))
    known, want = set(), []
    for d, t in enumerate(given_texts):
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in known:
                want.append((d, p))
            known.add(w)
    assert told == want
    assert len(gram_hash(tokens, length, True)) == max(0, len(tokens) - length + 1) or len(tokens) < length
