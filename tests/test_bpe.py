"""Byte pairs against a plain trainer and encoder that scan everything for each merge."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import bpe
from corvane.operators.training import BYTE_OFFSET, SPECIAL

SF = "/root/testdata/sf0.001"


def replaced(ids, pair, new):
    out = []
    for i in ids:
        if out and (out[-1], i) == pair:
            out[-1] = new
        else:
            out.append(i)
    return out


def plain_train(texts, vocabulary, least=2):
    held, merges = [[BYTE_OFFSET + b for b in t.encode()] for t in texts if t], []
    while bpe.FIRST_MERGE + len(merges) < vocabulary:
        n = Counter()
        for ids in held:
            n.update(zip(ids, ids[1:]))
        if not n or n.most_common(1)[0][1] < least:
            break
        pair, count = n.most_common(1)[0]  # of equals the one seen first
        merges.append((len(merges), *pair, bpe.FIRST_MERGE + len(merges), count))
        held = [replaced(ids, pair, merges[-1][3]) for ids in held]
    return merges


def plain_encode(text, merges):
    ids = [BYTE_OFFSET + b for b in text.encode()]
    for left, right, new in merges:
        ids = replaced(ids, (left, right), new)
    return ids


def test_train_equals_plain(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert [tuple(r) for r in bpe.train(df, 285).collect()] == plain_train(texts, 285)


def test_train_ties_runs_and_copies(spark):
    draw = random.Random(3)
    texts = ["aaaaaaa", "abababab", "aaaa", None, "", "été été", "aaaaaaa", "the cat the hat", "🙂🙂🙂"] + ["".join(draw.choice("abc ") for _ in range(40)) for _ in range(20)] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    want = plain_train(texts, 300)
    assert [tuple(r) for r in bpe.train(df, 300).collect()] == want and len(want) > 30
    old = bpe.BLOCK, bpe.CUT_EVERY
    try:  # many blocks, the state written each other round
        bpe.BLOCK, bpe.CUT_EVERY = 60, 2
        assert [tuple(r) for r in bpe.train(df, 275).collect()] == want[: 275 - bpe.FIRST_MERGE]
    finally:
        bpe.BLOCK, bpe.CUT_EVERY = old
    assert bpe.train(df.limit(0), 300).count() == 0 and bpe.train(df, bpe.FIRST_MERGE).count() == 0
    with pytest.raises(ValueError):
        bpe.train(df, 10)


MERGES = [m[1:4] for m in plain_train(["abab aaaa ba bb aab", "été été naïve", "aaaa aaaaa aaa", "the then there"] * 3, 300)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab éthern", max_size=60), max_size=5))
def test_encoder_equals_plain(texts):
    got = bpe.Encoder(MERGES)(texts, False)
    assert [x.tolist() for x in got] == [plain_encode(t, MERGES) for t in texts]
    decoder = bpe.Decoder(MERGES)
    assert [decoder(x.tolist()) for x in got] == texts


def test_long_text():
    """Five million characters in one text, in seconds."""
    text = "aaab the then é" * 350_000
    ids = bpe.Encoder(MERGES)([text], False)[0]
    assert bpe.Decoder(MERGES)(ids.tolist()) == text and len(ids) < len(text) / 2


def test_control_tokens(spark):
    merges = spark.createDataFrame([(i, *m) for i, m in enumerate(MERGES)], "rank long, left long, right long, new_id long")
    rows = [(1, "<|user|>abab<|eos|><|eos|>", "k"), (2, None, "k"), (3, "no <|other|> <|eos|", "k"), (4, "", "k"), (None, "<|pad|>", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(df, merges), merges).collect()}
    assert ids[1][0][0] == SPECIAL.index("<|user|>") and ids[1][0][-2:] == [2, 2] and ids[1][1] == rows[0][1] and ids[None][0] == [0]
    assert ids[2] == ([], "") == ids[4] and ids[3][1] == rows[2][1]
    plain = {r.doc_id: r.ids for r in bpe.encode(df, merges, allow_special=False, add_bos=True, add_eos=True).collect()}
    assert plain[1] == [1, *plain_encode(rows[0][1], MERGES), 2] and plain[2] == [1, 2]
    skipped = bpe.decode(bpe.encode(df, merges), merges, skip_special=True)
    assert {r.doc_id: r.decoded for r in skipped.collect()}[1] == "abab"
    assert bpe.encode(df.limit(0), merges).count() == 0
    with pytest.raises(ValueError):
        bpe.Decoder(MERGES)([99_999])
    with pytest.raises(ValueError):
        bpe.merges_of(spark.createDataFrame([(0, 7, 5_000, 262)], "rank long, left long, right long, new_id long"))


def test_saved(spark, tmp_path):
    merges = spark.createDataFrame([(i, *m) for i, m in enumerate(MERGES)], "rank long, left long, right long, new_id long")
    bpe.save(merges, str(tmp_path / "t"))
    assert bpe.merges_of(bpe.load(spark, str(tmp_path / "t"))) == MERGES


def test_touching_counts_copies():
    tokens = np.array([-1, 7, 7, 7, -1, 7, 7, -1], np.int32)
    asked = np.ones(20, bool)
    pair, n, at = bpe.touching(tokens, asked, np.array([3, 5]))
    assert pair.tolist() == [7 << 32 | 7] and n.tolist() == [2 * 3 + 5] and at.tolist() == [1]
