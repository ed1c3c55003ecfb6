"""Byte-pair training keeps two bytes a token and counts pairs without sorting, with the same results."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.operators import bpe


def test_f2_tokens_take_two_bytes(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "é")], "doc_id long, text string")
    rows = bpe._blocks(df, bpe._kind(401)).collect()
    assert sum(len(r.tokens) for r in rows) == 2 * (3 + 2 + 2 + len(rows))  # bytes, a bound after each text, one before a block
    assert bpe._kind(40_000) is np.int32


def test_f1_dense_counts_are_those_of_a_sort(monkeypatch):
    draw = np.random.default_rng(5)
    tokens = np.concatenate([[-1], draw.integers(0, 12, 3000), [-1], draw.integers(0, 3, 500), [-1]]).astype(np.int16)
    asked = np.zeros(21, bool)
    asked[[1, 2, 7]] = True
    for copies in (np.array([1, 1]), np.array([3, 2])):
        dense = bpe.touching(tokens, asked, copies)
        with monkeypatch.context() as m:
            m.setattr(bpe, "DENSE", 0)
            by_sort = bpe.touching(tokens.astype(np.int32), asked, copies)
        assert all(np.array_equal(a, b) for a, b in zip(dense, by_sort, strict=True)) and len(dense[0]) > 20


def test_f1_few_merges_one_by_one(monkeypatch):
    draw = np.random.default_rng(6)
    tokens = np.concatenate([[-1], draw.integers(0, 6, 3000), [-1], draw.integers(0, 2, 500), [-1]]).astype(np.int16)
    batch, sizes = [(0, 1, 18), (3, 3, 19)], np.array([*[1] * 18, 2, 2, 0])
    asked = np.zeros(21, bool)
    asked[[0, 1, 3, 18, 19]] = True
    held = bpe.merge(tokens, batch, 20)
    places = bpe._places(held, asked, np.array([1, 1]), sizes)
    monkeypatch.setattr(bpe, "SINGLY", 0)
    assert np.array_equal(held, bpe.merge(tokens.astype(np.int32), batch, 20)) and len(held) < len(tokens)
    assert all(np.array_equal(a, b) for a, b in zip(places, bpe._places(held, asked, np.array([1, 1]), sizes), strict=True))
    byte = [int(sizes[held[np.flatnonzero(held[:at] < 0)[-1] : at]].sum()) for at in places[2]]
    assert places[4].tolist() == byte


def _plain(texts, vocabulary):
    """Merges of a trainer that scans everything for each of them; of equals the one seen first."""
    held, out = [[bpe.BYTE_OFFSET + b for b in t.encode()] for t in texts if t], []
    while bpe.FIRST_MERGE + len(out) < vocabulary:
        n = Counter(p for ids in held for p in zip(ids, ids[1:]))
        if not n or max(n.values()) < 2:
            break
        (left, right), count = n.most_common(1)[0]
        new = bpe.FIRST_MERGE + len(out)
        out.append((len(out), left, right, new, count))
        for ids in held:
            i = 0
            while i < len(ids) - 1:
                if ids[i] == left and ids[i + 1] == right:
                    ids[i : i + 2] = [new]
                i += 1
    return out


def _corpus():
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdéf") for _ in range(draw.randint(2, 7))) for _ in range(30)]
    texts = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(150)] + ["aaaaaaaaab", "", None, "x"] + ["".join(draw.choice("ab") for _ in range(300))]
    return [*texts, *texts[:20]]


def test_f2_state_is_a_small_part_of_the_texts(spark, monkeypatch):
    texts, seen, made = _corpus(), [], bpe._round
    monkeypatch.setattr(bpe, "BLOCK", 2_000)
    monkeypatch.setattr(bpe, "_round", lambda state, *a: seen.append(state) or made(state, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert [tuple(r) for r in bpe.train(df, 275).collect()] == _plain(texts, 275)
    held = sum(len(r.tokens) for r in seen[0].select("tokens").collect())
    assert 0 < held < sum(len(t.encode()) for t in texts if t) / 4


def test_f2_stages_equal_plain(spark, monkeypatch):
    """Many stages, slices and flushes."""
    texts = _corpus()
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)  # null comes first
    want = _plain(texts, 300)
    for k, v in {"BLOCK": 100, "SLICE": 700, "HELD": 50, "FALL": 2}.items():
        monkeypatch.setattr(bpe, k, v)
    assert [tuple(r) for r in bpe.train(df, 300).collect()] == want and len(want) > 30


def test_f2_sparse_and_merged_runs(monkeypatch):
    draw = np.random.default_rng(8)
    merges = [(0, 1, 12), (12, 0, 13), (3, 3, 14), (14, 3, 15), (13, 13, 16)]
    tokens = np.concatenate([[-1], draw.integers(0, 5, 4000), [-1, -1], draw.integers(3, 4, 9), [-1]]).astype(np.int16)
    encoder, links = bpe.Encoder(merges), bpe._links(merges)
    want = encoder.merged(tokens.astype(np.int32))
    assert np.array_equal(bpe._merged(tokens, encoder, links, 18), want) and len(want) < len(tokens)
    among = bpe._among(tokens, links, 18)
    monkeypatch.setattr(bpe, "DENSE", 0)
    assert np.array_equal(bpe._among(tokens, links, 18), among) and among.any()
    assert np.array_equal(bpe._merged(tokens, encoder, links, 18), want)


def test_f1_many_decoded_at_once():
    merges = [(bpe.BYTE_OFFSET + 0xC3, bpe.BYTE_OFFSET + 0xA9, 262), (262, 262, 263)]
    decoder, e, half = bpe.Decoder(merges), bpe.BYTE_OFFSET, bpe.BYTE_OFFSET + 0xC3
    whole = [[263, e + 97], [], None, [262], [e + 98] * 5]
    for lists in (whole, [*whole, [half], [e + 0xA9]], [*whole, [half, 3, 262], [0]], [None], []):
        for skip in (False, True):
            want = [None if x is None else decoder(x, skip) for x in lists]
            assert decoder.many(pa.array(lists, pa.list_(pa.int32())), skip).to_pylist() == want
            assert decoder.many(pa.array([[e], *lists], pa.list_(pa.int64())).slice(1), skip).to_pylist() == want


def test_f1_slices_are_bounded(monkeypatch):
    """Texts are encoded and decoded a bounded number of characters at once."""
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "", "b" * 200, "c"] * 4)], ["text"])
    parts = list(bpe._parts(batch, pc.utf8_length(batch.column("text"))))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert max(len(x or "") for part in parts for x in part.column("text").to_pylist()) == 200 and len(parts) == 7
    assert all(sum(len(x or "") for x in part.column("text").to_pylist()) <= 50 + 200 for part in parts)
