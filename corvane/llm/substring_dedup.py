"""Substring deduplication of words by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_ids, slices, spans_hash, utf8, words
from .windows import Kind, covered, ranks, redundant, redundant_windows


def whole_classes(window: int) -> Callable:
    """Windows sorted whole by their words, for Kind.classes.

    Different words get different numbers. The rank of 2, 4, 8, ... consecutive words among all such is that of their
    halves' ranks, and that of a window of its first and its last ranked part: equal ranks are equal words.
    """

    def classes(contents: list[bytes], data: np.ndarray, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
        known: dict[bytes, int] = {}
        rank = np.fromiter((known.setdefault(w, len(known)) for c in contents for w in c.split()), np.int64)
        m = 1
        while 2 * m <= window:
            rank = ranks(rank[: len(rank) - m], rank[m:])
            m *= 2
        if m < window:
            rank = ranks(rank[: len(rank) - (window - m)], rank[window - m :])
        found = ranks(group, rank[pos])
        size = np.bincount(found, minlength=1)[found] if len(found) else found
        return np.where(size > 1, found, -1)

    return classes


def super_kmers(window: int = 50) -> Kind:
    """Consecutive windows with one minimiser (of 8 words) are a super-k-mer and travel as one packed string to the
    minimiser's bucket, where the windows are sorted whole."""
    return Kind(words=True, length=window, gram=max(1, window * 8 // 50), by_document=True, classes=whole_classes(window))


def remove_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document.

    Words are runs of characters other than space and tab to carriage return. A word goes if a window of consecutive
    words that covers it also starts in a document with a smaller doc_id; windows are judged on the input. The digest
    is of the words left, joined by one space. Null text has no words; a null doc_id comes first; rows with equal
    doc_id and text are one document; rows that share only the doc_id are ordered by a hash of their text. Empty
    table: no rows. Other columns are not looked at.
    """
    kind = super_kmers(window)
    rows, said = redundant_windows(docs, kind)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                data, off = utf8(b.column("text"))
                begin, end, at = words(data, off)
                out = []
                for i, (doc_id, text) in enumerate(zip(doc_ids(b.column("k")).to_pylist(), b.column("text").to_pylist(), strict=True)):
                    told, n = b.column("said")[i], int(at[i + 1] - at[i])
                    found, own = text.encode().split(), slice(at[i], at[i + 1])
                    if told.is_valid:
                        gone = covered(redundant(kind, n - window + 1, told.values.to_numpy(), lambda own=own: spans_hash(data, begin[own], end[own])), n, window)
                        found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                    out.append((doc_id, n, n - len(found), hashlib.sha256(b" ".join(found)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [x.split()[0] for x in schema.split(", ")])

    return rows.join(said, ["k", "sub"], "left").select("text", "k", "sub", "said").mapInArrow(run, schema)
