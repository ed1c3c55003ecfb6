"""Suffix-array deduplication of bytes by a depth-limited radix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, doc_ids, slices, unused, utf8
from .windows import Kind, covered, ranks, redundant, redundant_windows


def radix_classes(length: int) -> Callable:
    """Depth-limited radix sort of suffixes by their own leading bytes, for Kind.classes.

    The first digit is the bucket, each further one the next eight bytes of the suffix, the most significant first. A
    pass orders the suffixes that are left by their group so far and the digit; those that end up alone leave.
    Groups that are left at the depth are equal strings, by their bytes.
    """

    def classes(contents: list[bytes], data: np.ndarray, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
        n = min(8, length)
        digit = np.zeros(max(0, len(data) - n + 1), U)
        for i in range(n):  # the n bytes from each place on, as one number
            digit = (digit << U(8)) | data[i : len(data) - n + 1 + i]
        left, key = np.arange(len(pos)), group
        for depth in [*range(0, length - n, n), length - n]:
            name = ranks(key, digit[pos[left] + depth])
            size = np.bincount(name, minlength=1)[name] if len(name) else name
            left, key = left[size > 1], name[size > 1]
        out = np.full(len(pos), -1)
        out[left] = key
        return out

    return classes


def suffixes(threshold: int = 100) -> Kind:
    """Suffixes are ordered through `threshold` bytes only, most significant digit first.

    The buckets of the first pass are those of an anchor, the least-hashed gram of the threshold bytes, so that
    neighbouring suffixes with one anchor travel together as one run, and suffixes whose anchor occurs once are done. In
    a bucket equal runs are one; the suffixes of the others are ordered by radix_classes().
    """
    return Kind(words=False, length=threshold, gram=max(1, min(threshold, max(8, threshold * 24 // 100))), by_document=False, classes=radix_classes(threshold))


def remove_repeats(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document.

    A byte goes if a threshold-byte string that covers it also starts earlier: in a document with a smaller doc_id,
    or earlier in its own. Strings are judged on the input; texts are UTF-8 and matches stay within a document. Null
    text is empty; a null doc_id comes first; rows with equal doc_id and text are one document; rows that share only
    the doc_id are ordered by a hash of their text. Texts under threshold bytes stay. Empty table: no rows.
    Other columns are not looked at.
    """
    kind = suffixes(threshold)
    rows, said = redundant_windows(docs, kind)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                out = []
                for doc_id, (own, gone) in zip(doc_ids(b.column("k")).to_pylist(), _marked(b, kind), strict=True):
                    kept = own if gone is None else own[~gone]
                    spans = 0 if gone is None else int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    out.append((doc_id, len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return rows.join(said, ["k", "sub"], "left").select("text", "k", "sub", "said").mapInArrow(run, schema)


def _marked(b: pa.RecordBatch, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Bytes of each text of a batch, and which of them go (None: none)."""
    data, off = utf8(b.column("text"))
    for i in range(b.num_rows):
        own, told, gone = data[off[i] : off[i + 1]], b.column("said")[i], None
        if told.is_valid:
            gone = covered(redundant(kind, len(own) - kind.length + 1, told.values.to_numpy(), lambda: own.astype(U)), len(own), kind.length)
        yield own, gone


def clean_documents(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """docs with the repeats taken out of text (and n_chars counted anew); a document of which nothing is left goes.

    Characters of which only some bytes are repeated go whole. Documents that were empty before, null texts included,
    stay as they are. A repeated row (equal doc_id and text) is treated as its first. Empty table: no rows. All
    columns, whatever their names, travel with the text, which is exchanged once.
    """
    kind = suffixes(threshold)
    rest, null = [c for c in docs.columns if c != "text"], unused("null", docs)
    rows, said = redundant_windows(docs, kind, F.struct(*rest, F.col("text").isNull().alias(null)))
    schema = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                texts, changed = [], []
                for own, gone in _marked(b, kind):
                    changed.append(gone is not None and bool(gone.any()))
                    texts.append((own[~gone] if changed[-1] else own).tobytes().decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string()), pa.array(changed)], ["rest", "text", "changed"])

    out = rows.join(said, ["k", "sub"], "left").select("text", "k", "sub", "rest", "said").mapInArrow(run, schema).where("not changed or text <> ''")
    fields = {c: F.col("rest").getField(c) for c in rest} | {"text": F.when(~F.col("rest").getField(null), F.col("text"))}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(fields["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fields[c].alias(c) for c in docs.columns])
