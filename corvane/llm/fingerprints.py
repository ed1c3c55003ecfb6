"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, cut, doc_ids, keyed, mix, shingles, slices, spans_hash, utf8, words

BINS, BITS = 512, 4
#: Bytes of a block of consecutive documents, as the plan estimates them; blocks at most, which bounds what is broadcast.
BLOCK, MOST_BLOCKS = 32 << 20, 20_000
EMPTY = U(0xFFFFFFFFFFFFFFFF)
_RANK: np.ndarray | None = None


def _ranks() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks at the others when it is empty, and each one's place in it."""
    global _RANK
    if _RANK is None:
        key = mix(np.arange(1, BINS * BINS + 1, dtype=U)).reshape(BINS, BINS)
        order = key.argsort(1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(BINS)[None, :].repeat(BINS, 0), 1)
        _RANK = np.stack([order, place])
    return _RANK[0], _RANK[1]


def sketches(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of every bin (rows x BINS) and whether the text has a word at all.

    Each k-word shingle is hashed once; high bits choose the bin, which keeps its least value. An empty bin takes
    the value of the first filled one in its own random order, so all filled bins are equally likely.
    """
    data, off = utf8(texts)
    begin, end, at = words(data, off)
    h, to = shingles(spans_hash(data, begin, end), at, k)
    n = len(off) - 1
    return one_permutation(h, np.repeat(np.arange(n), np.diff(to)), n)


def one_permutation(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sketches() of n texts from the hashes of their elements and the text that each is of."""
    slot = owner * BINS + (h >> U(64 - 9)).astype(np.int64)
    value = h << U(9) >> U(9)
    order = np.argsort(((slot.astype(U)) << U(40)) | (value >> U(15)), kind="stable") if n * BINS < 1 << 24 else np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    bins = np.full(n * BINS, EMPTY, U)
    bins[slot[first]] = value[first]
    bins = bins.reshape(n, BINS)
    filled = bins != EMPTY
    some = filled.any(1)
    look, place = _ranks()
    rows, cols = np.nonzero(~filled & some[:, None])
    for t in range(24):
        if not len(rows):
            break
        other = look[cols, t]
        hit = filled[rows, other]
        bins[rows[hit], cols[hit]] = bins[rows[hit], other[hit]]
        rows, cols = rows[~hit], cols[~hit]
    if len(rows):
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for a, b in zip(heads, [*heads[1:], len(rows)], strict=True):
            full, c = np.flatnonzero(filled[rows[a]]), cols[a:b]
            bins[rows[a], c] = bins[rows[a], full[place[np.ix_(c, full)].argmin(1)]]
    # salted by bin: else one value in many bins would agree with another in all of them or in none
    salted = mix(bins + np.arange(1, BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (salted & U((1 << BITS) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal form, two bins a byte; empty for a text without words."""
    held = (low[:, 0::2] << 4) | low[:, 1::2]
    return [r.tobytes().hex() if s else "" for r, s in zip(held, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal bins less what BITS bits agree by chance. Both empty: 1."""
    chance = 1 / (1 << BITS)
    j = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, j, (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: pa.Array, texts: list[str], following: list[str] | None) -> pa.RecordBatch:
    """following: the next text of each row, or None if texts has one more entry, the next of the last row."""
    n = len(ids)
    nexts = following if following is not None else texts[1:]
    changed = [edited(t, x) for t, x in zip(texts[:n], nexts, strict=True)]
    low, some = sketches(pa.array(texts + (following or []), pa.large_string()))
    low_e, some_e = sketches(pa.array(changed, pa.large_string()))
    a, b = (slice(0, n), slice(1, n + 1)) if following is None else (slice(0, n), slice(n, 2 * n))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(packed(low[a], some[a]), pa.string()),
            pa.array(packed(low_e, some_e), pa.string()),
            pa.array(likeness(low[a], low_e, some[a], some_e)),
            pa.array(likeness(low[a], low[b], some[a], some[b])),
        ],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def below(cuts: list[int], k: Column) -> Column:
    """How many of the sorted cuts are smaller than k, by bisection."""
    held = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    start = F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("z"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["a"] + acc["z"]) / 2).cast("int")
        less = F.get(held, mid) < k
        more = acc["a"] < acc["z"]
        return F.struct(F.when(more & less, mid + 1).otherwise(acc["a"]).alias("a"), F.when(more & ~less, mid).otherwise(acc["z"]).alias("z"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step, lambda acc: acc["a"])


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they and the next document's are.

    Documents are dealt to blocks of consecutive doc_ids by quantiles, so a document's next is in its block or is
    the first of the next one; a doc_id that many rows share is dealt to several blocks by the hash of the text. A block
    is of about BLOCK bytes. Null text: empty, fingerprint "". A null doc_id comes first; equal doc_ids are
    ordered by the hash of their text. One row alone is its own next. Empty table: no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    blocks = max(parts, min(MOST_BLOCKS, size // BLOCK))
    found = rows.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)] or [0.5], 10000)).first()[0] or []
    cuts, times = sorted(set(found)), Counter(found)
    block = below(cuts, F.col("k"))
    often = {c: n for c, n in times.items() if n > 1}
    if often:  # blocks of its own for each cut that a doc_id fills; those that follow move up
        extra = list(itertools.accumulate((times[c] - 1 for c in cuts), initial=0))
        block = block + F.get(F.array(*map(F.lit, extra)), block)
        n = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x).cast("long") for p in often.items() for x in p]), lambda c, _: c == F.col("k"))), F.lit(0)), F.lit(1))
        block = block + F.floor((F.shiftright("sub", 1) + (1 << 62)) / F.lit(float(1 << 63)) * n)
    # ranges of block numbers, evened by their samples: a block is never parted
    dealt = rows.select("k", "sub", "text", block.cast("long").alias("block")).repartitionByRange(parts, "block")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for b in slices(batch, "text", 1_500_000):
                both = pa.concat_batches([held, b]) if held is not None else b
                held = both.slice(both.num_rows - 1)
                block = both.column("block").to_numpy(zero_copy_only=False)
                if both.num_rows > 1:
                    out = _compare(doc_ids(both.column("k")).slice(0, both.num_rows - 1), both.column("text").to_pylist(), None)
                    yield out.filter(pa.array(block[:-1] == block[1:]))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_500_000):
                yield _compare(doc_ids(b.column("k")), b.column("text").to_pylist(), b.column("following").to_pylist())

    inside = dealt.sortWithinPartitions("block", "k", "sub").mapInArrow(inner, SCHEMA)
    # the first and the last text of each block, from the keys alone
    keys = rows.select("k", "sub", block.cast("long").alias("block"))
    ends = cut(keys.groupBy("block").agg(F.min(F.struct("k", "sub")).alias("a"), F.max(F.struct("k", "sub")).alias("z")))
    asked = ends.select(F.explode(F.array("a", "z")).alias("o")).select("o.*").distinct()
    texts = cut(rows.select("k", "sub", "text").join(F.broadcast(asked), ["k", "sub"], "left_semi").dropDuplicates(["k", "sub"]))  # two a block
    # one row a block: the order of the blocks, the first after the last
    order = Window.orderBy("block")
    onward = ends.withColumn("after", F.coalesce(F.lead("a").over(order), F.min("a").over(order))).select("z.*", "after")
    heads = texts.select(F.struct("k", "sub").alias("after"), F.col("text").alias("following"))
    last = onward.join(texts, ["k", "sub"]).join(heads, "after").select("k", "text", "following")
    return inside.unionByName(last.mapInArrow(outer, SCHEMA))
