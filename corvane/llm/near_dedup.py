"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, U, cut, free_shuffles, has_repeats, keyed, mix, shingles, slices, spans_hash, unused, utf8, words
from .components import components
from .fingerprints import BINS, BITS, one_permutation

#: Sketches of a document, k-mers of a sketch, words of a k-mer.
SKETCHES, ORDERED, WORDS = 16, 3, 5
#: Buckets of up to so many different texts give all their pairs; in larger ones members meet the most central one.
SMALL = 24
#: Members that are not of the central one's class are compared by fingerprint with all others, in blocks of so many;
#: estimates down to three and a half standard errors under the threshold are verified.
PART, SLACK = 500, 0.065
#: Up to so many ids of texts to compare are sent to all tasks (8 MB); more meet the texts in a shuffle.
SENT = 500_000


def order_sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """rows x SKETCHES order MinHash values (0 for a text without words), and packed one-permutation fingerprints.

    K-mers are labelled with their occurrence, so repeats count. A sketch takes the ORDERED least of them under its
    own hash and keeps their order in the text: two texts agree where these are the same k-mers in the same order.
    """
    data, off = utf8(texts)
    begin, end, at = words(data, off)
    h, to = shingles(spans_hash(data, begin, end), at, WORDS)
    n = len(off) - 1
    count = np.diff(to)
    owner = np.repeat(np.arange(n), count)
    key = (owner.astype(U) << U(44)) | (h >> U(20))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.arange(len(ranked))
    nth = np.empty(len(ranked), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    labelled = mix(h + nth.astype(U) * U(0x9E3779B97F4A7C15))
    some = np.flatnonzero(count > 0)
    starts = to[:-1][some]
    inner = np.repeat(np.arange(len(some)), count[some])
    out = np.zeros((n, SKETCHES), U)
    top = U(0xFFFFFFFFFFFFFFFF)
    for s in range(SKETCHES if len(some) else 0):
        v = labelled * (mix(np.array([s + 1], U))[0] | U(1))
        picked = np.full((len(some), ORDERED), len(v), np.int64)
        for j in range(ORDERED):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero((v == least[inner]) & (v != top))
            first = np.ones(len(hit), bool)
            first[1:] = inner[hit[1:]] != inner[hit[:-1]]
            hit = hit[first]
            picked[inner[hit], j] = hit
            v[hit] = top
        picked.sort(1)
        padded = np.append(labelled, U(0))
        value = np.full(len(some), s + 1, U)
        for j in range(ORDERED):
            value = mix(value * U(0x9FB21C651E98DF25) + padded[picked[:, j]])
        out[some, s] = value | U(1)
    low, _ = one_permutation(labelled, owner, n)
    return out, (low[:, 0::2] << 4) | low[:, 1::2]


def grams(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, at = words(data, np.array([0, len(data)]))
    return shingles(spans_hash(data, begin, end), at, WORDS)[0].tolist() if len(begin) else []


def _common(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence that stays within band elements of the diagonal.

    A row of the table is one integer with a bit for each place of the band; it moves along the diagonal.
    """
    where: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        where.setdefault(v, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, passed, low = full, 0, -band  # bits are places low, low + 1, ... of x; 0: counted
    for v in y:
        found = where.get(v)
        if found:
            match = 0
            for p in found[bisect_left(found, low) : bisect_left(found, low + width)]:
                match |= 1 << (p - low)
            u = row & match
            row = ((row + u) | (row - u)) & full
        passed += not row & 1
        row = (row >> 1) | (1 << (width - 1))
        low += 1
    return passed + width - row.bit_count()


def aligned_similarity(a: list[int], b: list[int], least: float) -> float:
    """Longest common subsequence of two sequences over the rest of both, by alignment within a band; 0 if under least.

    Sequences are shifted against each other by no more than the elements that they don't share. The band starts
    narrow and is widened until it is that wide, or as wide as sequences may be shifted that are as alike as `least`;
    sequences whose elements, in any order, can't be so alike aren't aligned.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    shared = sum((Counter(a) & Counter(b)).values())
    if shared < least * (n + m - shared):
        return 0.0
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    most = int(n + m - 2 * least * (n + m) / (1 + least)) + 1
    band = min(most, max(32, abs(n - m)))
    while True:
        common = head + tail + _common(x, y, band)
        if band >= min(most, n + m - 2 * common):
            break
        band = min(most, 4 * band)
    s = common / (n + m - common)
    return s if s >= least else 0.0


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are as alike as least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[int]] = ("", [])
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x = x.as_py()
                if x != last[0]:
                    last = (x, grams(x))
                keep.append(aligned_similarity(last[1], grams(y.as_py()), least) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts.join(F.broadcast(asked) if asked.count() <= SENT else asked, "id", "left_semi")
    # the text of the many members moves, their leader's is only joined
    held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "y")
    held = held.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return held.mapInArrow(run, "a long, b long")


def _alike(least: float):
    """Pairs of a part's rest and members that are of different classes and may be as alike as least."""
    same = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)
    chance = 1 / (1 << BITS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, every = pdf[pdf["told"].notna()], pdf[pdf["told"].isna()]
        prints = np.frombuffer(b"".join(every["print"]), np.uint8).reshape(len(every), -1)
        ids, roots, keys = every["id"].to_numpy(), every["root"].to_numpy(), np.array(every["keys"].tolist(), np.int64).reshape(len(every), -1)
        out, last = [], np.iinfo(np.int64).max
        for i, root, p, told, key in zip(rest["id"], rest["root"], rest["print"], rest["told"], rest["key"], strict=True):
            # of the buckets that two texts meet in as rest and member, the one with the smallest key compares them
            mine = np.flatnonzero((np.where(np.isin(keys, told), keys, last).min(1) == key) & (roots != root))
            j = (same[prints[mine] ^ np.frombuffer(p, np.uint8)].sum(1, dtype=np.int64) / BINS - chance) / (1 - chance)
            out += [(min(i, x), max(i, x)) for x in ids[mine[j >= least - SLACK]].tolist()]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype=np.int64)

    return run


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """k, sub, first (of the class) and class_k for each document.

    Two texts are linked if their sequences of five-word shingles align to `least` or more (a Jaccard similarity in
    which order and repeats count). Documents of one class are connected by links or equal texts; class_k is the
    smallest k of the class, and first is true for the one document, smallest by (k, sub), that stands for it. Texts of
    one to four words are one shingle; texts without words are alike only if equal.

    Equal texts are merged by partial aggregation before anything else. Small buckets of equal sketches are
    compared pair by pair. In larger ones all members are compared with the one whose sketches most texts share; what
    is not of its class is then compared with all members by fingerprint, in parts of bounded size, and whatever may
    reach the threshold is verified. What is of one class already needs no more comparison. No bucket is gathered.
    """
    rows = keyed(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 400_000):
                found, prints = order_sketches(b.column("text"))
                flat = pa.array(found.reshape(-1).view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * SKETCHES, SKETCHES, dtype=np.int32)), flat)
                packed = pa.array([p.tobytes() for p in prints], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "k", "sub", "h1", "h2")] + [keys, packed], ["id", "k", "sub", "h1", "h2", "keys", "print"])

    ident = F.when(F.col("sub") == 0, F.col("k")).otherwise(F.xxhash64("k", "sub"))
    rows = rows.withColumn("id", ident)
    hashed = rows.select("id", "k", "sub", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")
    signed = cut(hashed.mapInArrow(sketch, "id long, k long, sub long, h1 long, h2 long, keys array<long>, print binary"))
    copies = signed.select("id", "k", "sub", "h1", "h2").dropDuplicates(["k", "sub"])
    nodes = signed.groupBy("h1", "h2").agg(F.min(F.struct("k", "sub", "id")).alias("o"), F.first("keys").alias("keys"), F.first("print").alias("print"))
    nodes = cut(nodes.select("h1", "h2", F.col("o.id").alias("id"), "keys", "print"))
    buckets = nodes.select("id", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0")
    # aggregates are written before they are joined, so that Spark can split the join where a key or a class is large
    sizes = cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(buckets.join(sizes, "key"))
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = small.select(F.explode(pair).alias("p")).select("p.*")
    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    large = members.where(F.col("n") > SMALL).join(shared, "id")
    leaders = cut(large.groupBy("key").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("leader")))
    large = cut(large.join(leaders, "key").select("key", "id", "n", "leader"))
    pairs = pairs.unionByName(large.where("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")))
    pairs = cut(pairs.distinct())
    texts = rows.select("id", "text")
    links = cut(_verify(pairs, texts, least))
    roots = components(links)
    placed = large.join(roots, "id", "left").select("key", "id", "n", "leader", F.coalesce("root", "id").alias("root"))
    central = placed.where("id = leader").select("key", F.col("root").alias("its"))
    rest = cut(placed.join(central, "key").where("root <> its").select("key", "id", "n", "root"))
    if not rest.isEmpty():
        counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("r"))
        across = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / F.lit(PART))))
        own = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.floor((F.col(c) - 1) / F.lit(PART)) + 1)
        part = ["key", "x", "y", "id", "root"]
        told = rest.groupBy("id").agg(F.collect_set("key").alias("told"))  # its keys, SKETCHES at most
        left = rest.join(counts, "key").withColumn("x", own("r", 1)).withColumn("y", across("n")).join(told, "id").select(*part, "told")
        right = placed.join(counts, "key").withColumn("y", own("n", 2)).withColumn("x", across("r")).select(*part, F.lit(None).cast("array<long>").alias("told"))
        both = left.unionByName(right).join(nodes.select("id", "print", "keys"), "id")
        more = both.groupBy("key", "x", "y").applyInPandas(_alike(least), "a long, b long").distinct()
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        links = cut(links.unionByName(_verify(more, texts, least)))
        roots = components(links)
    out = copies.join(nodes.select("h1", "h2", F.col("id").alias("node")), ["h1", "h2"]).join(roots.withColumnRenamed("id", "node"), "node", "left")
    out = out.select("k", "sub", F.coalesce("root", "node").alias("root"))
    heads = cut(out.groupBy("root").agg(F.min(F.struct("k", "sub")).alias("head")))
    out = out.join(heads, "root")
    return out.select("k", "sub", (F.struct("k", "sub") == F.col("head")).alias("first"), F.col("head.k").alias("class_k"))


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (smallest doc_id of its class) of each document; see near_duplicates().

    Rows with equal doc_id and text are one document and give one row; null doc_id is smaller than any other; a null
    text is empty. Empty table: no rows. Other columns are not looked at.
    """
    no = F.lit(NO_ID)
    return near_duplicates(docs, least).select(F.nullif("k", no).alias("doc_id"), F.nullif("class_k", no).alias("class_id"))


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without those that another document of their class, with a smaller doc_id, stands for.

    Of rows with equal doc_id and text one stays. A null doc_id is smaller than any other; a null text is empty, so that
    one of the null and empty texts stays. Empty table: no rows. All columns stay, whatever their names.
    """
    k, sub, told = (unused(x, docs) for x in ("k", "sub", "told"))
    gone = near_duplicates(docs, least).where("not first").select(F.col("k").alias(k), F.col("sub").alias(sub))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    if has_repeats(docs):
        named = docs.withColumn(told, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", told])
        return named.join(gone, (key == F.col(k)) & (F.col(told) == F.col(sub)), "left_anti").drop(told)
    return docs.join(gone, key == F.col(k), "left_anti")
