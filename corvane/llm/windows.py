"""Repeated windows of fixed length over a whole corpus: what byte and word deduplication have in common.

Every window of `length` tokens has a minimiser, the leftmost least of the hashed `gram`-token grams in it, so equal
windows have equal minimisers at equal places. A run is the stretch of consecutive windows with one minimiser
occurrence. Grams that occur once rule their runs out after one shuffle of a few bytes a run; only the others' texts
travel. Runs of buckets with up to HOT of them meet in one task, which reads them bucket by bucket and orders their
windows as the operator says. In larger buckets equal runs are merged by partial aggregation of their bytes, so that only
different ones meet there. Buckets with over WIDE different ones never meet: they are split by the next digit, what stands
before or after the gram, until they are smaller. Of merged runs only the windows that occur first are told.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, cut, free_shuffles, keyed, mix, slices, spans_hash, utf8, words, written

HOT, WIDE, HEAVY = 100, 500, 1000
PLACE = U((1 << 20) - 1)
SPAN = 1 << 20
RANGE, HOT_RUN, KEPT, COPY = 0, 1, 2, 3
RUN = "gram long, content binary, k long, sub long, first long, n long"
SPLIT = f"{RUN}, off long"
#: Bits of a run's number of windows beside its place in a document (up to 2**40); windows are shorter than half of that.
SIZE = 20
MOST = (1 << SIZE) - 1
#: Bytes of runs that a task orders at a time, whole buckets.
HELD = 1_000_000


@dataclass(frozen=True)
class Kind:
    """length: tokens of a window; gram: of a minimiser's gram; by_document: only other documents' windows count.

    classes: from packed runs, where their tokens begin, and the bucket of each run (by row) to the class of each of
    their windows, -1 for those alone; equal class means equal bucket and equal tokens.
    """

    words: bool
    length: int
    gram: int
    by_document: bool
    classes: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    def __post_init__(self) -> None:
        if not 1 <= self.length <= MOST // 2:
            raise ValueError(f"windows must have 1 to {MOST // 2} tokens")

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token values, where each string's begin, and begin and end byte of each token."""
        if not self.words:
            at = np.arange(len(data), dtype=np.int64)
            return data.astype(U), off, at, at + 1
        begin, end, at = words(data, off)
        return spans_hash(data, begin, end), at, begin, end


def gram_hash(tokens: np.ndarray, n: int, small: bool) -> np.ndarray:
    """Hash of every n consecutive tokens, by doubling. small: tokens are bytes."""
    h, m = tokens, 1
    while 2 * m <= n:
        left, right = h[: len(h) - m], h[m:]
        h = (left << U(8 * m)) | right if small and m < 8 else mix(left * U(0x9FB21C651E98DF25) + right)
        m *= 2
    if m < n:
        h = mix(h[: len(h) - (n - m)] * U(0xA24BAED4963EE407) + h[n - m :])
    elif small and n <= 8:
        h = mix(h)
    return h


def runs_of(kind: Kind, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, first window and number of windows of each run of the strings whose tokens begin at `at`."""
    n = len(tokens) - kind.length + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.zeros(len(tokens) + 1, np.int32)
    last = np.maximum(at[:-1], at[1:] - kind.length + 1)
    np.add.at(step, at[:-1], 1)
    np.add.at(step, last, -1)
    valid = np.cumsum(step)[:n] > 0
    w, found = kind.length - kind.gram + 1, []
    for lo in range(0, n, SPAN - kind.length):
        hi = min(n, lo + SPAN - kind.length)
        hashed = gram_hash(tokens[lo : hi + kind.length - 1], kind.gram, not kind.words)
        least = (hashed & ~PLACE) | np.arange(len(hashed), dtype=U)
        m = 1
        while 2 * m <= w:
            least = np.minimum(least[: len(least) - m], least[m:])
            m *= 2
        if m < w:
            least = np.minimum(least[: len(least) - (w - m)], least[w - m :])
        place, ok = (least & PLACE).astype(np.int64), valid[lo:hi]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        edge = np.flatnonzero(new | ~ok)
        size = np.diff(np.append(edge, len(place)))
        keep = ok[edge]
        found.append((hashed[place[edge[keep]]], edge[keep] + lo, size[keep]))
    gram, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
    return gram, first, count


def _emit(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 900_000):
                tokens, at, _, _ = kind.tokens(*utf8(b.column("text")))
                gram, first, count = runs_of(kind, tokens, at)
                doc = np.searchsorted(at, first, "right") - 1
                k, sub = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("k", "sub"))
                for i in range(0, len(gram), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(gram[s].view(np.int64)), pa.array(k[s]), pa.array(sub[s]), pa.array(((first - at[doc]) << SIZE | count)[s])], ["gram", "k", "sub", "run"])

    return run


def _texts(kind: Kind) -> Callable:
    """Documents with their repeated runs to the packed string of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 900_000):
                data, off = utf8(b.column("text"))
                at, begin, end = off, None, None
                if kind.words:
                    begin, end, at = words(data, off)
                found = b.column("runs")
                many = np.diff(found.offsets.to_numpy())
                held = found.flatten()
                gram, code = held.to_numpy(zero_copy_only=False).reshape(-1, 2).T
                doc = np.repeat(np.arange(b.num_rows), many // 2)
                first, count = code >> SIZE, code & MOST
                a = first + at[doc]
                z = a + count + kind.length - 1
                lo, hi = (begin[a], end[z - 1]) if kind.words else (a, z)
                k, sub = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("k", "sub"))
                raw = data.tobytes()
                for i in range(0, len(a), 20_000):
                    s = slice(i, i + 20_000)
                    pieces = [raw[x:y] for x, y in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[s]), pa.array(pieces, pa.binary()), pa.array(k[s]), pa.array(sub[s]), pa.array(first[s]), pa.array(count[s])],
                        ["gram", "content", "k", "sub", "first", "n"],
                    )

    return run


def places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place in it of each window, from the number of windows of each run."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def dense(x: np.ndarray) -> np.ndarray:
    """Rank of each number among the different ones."""
    order = np.argsort(x)
    ranked, out = x[order], np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) if len(x) else 0
    return out


def ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense rank of each row by high, then low. Signed numbers are ranks, of up to 2**31."""
    low = dense(low) if low.dtype == U else low
    return dense(high * (int(low.max(initial=0)) + 1) + low)


def _group_windows(kind: Kind, contents: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the runs, in order: the run each is of, its place in it, and a class number (-1: alone)."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    at = words(data, off)[2] if kind.words else off
    owner, place = places(np.diff(at) - kind.length + 1)
    return owner, place, kind.classes(contents, data, at[:-1][owner] + place, group.astype(np.int64)[owner])


def repeated_in_buckets(kind: Kind, gram: np.ndarray, k: np.ndarray, sub: np.ndarray, first: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows that an earlier equal one makes redundant: row, first window and how many.

    The rows are runs of whole buckets.
    """
    order = np.lexsort((first, sub, k, gram))
    gram, k, sub, first = gram[order], k[order], sub[order], first[order]
    content = [content[i] for i in order.tolist()]
    same = np.zeros(len(order), bool)
    same[1:] = (gram[1:] == gram[:-1]) & (k[1:] == k[:-1]) & (sub[1:] == sub[:-1]) & (first[1:] == first[:-1])
    seen: dict[bytes, int] = {}
    whole, reps = [], []
    for i, c in enumerate(content):
        if same[i]:  # a repeated row, not a repeated run
            continue
        j = seen.setdefault(c, i)
        if j == i or (kind.by_document and k[i] == k[j] and sub[i] == sub[j]):
            reps.append(i)
        else:
            whole.append(i)
    reps = np.array(reps, np.int64)
    new = np.ones(len(reps), bool)
    new[1:] = gram[reps[1:]] != gram[reps[:-1]]
    name = np.cumsum(new) - 1
    several = np.bincount(name, minlength=1)[name] > 1 if len(reps) else np.zeros(0, bool)
    reps, name = reps[several], name[several]
    out = [(np.array(whole, np.int64), first[np.array(whole, np.int64)], np.array([-1] * len(whole), np.int64))]
    if len(reps):
        owner, place, cls = _group_windows(kind, [content[i] for i in reps.tolist()], name)
        at = np.flatnonzero(cls >= 0)
        by = at[np.argsort(cls[at], kind="stable")]  # within a class in the order of documents and places
        head = np.ones(len(by), bool)
        head[1:] = cls[by[1:]] != cls[by[:-1]]
        leader = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
        if kind.by_document:
            a, z = reps[owner[by]], reps[owner[leader]]
            gone = by[(k[a] != k[z]) | (sub[a] != sub[z])]
        else:
            gone = by[~head]
        gone = np.sort(gone)
        if len(gone):
            start = np.ones(len(gone), bool)
            start[1:] = (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])
            edge = np.flatnonzero(start)
            size = np.diff(np.append(edge, len(gone)))
            row = reps[owner[gone[edge]]]
            out.append((row, first[row] + place[gone[edge]], size))
    row, begin, size = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[row], begin, size


def between(rows: np.ndarray, low: np.ndarray, high: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of what the ranges (row, begin, end), which don't overlap, leave of low to high of the rows."""
    r = np.concatenate([rows, row, rows])
    a, z = np.concatenate([low[rows], begin, high[rows]]), np.concatenate([low[rows], end, high[rows]])
    # a row's own begin comes before and its end after the ranges that touch them
    order = np.lexsort((np.repeat([0, 1, 2], [len(rows), len(row), len(rows)]), a, r))
    r, a, z = r[order], a[order], z[order]
    free = np.flatnonzero((r[1:] == r[:-1]) & (a[1:] > z[:-1]))
    return r[free], z[free], a[free + 1]


def _buckets(kind: Kind) -> Callable:
    def done(b: pa.Table) -> pa.RecordBatch:
        gram, k, sub, first, n, merged = (b.column(c).to_numpy() for c in ("gram", "k", "sub", "first", "n", "merged"))
        row, begin, size = repeated_in_buckets(kind, gram, k, sub, first, b.column("content").to_pylist())
        size = np.where(size < 0, n[row], size)
        what = np.full(len(row), RANGE)
        if merged.any():  # what is left of merged runs, instead
            own = merged[row]
            r, a, z = between(np.flatnonzero(merged), first, first + n, row[own], begin[own], (begin + size)[own])
            row, begin, size = (np.concatenate([x[~own], y]) for x, y in ((row, r), (begin, a), (size, z - a)))
            what = np.concatenate([what[~own], np.full(len(r), KEPT)])
        return pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(sub[row]), pa.array(begin << SIZE + 2 | size << 2 | what)], ["k", "sub", "said"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (x for batch in batches for x in slices(batch, "content", HELD // 4)):
            gram = b.column("gram").to_numpy(zero_copy_only=False)
            if held and sum(x.column("content").nbytes for x in (*held, b)) > HELD:
                edge = np.flatnonzero(gram[1:] != gram[:-1])
                before = held[-1].column("gram")[held[-1].num_rows - 1].as_py()
                to = 0 if gram[0] != before else (int(edge[0]) + 1 if len(edge) else None)
                if to is not None:
                    yield done(pa.Table.from_batches([*held, b.slice(0, to)] if to else held))
                    held, b = [], b.slice(to)
            held.append(b)
        if held and sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    return run


def _anchored(kind: Kind) -> Callable:
    """Runs with the place of their gram (off), the first in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "content", 300_000):
                tokens, at, _, _ = kind.tokens(*utf8(b.column("content")))
                gram = b.column("gram").to_numpy(zero_copy_only=False).view(U)
                hashed = gram_hash(tokens, kind.gram, not kind.words)
                hit = np.flatnonzero(hashed == np.repeat(gram, np.diff(at))[: len(hashed)])
                off = hit[np.searchsorted(hit, at[:-1])] - at[:-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(off)], [*b.schema.names, "off"])

    return run


def _split(kind: Kind, known: int, half: int) -> Callable:
    """Runs whose windows share `known` tokens, from off on, to parts whose windows share half more.

    A window that has half tokens or more before those goes by them, the others by the half after them: they have as many
    there, as half is half of what is left of a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "content", 300_000):
                tokens, at, begin, end = kind.tokens(*utf8(b.column("content")))
                digit = gram_hash(tokens, half, not kind.words)
                raw = utf8(b.column("content"))[0].tobytes()
                gram, k, sub, first, n, off = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "k", "sub", "first", "n", "off"))
                out = []
                for side in (0, 1):
                    low = np.zeros(len(n), np.int64) if side == 0 else np.maximum(0, off - half + 1)
                    high = np.minimum(n, off - half + 1) if side == 0 else n
                    i = np.flatnonzero(low < high)
                    low, high = low[i], high[i]
                    place = at[i] + (off[i] - half if side == 0 else off[i] + known)
                    key = mix(gram[i].view(U) * U(0x9FB21C651E98DF25) + digit[place] + U(side)).view(np.int64)
                    lo, hi = begin[at[i] + low], end[at[i] + high + kind.length - 2]
                    pieces = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    out.append([pa.array(key), pa.array(pieces, pa.binary()), *map(pa.array, (k[i], sub[i], first[i] + low, high - low, off[i] - low - (half if side == 0 else 0)))])
                yield from (pa.RecordBatch.from_arrays(x, [c.split()[0] for c in SPLIT.split(", ")]) for x in out)

    return run


def _narrow(merged: DataFrame, kind: Kind) -> list[DataFrame]:
    """Different runs in buckets of up to WIDE of them; wider ones split until they are that small."""

    def wide_of(rows: DataFrame) -> DataFrame:  # few: one for every WIDE different runs at most
        return cut(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > WIDE).select("gram"))

    wide, known = wide_of(merged), kind.gram
    out = [merged.join(wide, "gram", "left_anti")]
    if wide.isEmpty():
        return out
    rows = merged.join(wide, "gram", "left_semi").mapInArrow(_anchored(kind), SPLIT)
    while known < kind.length:
        half = -(-(kind.length - known) // 2)
        parts = rows.mapInArrow(_split(kind, known, half), SPLIT).groupBy("gram", "content")
        parts = cut(parts.agg(F.min(F.struct("k", "sub", "first")).alias("o"), F.first("n").alias("n"), F.first("off").alias("off")).select("gram", "content", "o.*", "n", "off"))
        known += half
        if known == kind.length:  # all windows of a bucket are equal, and so one
            out.append(parts.drop("off"))
            break
        wide = wide_of(parts)
        out.append(parts.drop("off").join(wide, "gram", "left_anti"))
        if wide.isEmpty():
            break
        rows = parts.join(wide, "gram", "left_semi")
    return out


def copies(rows: DataFrame) -> DataFrame:
    """(k, sub) of the documents whose whole text a smaller document has, by two hashes of it."""
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    hashed = rows.select("k", "sub", one.alias("h1"), two.alias("h2"))
    # written before it is joined, so that Spark can split the join where one text is very common
    least = cut(hashed.groupBy("h1", "h2").agg(F.min(F.struct("k", "sub")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "o"))
    return cut(hashed.join(least, ["h1", "h2"]).where(F.struct("k", "sub") != F.col("o")).select("k", "sub").distinct())


def redundant_windows(docs: DataFrame, kind: Kind, carry: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (with carry as rest), and (k, sub, said) for those with windows that may be redundant.

    said holds start << SIZE + 2 | size << 2 | what: RANGE for redundant windows, HOT_RUN for merged runs, whose windows are
    redundant unless they are KEPT or (by_document) equal to one that is. A copy of a whole text needs no look at its
    windows: its said is [COPY].
    """
    rows = keyed(docs, carry)
    again = copies(rows)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.select("text", "k", "sub").mapInArrow(_emit(kind), "gram long, k long, sub long, run long")
    counts = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # grams with more than a thousandth of these runs are a thousand at most: they are sent to the runs, which then
    # needn't meet in one task by gram
    bound = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(counts.where(F.col("n") > bound).select("gram", F.lit(True).alias("heavy")))
    light = counts.where(F.col("n") <= bound).select(F.col("gram").alias("of"), "n")
    key = F.when(F.col("heavy"), F.xxhash64("k", "run")).otherwise(F.col("gram"))
    dealt = runs.join(heavy, "gram", "left").withColumn("of", key)
    repeated = dealt.join(light, "of", "left").where("heavy or n is not null").select("gram", "k", "sub", "run", (F.col("heavy").isNotNull() | (F.col("n") > HOT)).alias("hot"))
    # two long arrays, gram and run in turn: runs of a document have different places
    told = repeated.select("k", "sub", "hot", F.array("gram", "run").alias("r"))
    each = lambda hot: F.flatten(F.collect_list(F.when(F.col("hot") == hot, F.col("r"))))
    # only here, where no text has to be exchanged for it, copies of whole texts leave
    found = written(told.groupBy("k", "sub").agg(each(False).alias("cold"), each(True).alias("hot")).join(again, ["k", "sub"], "left_anti"))

    def packed(kept: str) -> DataFrame:
        own = found.where(F.size(kept) > 0).select("k", "sub", F.col(kept).alias("runs"))
        return rows.select("text", "k", "sub").join(own, ["k", "sub"]).mapInArrow(_texts(kind), RUN)

    merged = packed("hot").groupBy("gram", "content").agg(F.min(F.struct("k", "sub", "first")).alias("o"), F.first("n").alias("n"))
    merged = written(merged.select("gram", "content", "o.*", "n"))
    some = packed("cold").withColumn("merged", F.lit(False))
    for part in _narrow(merged, kind):
        some = some.unionByName(part.withColumn("merged", F.lit(True)))
    ranges = some.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_buckets(kind), "k long, sub long, said long")
    hot_runs = found.select("k", "sub", F.posexplode("hot").alias("i", "run")).where("i % 2 = 1").select("k", "sub", (F.col("run") * 4 + HOT_RUN).alias("said"))
    every = ranges.unionByName(hot_runs).unionByName(again.withColumn("said", F.lit(COPY).cast("long")))
    free_shuffles(docs.sparkSession)
    return rows, every.groupBy("k", "sub").agg(F.collect_list("said").alias("said"))


def digits(kind: Kind, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digits of every window: the hashes of its first and of its last half."""
    half = -(-kind.length // 2)
    n = max(0, len(tokens) - kind.length + 1)
    hashed = gram_hash(tokens, half, not kind.words)
    return hashed[:n], hashed[kind.length - half :][:n]


def name(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for both digits."""
    return mix(first * U(0x9FB21C651E98DF25) + last)


def redundant(kind: Kind, n: int, said: np.ndarray, tokens: Callable[[], np.ndarray]) -> np.ndarray:
    """Which of a document's n windows are redundant. tokens: gives the values of its tokens, where they are needed."""
    if len(said) == 1 and said[0] == COPY:
        return np.ones(max(0, n), bool)
    start, size, what = said >> SIZE + 2, said >> 2 & MOST, said & 3

    def marked(kind_of: int) -> np.ndarray:
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, start[what == kind_of], 1)
        np.add.at(marks, (start + size)[what == kind_of], -1)
        return np.cumsum(marks)[:n] > 0

    hot, kept = marked(HOT_RUN), marked(KEPT)
    if kind.by_document and kept.any():  # the document's other windows that are equal to those are no copies either
        own = name(*digits(kind, tokens()))
        kept |= np.isin(own, own[kept])
    return marked(RANGE) | (hot & ~kept)


def covered(gone: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n tokens a redundant window covers."""
    marks = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(gone)
    marks[at] += 1
    np.subtract.at(marks, at + length, 1)
    return np.cumsum(marks)[:n] > 0
