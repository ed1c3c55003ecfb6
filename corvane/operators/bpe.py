"""Byte-pair vocabularies over whole corpora: training, encoding and decoding with control tokens."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, scratch, written
from ..session import ship
from .training import BYTE_OFFSET, SPECIAL

#: Bytes of text in a block of the training state; rounds after which the state is written anew.
BLOCK, CUT_EVERY = 4_000_000, 24
#: Bytes of texts that a task works on at once; different runs of tokens that it adds up; by what numbers fall in a stage.
SLICE, HELD, FALL = 1_000_000, 400_000, 4
#: Pairs of ids that are counted in an array of their own size; more are sorted.
DENSE = 1 << 22
#: Merges in a batch that are looked for one by one, which is faster than by a table of ids.
SINGLY = 6
FIRST_MERGE = BYTE_OFFSET + 256
_LOW = (1 << 32) - 1
Merges = list[tuple[int, int, int]]


def _joined(texts: list[bytes]) -> np.ndarray:
    """Byte tokens of texts with -1 between and around them."""
    if not texts:
        return np.full(1, -1, np.int32)
    out = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + BYTE_OFFSET
    out[np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])] = -1
    return out


def _alternate(at: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """Of places in order, each run of adjacent ones keeps every second, the first included: pairs are merged from the left."""
    if not len(at) or not adjacent.any():
        return at
    head = np.concatenate([[True], ~adjacent])
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    return at[rank % 2 == 0]


def merge(tokens: np.ndarray, batch: Merges, size: int) -> np.ndarray:
    """tokens with pairs that share no token merged at once."""
    partner, new = np.full(size + 1, -2, np.int32), np.zeros(size + 1, np.int32)  # the last entry is that of -1
    for left, right, z in batch:
        partner[left], new[left] = right, z
    if len(batch) <= SINGLY:
        hit = np.zeros(len(tokens) - 1, bool)
        for left, right, _ in batch:
            hit |= (tokens[:-1] == left) & (tokens[1:] == right)
    else:
        hit = partner[tokens[:-1]] == tokens[1:]
    at = np.flatnonzero(hit)
    at = _alternate(at, np.diff(at) == 1)
    out, keep = tokens.copy(), np.ones(len(tokens), bool)
    out[at], keep[at + 1] = new[tokens[at]], False
    return out[keep]


def touching(tokens: np.ndarray, asked: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with a token that is asked for (by id; the last entry is that of -1), how often they occur and where first.

    copies: how often each text occurs; the n-th stands after the n-th -1.
    """
    left, right = tokens[:-1], tokens[1:]
    few = np.flatnonzero(asked[:-1])
    if len(few) <= 3 * SINGLY:
        told = np.zeros(len(tokens), bool)
        for token in few:
            told |= tokens == token
    else:
        told = asked[tokens]
    at = np.flatnonzero((told[:-1] | told[1:]) & (left >= 0) & (right >= 0))
    size = len(asked)
    if size * size <= DENSE:  # counted in place, without a sort
        code = left[at].astype(np.int64) * size + right[at]
        weights = None if copies.max(initial=1) == 1 else copies[np.searchsorted(np.flatnonzero(tokens < 0), at) - 1]
        n, place = np.bincount(code, weights, size * size), np.zeros(size * size, np.int64)
        place[code[::-1]] = at[::-1]  # of several the last one stays, which is the first place
        found = np.flatnonzero(n)
        return found // size << 32 | found % size, n[found].astype(np.int64), place[found]
    code = left[at].astype(np.int64) << 32 | right[at]
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    if copies.max(initial=1) == 1:
        n = np.diff(np.concatenate([first, [len(code)]]))
    else:
        n = np.add.reduceat(copies[np.searchsorted(np.flatnonzero(tokens < 0), at) - 1], first) if len(first) else first
    return code[first], n, at[first]


def _places(tokens: np.ndarray, asked: np.ndarray, copies: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """touching(), and the text and the byte in it of each first place; bytes don't change when pairs are merged."""
    pair, n, at = touching(tokens, asked, copies)
    bounds = np.flatnonzero(tokens < 0)
    text = np.searchsorted(bounds, at) - 1
    if (at - bounds[text]).sum() <= len(tokens):
        byte = np.array([sizes[tokens[lo:hi]].sum() for lo, hi in zip(bounds[text] + 1, at)], np.int64)
    else:
        end = np.cumsum(sizes.astype(np.int32)[tokens], dtype=np.int64)  # a bound's size is the last entry, 0
        byte = end[at] - sizes[tokens[at]] - end[bounds[text]]
    return pair, n, at, text, byte


_STATE = "tokens binary, doc array<long>, sub array<long>, byte array<long>, copies array<long>"
_STATS = "pair array<long>, n array<long>, doc_at array<long>, sub_at array<long>, byte_at array<long>"
_LONGS = pa.list_(pa.int64())


def _round(state: DataFrame, batch: Merges, sizes: np.ndarray, asked: np.ndarray) -> DataFrame:
    """The state after a batch, and what its pairs with the asked tokens now are."""
    kind, kept = _kind(len(sizes)), ["doc", "sub", "byte", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):  # one block at a time in memory
                tokens = np.frombuffer(row.column("tokens")[0].as_buffer(), kind)
                doc, sub, start, copies = (row.column(k)[0].values.to_numpy() for k in kept)
                tokens = merge(tokens, batch, len(sizes)) if batch else tokens
                pair, n, _, text, byte = _places(tokens, asked, copies, sizes)
                stats = [pa.array([x], _LONGS) for x in (pair, n, doc[text], sub[text], start[text] + byte)]
                yield pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary()), *[row.column(k) for k in kept], *stats], schema=schema)

    schema = pa.schema([("tokens", pa.binary()), *[(x, _LONGS) for x in (*kept, "pair", "n", "doc_at", "sub_at", "byte_at")]])
    return state.mapInArrow(run, f"{_STATE}, {_STATS}")


def _kind(size: int) -> type:
    """What tokens are kept as: two bytes, where all ids fit."""
    return np.int16 if size < 1 << 15 else np.int32


def _base(docs: DataFrame) -> DataFrame:
    """doc, sub, tokens of the texts: their place in order of doc_id, null first, and their bytes."""
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc")
    return docs.where("text <> ''").select(doc, F.xxhash64("text").alias("sub"), F.encode("text", "UTF-8").alias("tokens"))


def _slices(batches: Iterator[pa.RecordBatch], kind: type | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc, sub and tokens (-1 between and around texts) of rows in order of place, SLICE bytes at once or one text.

    kind: what the tokens are kept as; None for the bytes of texts.
    """
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column("tokens")).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            doc, sub = part.column("doc").to_numpy(), part.column("sub").to_numpy()
            order = np.lexsort((sub, doc))
            texts = part.column("tokens").take(pa.array(order)).to_pylist()
            if kind is None:
                tokens = _joined(texts).astype(np.int16)
            else:
                bound = np.full(1, -1, kind).tobytes()
                tokens = np.frombuffer(bound + bound.join(texts) + bound, kind)
            yield doc[order], sub[order], tokens


def _among(tokens: np.ndarray, pairs: np.ndarray, size: int) -> np.ndarray:
    """Where a token and the next one are one of pairs, which are in order."""
    left, right = tokens[:-1], tokens[1:]
    if size * size <= DENSE:
        told = np.zeros((size, size), bool)
        told[pairs >> 32, pairs & _LOW] = True
        return told.ravel()[left.astype(np.int32) * size + right]  # -1 leads to the last row or column, which has none
    code = left.astype(np.int64) << 32 | right
    return pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code if len(pairs) else np.zeros(len(code), bool)


def _runs(tokens: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """First place and length of each run of linked tokens, and the runs' tokens, different ones in order of occurrence."""
    edge = np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    inside = np.zeros(len(tokens), bool)
    inside[:-1] |= linked
    inside[1:] |= linked
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32) * tokens.itemsize
    held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(tokens[inside])])
    return first, end - first, held.dictionary_encode()


def _summed_up(seg: pa.Array, columns: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    """Different runs with their first place (doc, sub, byte) and number."""
    order = np.lexsort(columns[2::-1])
    told, (doc, sub, byte, n) = seg.take(pa.array(order)).dictionary_encode(), (x[order] for x in columns)
    code = told.indices.to_numpy()
    first = np.zeros(len(told.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]  # of several the last one stays, which is the first place
    return told.dictionary, [doc[first], sub[first], byte[first], np.bincount(code, n, len(first)).astype(np.int64)]


def _segments(base: DataFrame, kind: type | None, hot: np.ndarray, sizes: np.ndarray, out: type) -> DataFrame:
    """seg, n, doc, sub, byte: different runs of tokens that hot pairs link, how often they occur and where first."""
    size, names = len(sizes), ["doc", "sub", "byte", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for doc, sub, tokens in _slices(batches, kind):
            first, _, told = _runs(tokens.astype(out), _among(tokens, hot, size))
            code, bounds = told.indices.to_numpy(), np.flatnonzero(tokens < 0)
            at = np.zeros(len(told.dictionary), np.int64)
            at[code[::-1]] = first[::-1]
            text, ends = np.searchsorted(bounds, at) - 1, np.cumsum(sizes[tokens])
            byte = ends[at] - sizes[tokens[at]] - ends[bounds[text]]
            held.append((told.dictionary, [doc[text], sub[text], byte, np.bincount(code, minlength=len(at))]))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_summed_up(pa.concat_arrays([x[0] for x in held]), [np.concatenate(c) for c in zip(*(x[1] for x in held))])]
                if len(held[0][0]) > HELD // 2:
                    yield from rows(held)
                    held = []
        if held:
            yield from rows([_summed_up(pa.concat_arrays([x[0] for x in held]), [np.concatenate(c) for c in zip(*(x[1] for x in held))])])

    def rows(held: list) -> Iterator[pa.RecordBatch]:
        (seg, columns), = held
        whole = pa.RecordBatch.from_arrays([seg, *[pa.array(c, pa.int64()) for c in columns]], ["seg", *names])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    each = base.mapInArrow(run, "seg binary, doc long, sub long, byte long, n long")
    return each.groupBy("seg").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "sub", "byte")).alias("at")).select("seg", "n", "at.*")


def _blocks(docs: DataFrame, kind: type) -> DataFrame:
    """The training state of whole texts: equal ones once."""
    each = _base(docs).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sub")).alias("at"))
    return _packed(each.select(F.col("tokens").alias("seg"), "n", "at.doc", "at.sub", F.lit(0).cast("long").alias("byte")), kind, True)


def _packed(segments: DataFrame, kind: type, plain: bool = False) -> DataFrame:
    """The training state: runs of tokens in order of first occurrence in blocks. plain: the runs are bytes of texts."""
    segments = written(segments, "bpe")
    size = segments.agg(F.sum(F.octet_length("seg") + 32)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used = np.cumsum(pc.binary_length(b.column("seg")).to_numpy() + 32)
            cuts = [0, *(np.flatnonzero(np.diff(used // BLOCK)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield block(b.slice(lo, hi - lo))

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, bound = rows.column("seg").to_pylist(), np.full(1, -1, kind).tobytes()
        tokens = _joined(texts).astype(kind).tobytes() if plain else bound + bound.join(texts) + bound
        lists = [pa.array([rows.column(k).to_numpy()], _LONGS) for k in ("doc", "sub", "byte", "n")]
        return pa.RecordBatch.from_arrays([pa.array([tokens], pa.binary()), *lists], ["tokens", "doc", "sub", "byte", "copies"])

    parts = max(min(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 250_000), size // BLOCK, 1)
    return written(segments.repartition(parts).sortWithinPartitions("doc", "sub", "byte").mapInArrow(run, _STATE), "bpe")


def _merged(tokens: np.ndarray, encoder: Encoder, links: np.ndarray, size: int) -> np.ndarray:
    """tokens with the encoder's merges, which only happen within runs that links make: different runs are merged once."""
    first, length, told = _runs(tokens, _among(tokens, links, size))
    if not len(first):
        return tokens
    bound, code = np.full(1, -1, tokens.dtype).tobytes(), told.indices.to_numpy()
    new = encoder.merged(np.frombuffer(bound + bound.join(told.dictionary.to_pylist()) + bound, tokens.dtype).astype(np.int32))
    start = np.flatnonzero(new < 0)[:-1] + 1
    size_of = np.diff(np.flatnonzero(new < 0)) - 1
    count = np.ones(len(tokens), np.int32)  # what each place makes: a run's first one makes all of it, the others none
    inside = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    count[inside], count[first] = 0, size_of[code]
    out, alone = np.empty(count.sum(), tokens.dtype), np.ones(len(tokens), bool)
    ends, alone[inside] = np.cumsum(count), False
    out[ends[alone] - 1] = tokens[alone]
    made = size_of[code]
    within = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    out[np.repeat(ends[first] - made, made) + within] = new[np.repeat(start[code], made) + within]
    return out


def _links(merges: Merges) -> np.ndarray:
    """The pairs of tokens known before merges that these make one token of."""
    first, last = {}, {}
    for left, right, new in merges:
        first[new], last[new] = first.get(left, left), last.get(right, right)
    return np.unique(np.array([last.get(left, left) << 32 | first.get(right, right) for left, right, _ in merges], np.int64))


def _counted(base: DataFrame, kind: type | None, merges: Merges, size: int) -> DataFrame:
    """doc, sub, tokens after merges; and rows without them that have the numbers of pairs (pair, n). Without merges only these."""
    out = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, links = Encoder(merges), _links(merges)
        dense = np.zeros(size * size, np.int64) if size * size <= DENSE else None
        for doc, sub, tokens in _slices(batches, kind):
            tokens = tokens.astype(out)
            if merges:
                tokens = _merged(tokens, encoder, links, size)
                bounds = np.flatnonzero(tokens < 0)
                offsets = np.concatenate([[0], np.cumsum(np.diff(bounds) - 1)]).astype(np.int32) * tokens.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(tokens[tokens >= 0])])
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sub), held, none, none], names)
            within = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
            if dense is None:
                code, n = np.unique((tokens[:-1].astype(np.int64) << 32 | tokens[1:])[within], return_counts=True)
                yield stats(code, n)
            else:
                dense += np.bincount((tokens[:-1].astype(np.int32) * size + tokens[1:])[within], minlength=size * size)
        if dense is not None:
            code = np.flatnonzero(dense)
            yield stats(code // size << 32 | code % size, dense[code])

    def stats(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(code), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(code), pa.binary()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names)

    names = ["doc", "sub", "tokens", "pair", "n"]
    return base.mapInArrow(run, "doc long, sub long, tokens binary, pair long, n long")


class _Pairs:
    """All pairs with their counts and first places, by how they are merged next: bounded by the vocabulary, not the corpus."""

    def __init__(self) -> None:
        self.known: dict[int, tuple] = {}
        self.of: defaultdict[int, set[int]] = defaultdict(set)
        self.heap: list[tuple] = []

    def renew(self, tokens: list[int], rows: list[tuple]) -> None:
        """Forget the pairs of tokens; rows (key, pair) has those that there are now."""
        for t in tokens:
            for pair in self.of.pop(t, ()):
                self.known.pop(pair, None)
        for key, pair in rows:
            self.known[pair] = key
            self.of[pair >> 32].add(pair)
            self.of[pair & _LOW].add(pair)
            heapq.heappush(self.heap, (key, pair))

    def batch(self, most: int, least: int) -> list[tuple[int, int]]:
        """The next pairs with their counts, as long as none of them can change what is next.

        Merging a pair only changes pairs that share a token with it, and what it makes is no more frequent than one of
        those. So pairs may be merged together until the first in order that shares a token with those before. A token
        paired with itself ends a batch, as runs of it make pairs of the new token.
        """
        out: list[tuple[int, int]] = []
        used: set[int] = set()
        while self.heap and len(out) < most:
            key, pair = self.heap[0]
            if self.known.get(pair) != key:
                heapq.heappop(self.heap)
                continue
            left, right = pair >> 32, pair & _LOW
            if -key[0] < least or left in used or right in used:
                break
            heapq.heappop(self.heap)
            out.append((pair, -key[0]))
            used |= {left, right}
            if left == right:
                break
        return out


def _chosen(pairs: _Pairs, out: list[tuple], sizes: np.ndarray, most: int, least: int) -> tuple[Merges, np.ndarray]:
    """The next merges, which are added to out, and the tokens whose pairs they change."""
    batch = []
    for pair, n in pairs.batch(most - len(out), least):
        left, right, new = pair >> 32, pair & _LOW, FIRST_MERGE + len(out)
        sizes[new] = sizes[left] + sizes[right]
        out.append((len(out), left, right, new, n))
        batch.append((left, right, new))
    asked = np.zeros(len(sizes), bool)
    asked[[t for m in batch for t in m]] = True
    return batch, asked


def _summed(now: DataFrame) -> list[tuple]:
    entries = now.select(F.explode(F.arrays_zip("pair", "n", "doc_at", "sub_at", "byte_at")).alias("e")).select("e.*")
    sums = entries.groupBy("pair").agg(F.sum("n").alias("n"), F.min(F.struct("doc_at", "sub_at", "byte_at")).alias("at"))
    return [((-r["n"], *r["at"]), r["pair"]) for r in sums.collect()]


def train(docs: DataFrame, vocabulary: int = 4096, least: int = 2) -> DataFrame:
    """rank, left, right, new_id, n of the merges that make a vocabulary: the most frequent pair, again and again.

    Pairs lie within texts (doc_id, text), over whole texts; equally frequent ones go by which comes first in order of doc_id.
    Null and empty texts have none.

    A merge never makes a pair more frequent than what stood at its place before, so that two tokens whose pair is rarer than
    some bound stay apart until the most frequent pair is rarer too. A stage counts all pairs, takes a bound of a part of the
    greatest number, cuts the texts where pairs are rarer, and keeps different runs once, with their number and first place:
    few, as runs are short. Merges down to the bound are made on these; then the next stage applies them to the texts. No
    stage holds more of the texts than a slice in a task.
    """
    spark = ship(docs.sparkSession)
    if vocabulary < FIRST_MERGE:
        raise ValueError("the vocabulary is smaller than the byte vocabulary")
    most, out = vocabulary - FIRST_MERGE, []
    sizes = np.zeros(vocabulary + 1, np.int64)
    sizes[BYTE_OFFSET:FIRST_MERGE] = 1
    size = len(sizes)
    base, kind, made, old = _base(docs), None, 0, None
    while len(out) < most:
        path = scratch(spark, "bpe")
        fresh = [m[1:4] for m in out[made:]]
        _counted(base, kind, fresh, size).write.parquet(path)
        if old:
            discard(spark, old)
        held = spark.read.parquet(path)
        n = written(held.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "bpe")
        if fresh:
            base, kind, made, old = held.where("tokens is not null").select("doc", "sub", "tokens"), _kind(size), len(out), path
        whole, top = n.agg(F.sum("n"), F.max("n")).first()
        if (top or 0) < least:
            break
        if whole <= BLOCK and not out:
            _stage(_blocks(docs, _kind(size)), out, sizes, most, least)
            break
        bound = max(least, top // FALL)
        hot = np.array(sorted(r["pair"] for r in n.where(F.col("n") >= bound).select("pair").collect()), np.int64)
        _stage(_packed(_segments(base, kind, hot, sizes, _kind(size)), _kind(size)), out, sizes, most, bound)
    if old:
        discard(spark, old)
    return spark.createDataFrame(out, "rank long, left long, right long, new_id long, n long")


def _stage(state: DataFrame, out: list[tuple], sizes: np.ndarray, most: int, least: int) -> None:
    """Adds the merges of pairs that occur least times to out.

    Merged runs stay with the tasks, on disk; a round, which is one job, merges all pairs whose order is certain, counts only
    pairs that have a token of theirs, and takes those sums to the driver. A lost executor's runs are made again from the
    last table written.
    """
    held, pairs, turn, batch, asked = None, _Pairs(), 0, [], np.ones(len(sizes), bool)
    while len(out) < most:
        now = _round(state, batch, sizes, asked).persist(StorageLevel.DISK_ONLY)
        pairs.renew([t for m in batch for t in m], _summed(now))
        if held is not None:
            held.unpersist()
        held, turn = now, turn + 1
        batch, asked = _chosen(pairs, out, sizes, most, least)
        if not batch:
            break
        state = now.select("tokens", "doc", "sub", "byte", "copies")
        state = state if turn % CUT_EVERY else written(state, "bpe")
    if held is not None:
        held.unpersist()


def merges_of(merges: DataFrame) -> Merges:
    """left, right, new_id in order of rank: a vocabulary's worth of rows."""
    out = [(r["left"], r["right"], r["new_id"]) for r in merges.orderBy("rank").collect()]
    known = set(range(BYTE_OFFSET, FIRST_MERGE))
    for left, right, new in out:
        if left not in known or right not in known:
            raise ValueError("a merge is of an unknown token")
        known.add(new)
    return out


class Encoder:
    """Ids of texts by merges: of all pairs in a text the one of least rank is merged everywhere, until there is none."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        code = np.array([left << 32 | right for left, right, _ in merges], np.int64)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(SPECIAL, key=len))) + ")")
        self.control = {x: i for i, x in enumerate(SPECIAL)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        none = len(self.code)
        if not none:
            return np.zeros(len(left), np.int64)
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.code, code), none - 1)
        return np.where((self.code[at] == code) & (left >= 0), self.order[at], none)

    def base(self, texts: list[str], allow_special: bool) -> np.ndarray:
        """Byte tokens with -1 around texts; control tokens as one token, if allowed."""
        if not allow_special or not any("<|" in t for t in texts):
            return _joined([t.encode() for t in texts])
        parts: list[list[int]] = [[-1]]
        for t in texts:
            parts += [[self.control[x]] if x in self.control else [BYTE_OFFSET + b for b in x.encode()] for x in self.split.split(t) if x]
            parts.append([-1])
        return np.array([i for p in parts for i in p], np.int32)

    def __call__(self, texts: list[str], allow_special: bool = True) -> list[np.ndarray]:
        token = self.merged(self.base(texts, allow_special))
        return np.split(token[token >= 0], np.cumsum(np.diff(np.flatnonzero(token < 0)) - 1)[:-1]) if texts else []

    def merged(self, token: np.ndarray) -> np.ndarray:
        """Merges rank by rank over all texts (-1 between and around) at once; each place is looked at when its pair's rank comes up."""
        n, none = len(token), len(self.merges)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = self.ranks(token[:-1], token[1:])
        places = np.argsort(rank, kind="stable")
        start = np.searchsorted(rank[places], np.arange(none + 1))
        later: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        for r, (left, right, new) in enumerate(self.merges):
            at = places[start[r] : start[r + 1]]
            more = later.pop(r, None)
            if more:
                at = np.unique(np.concatenate([at, *more]))
            if not len(at):
                continue
            at = at[token[at] == left]
            at = at[token[after[at]] == right]
            if left == right:
                at = _alternate(at, after[at[:-1]] == at[1:])
            if not len(at):
                continue
            gone = after[at]
            token[at], token[gone] = new, -2
            after[at] = after[gone]
            before[after[at]] = at
            fresh = np.concatenate([before[at], at])  # text bounds stand on both sides
            found = self.ranks(token[fresh], token[after[fresh]])
            fresh, found = fresh[found < none], found[found < none]
            order = np.argsort(found, kind="stable")
            cuts = np.flatnonzero(np.diff(found[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                later[int(found[part[0]])].append(fresh[part])
        return token[token != -2]


class Decoder:
    """Texts of ids; bytes that aren't UTF-8 become U+FFFD, an unknown id is an error."""

    def __init__(self, merges: Merges) -> None:
        self.bytes = {BYTE_OFFSET + b: bytes([b]) for b in range(256)}
        for left, right, new in merges:
            self.bytes[new] = self.bytes[left] + self.bytes[right]
        each = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.flat, self.size = np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])

    def many(self, lists: pa.ListArray, skip_special: bool = False) -> pa.Array:
        """Texts of lists of ids, the bytes of all at once; one by one where there are control tokens or not whole characters."""
        ids, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = ids.to_numpy(zero_copy_only=False)
        if not ids.null_count and (not len(at) or BYTE_OFFSET <= at.min() and at.max() < len(self.size) and self.size[at].all()):
            size = self.size[at]
            ends = np.cumsum(size)
            source = np.arange(size.sum()) + np.repeat((np.cumsum(self.size) - self.size)[at] - ends + size, size)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat[source])])
            try:
                return pc.if_else(lists.is_valid(), held.cast(pa.string()), pa.scalar(None, pa.string()))
            except pa.ArrowInvalid:
                pass
        return pa.array([None if (x := each.as_py()) is None else self(x, skip_special) for each in lists], pa.string())

    def __call__(self, ids: list[int], skip_special: bool = False) -> str:
        try:
            return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        except KeyError:  # a control token or an unknown one
            pass
        out, run = [], []
        for i in [*ids, None]:
            if i is None or i < BYTE_OFFSET:
                out.append(b"".join(run).decode("utf-8", "replace"))
                run = []
                if i is not None and not skip_special:
                    out.append(SPECIAL[i])
            elif i in self.bytes:
                run.append(self.bytes[i])
            else:
                raise ValueError(f"unknown token {i}")
        return "".join(out)


#: Characters or ids that are encoded or decoded at once, or one text.
AT_ONCE = 500_000


def _parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about AT_ONCE of what sizes count, one row at least."""
    whole = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(whole // AT_ONCE)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def encode(df: DataFrame, merges: DataFrame, text: str = "text", out: str = "ids", add_bos: bool = False, add_eos: bool = False, allow_special: bool = True) -> DataFrame:
    """df with the ids of a text column; a null text has none, but for the begin and end tokens that are asked for.

    allow_special: whether strings of control tokens are those tokens. Texts are whole, and none is split between tasks.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(merges_of(merges))  # a vocabulary's worth
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        first, last = [1] * add_bos, [2] * add_eos
        for b in batches:
            for part in _parts(b, pc.utf8_length(b.column(text))):
                ids = encoder([x or "" for x in part.column(text).to_pylist()], allow_special)
                whole = pa.array([np.concatenate([first, x, last]).astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], whole], [*kept, out])

    shape = df.select(*kept).schema.add(out, T.ArrayType(T.IntegerType()))
    return df.select(*kept).mapInArrow(run, shape)


def decode(df: DataFrame, merges: DataFrame, ids: str = "ids", out: str = "decoded", skip_special: bool = False) -> DataFrame:
    """df with the text of a column of ids; null for null."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(merges_of(merges))
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for b in batches:
            for part in _parts(b, pc.list_value_length(b.column(ids))):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], decoder.many(part.column(ids), skip_special)], [*kept, out])

    return df.select(*kept).mapInArrow(run, df.select(*kept).schema.add(out, T.StringType()))


def save(merges: DataFrame, folder: str) -> None:
    """One JSON text with version, control tokens and merges, as tokenizers of this kind are kept."""
    held = {"version": 1, "special_tokens": SPECIAL, "merges": [list(m) for m in merges_of(merges)]}
    merges.sparkSession.createDataFrame([(json.dumps(held, ensure_ascii=False),)], "value string").coalesce(1).write.text(folder)


def load(spark: SparkSession, path: str) -> DataFrame:
    """rank, left, right, new_id of a saved tokenizer; its control tokens must be the known ones."""
    held = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if held["special_tokens"] != SPECIAL:
        raise ValueError("other control tokens")
    return spark.createDataFrame([(i, *map(int, m)) for i, m in enumerate(held.get("merges", []))], "rank long, left long, right long, new_id long")


def round_trip(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """doc_id, n_tokens, same: each text encoded and decoded again, control tokens' strings included."""
    out = decode(encode(docs.select("doc_id", "text"), merges), merges)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))
