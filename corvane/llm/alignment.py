"""Alignment of two tokenizers' tokens by the bytes that they cover.

A worker tokenises and aligns each word once, many at a time; documents take the groups and links of their words. Counts of id
pairs over the corpus, the best ones and documents' sums are Spark's aggregates and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, slices, written

#: Where the vocabulary files are; read by the driver and sent to the tasks, about 2 MB whatever the corpus.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Unbroken runs beyond this go to the tokenizer whose time doesn't grow with their square.
LONG_RUN = 2000
#: Words' tokens that a worker remembers at a time, of half as many words at most.
MEMO = 1_000_000
#: Id pairs that hold over 1 / COMMON of all links' documents are sent to the tasks, which bounds how many they are.
COMMON = 100_000
#: Bytes of text whose words are numbered, and whose new ones are aligned, together.
SLICE = 1_500_000
#: Words that are tokenised in one text; in longer ones the queue of merges gets slow.
TOGETHER = 64
#: Texts whose words, each with the space before it, may depend on each other: runs of blanks across a space that begins a
#: word, and white space other than that and line ends, which is part of pieces.
ODD = r"^ |  | $|\n \n|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}▁]"
#: Tokens of a slice's different words, one word after the other; a_last: the token of A ends a word; at: the words of a document, by their places.
_DOC = T.StructType([T.StructField(x, T.LongType()) for x in ("rid", "doc_id", "n_a", "n_b")] + [T.StructField("at", T.ArrayType(T.IntegerType()))])
# lists without nulls: Spark sorts such numbers as they are
ALIGNED = T.StructType([*_DOC.fields[:4], T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType(), False))])
SCHEMA = T.StructType([T.StructField(x, T.ArrayType(T.BooleanType() if x == "a_last" else T.IntegerType(), False)) for x in ("a_ids", "a_ends", "a_last", "b_ids", "b_ends")] + [T.StructField("docs", T.ArrayType(_DOC))])


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Token ids and token bytes of a byte-level vocabulary file."""

    def __init__(self, raw: bytes) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        model, letter = json.loads(raw), _byte_letters()
        vocab = {bytes(letter[x] for x in t): i for t, i in model["model"]["vocab"].items() if all(x in letter for x in t)}
        special = {x["id"] for x in model.get("added_tokens", [])}
        self.bytes = {i: b for b, i in vocab.items() if i not in special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.slow = Tokenizer.from_str(raw.decode())
        self.slow.encode_special_tokens = True

    def __call__(self, text: str) -> list[int]:
        runs = [len(x) for x in text.split()]
        long = max(runs, default=0) > LONG_RUN or len(text) - sum(runs) - len(runs) > LONG_RUN
        return self.slow.encode(text, add_special_tokens=False).ids if long else self.fast.encode_ordinary(text)


class PieceBPE:
    """Piece ids and piece bytes of a sentencepiece model, which puts a space before each text."""

    def __init__(self, raw: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        # words are independent where no piece goes on after a word's end or beyond a line
        self.by_word = self.model.is_byte(self.model.piece_to_id("<0x0A>")) and not any(re.search("[^▁]▁|\n", p) for p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


def _runs(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some lists one after the other, and where each list's begin (one more than lists); at: where all lists begin."""
    n = at[which + 1] - at[which]
    to = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(at[which] - to[:-1], n) + np.arange(to[-1]), to


class Tokens:
    """Tokens of texts by both vocabularies and their alignment, with a memory of words.

    A word here is a space and what follows up to the next space. Either vocabulary splits it without regard to what is around it,
    but in texts that ODD finds: those are taken as a whole, as one word. A token ends where a word ends, so words are aligned
    by themselves.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        self.a, self.b = ByteBPE(byte_bpe), PieceBPE(piece_bpe)
        self.tables = [[t.bytes.get(i, b"") for i in range(max(t.bytes) + 1)] for t in (self.a, self.b)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in self.tables]
        # how a token is written in a group: after others of its side, and as their first
        self.names = pa.array([f"{first}{i}" for t, mark in zip(self.tables, ";|") for i in range(len(t)) for first in ("," + mark)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.links = np.zeros(0, np.int64)
        self.groups = pa.array([], pa.large_string())
        #: where each word's tokens, by either vocabulary, and its links begin
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def one_by_one(self, side: int, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Tokens of words, how many each has, and whether they are its bytes; none where they aren't."""
        encode: Callable = self.b if side else lambda w: self.a(f" {w}")
        lists = [encode(w) for w in words]
        same = np.array([b"".join([self.tables[side][i] for i in x]) == f" {w}".encode() for w, x in zip(words, lists)], bool)
        lists = [x if ok else [] for x, ok in zip(lists, same)]
        return list(chain.from_iterable(lists)), np.array([len(x) for x in lists], np.int64), same

    def encoded(self, side: int, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """one_by_one(), of many words in a text if its tokens are its bytes. A word that begins with a line end, which might follow another, is alone."""
        ids: list[int] = []
        same, table, at = np.ones(len(words), bool), self.tables[side], 0
        while at < len(words):
            part = words[at : at + TOGETHER]
            if "\n" in (text := " ".join(part)) and (lines := [i for i, w in enumerate(part) if w[:1] == "\n"]):
                part = part[: lines[0] or 1]
                text = " ".join(part)
            got = self.b(text) if side else self.a(f" {text}")
            if b"".join(map(table.__getitem__, got)) != f" {text}".encode():
                got, _, same[at : at + len(part)] = self.one_by_one(side, part)
            ids += got
            at += len(part)
        flat = np.array(ids, np.int32)
        ends = np.cumsum(np.where(same, np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1, 0))
        return flat, np.diff(np.searchsorted(np.cumsum(self.sizes[side][flat]), ends, "right"), prepend=0), same

    def aligned(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Links (an A id and a B id in a long), how many each token of A has, and the names of all tokens by groups, of A's and B's tokens of the same bytes."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a_ids]), np.cumsum(self.sizes[1][b_ids])
        last = np.searchsorted(ends_b, ends_a)  # the token of B in which one of A ends
        shared = ends_b[last] == ends_a
        first = np.concatenate([[0], (last + shared)[:-1]])
        n = last - first + 1
        over = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        links = (np.repeat(a_ids.astype(np.int64), n) << 32) + b_ids[over]
        # each group's tokens of A, then those of B
        shared_b = np.zeros(len(b_ids), bool)
        shared_b[last[shared]] = True
        end_a, end_b = np.flatnonzero(shared) + 1, np.flatnonzero(shared_b) + 1
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        for ids, ends, before, base in ((a_ids, shared, np.concatenate([[0], end_b]), 0), (b_ids, shared_b, end_a, 2 * len(self.tables[0]))):
            begins = np.concatenate([[True], ends[:-1]])
            codes[np.arange(len(ids)) + before[np.cumsum(begins) - 1]] = base + 2 * ids.astype(np.int64) + begins
        return links, n, self.names.take(pa.array(codes))

    def learn(self, words: list[str], coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers under which words' tokens, links and groups are kept; words that either vocabulary doesn't reproduce are marked and have none."""
        same = coded[0][2] & coded[1][2]
        ids, begins = [], []
        for side, (x, n, _) in enumerate(coded):
            ids.append(x[np.repeat(same, n)])
            begins.append(np.concatenate([[0], np.cumsum(np.where(same, n, 0))]))
            self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + begins[side][1:]])
            self.flat[side] = np.concatenate([self.flat[side], ids[side]])
        to, groups = np.zeros(len(words) + 1, np.int64), pa.array([""] * len(words), pa.large_string())
        if same.any():
            links, n, names = self.aligned(*ids)
            to = np.concatenate([[0], np.cumsum(n)])[begins[0]]
            self.links = np.concatenate([self.links, links])
            where = np.frombuffer(names.buffers()[1], np.int64)[begins[0] + begins[1]]
            groups = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(where), names.buffers()[2])
        self.at[2] = np.concatenate([self.at[2], self.at[2][-1] + to[1:]])
        self.groups = pa.concat_arrays([self.groups, groups])
        self.same = np.concatenate([self.same, same])
        return np.arange(len(self.same) - len(words), len(self.same))

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and how many each text has: none if its bytes aren't reproduced."""
        if len(self.flat[0]) > MEMO or len(self.same) > MEMO // 2:  # words that aren't reproduced have no tokens
            self.forget()
        some = pc.greater(pc.binary_length(texts), 0).fill_null(False).to_numpy(zero_copy_only=False)
        odd = some & (pc.match_substring_regex(texts, ODD).fill_null(False).to_numpy(zero_copy_only=False) if self.b.by_word else True)
        # not if_else, which in pyarrow 23 spoils slices of strings
        split = pc.split_pattern(texts.take(pa.array(np.arange(len(texts)), mask=odd | ~some)), " ")
        count = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = list(compress(words, number < 0))
        if new:
            number[number < 0] = kept = self.learn(new, [self.encoded(0, new), self.encoded(1, new)])
            self.known.update(zip(new, kept.tolist()))
        flat = number[coded.indices.to_numpy()]
        if odd.any():
            whole = texts.filter(pa.array(odd)).to_pylist()
            count = np.where(odd, 1, count)
            placed, of_odd = np.empty(count.sum(), np.int64), np.repeat(odd, count)
            placed[~of_odd] = flat
            sides = [self.one_by_one(side, whole) for side in (0, 1)]
            placed[of_odd] = self.learn(whole, [(np.array(x, np.int32), n, same) for x, n, same in sides])
            flat = placed
        owner = np.repeat(np.arange(len(count)), count)
        good = np.bincount(owner[~self.same[flat]], minlength=len(count)) == 0
        return flat[good[owner]], np.where(good, count, 0)

    def of_words(self, side: int, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the words one after the other, where each word's begin (one more than words), and the running ends in bytes."""
        places, to = _runs(self.at[side], flat)
        ids = self.flat[side][places]
        return ids, to, np.cumsum(self.sizes[side][ids])

    def __call__(self, texts: list[str | None]) -> list[tuple[pa.Array, pa.Array]]:
        """Ids, and ends in bytes, of the tokens of a space and each text, by either vocabulary."""
        flat, count = self.numbered(pa.array(texts, pa.string()))
        out = []
        for side in (0, 1):
            ids, to, ends = self.of_words(side, flat)
            at = to[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
            end = np.concatenate([[0], ends])
            ends = (ends - np.repeat(end[at[:-1]], np.diff(at))).astype(np.int32)
            out.append((pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, ends)))
        return out

    def coded(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """One row of SCHEMA for all texts: the tokens of their different words, and the words of each document."""
        flat, count = self.numbered(part.column("text"))
        words, at = np.unique(flat, return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(count)])

        def one(x: np.ndarray | pa.Array, nulls: bool = False) -> pa.Array:
            x = x if isinstance(x, pa.Array) else pa.array(x)
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=pa.list_(pa.field("element", x.type, nulls)))

        columns, many = [], []
        for side in (0, 1):
            ids, to, ends = self.of_words(side, words)
            columns += [one(ids), one(ends.astype(np.int32))]
            if side == 0:
                last = np.zeros(len(ids), bool)
                last[to[1:] - 1] = True
                columns.append(one(last))
            many.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(np.diff(to)[at])])[begin])))
        where = pa.ListArray.from_arrays(begin.astype(np.int32), at.astype(np.int32))
        docs = pa.StructArray.from_arrays([part.column("rid"), part.column("doc_id"), *many, where], ["rid", "doc_id", "n_a", "n_b", "at"])
        return pa.RecordBatch.from_arrays([*columns, one(docs, True)], SCHEMA.names)

    def documents(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of ALIGNED."""
        flat, count = self.numbered(part.column("text"))
        begin = np.concatenate([[0], np.cumsum(count)])
        many = [pa.array(np.diff(np.concatenate([[0], np.cumsum(np.diff(self.at[side])[flat])])[begin])) for side in (0, 1)]
        places, to = _runs(self.at[2], flat)
        links = pa.ListArray.from_arrays(pa.array(to[begin].astype(np.int32)), pa.array(self.links[places]), type=pa.list_(pa.field("element", pa.int64(), False)))
        groups = self.groups.take(pa.array(flat))
        held, where = memoryview(groups.buffers()[2] or b""), np.frombuffer(groups.buffers()[1], np.int64)[begin].tolist() if len(flat) else [0] * len(begin)
        joined = pa.array([bytes(held[x + 1 : y]) for x, y in zip(where, where[1:])], pa.binary()).cast(pa.string())  # without the first ;
        return pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), *many, joined, links], ALIGNED.names)


@lru_cache(1)
def _loaded(byte_bpe: bytes, piece_bpe: bytes) -> Tokens:
    """Kept by a worker from task to task."""
    return Tokens(byte_bpe, piece_bpe)


def _in_tasks(docs: DataFrame, of: Callable[[Tokens, pa.RecordBatch], pa.RecordBatch], schema: T.StructType, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """What a worker's Tokens make of each SLICE bytes of texts, or one longer text; rid is a number of the document's row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast([open(p, "rb").read() for p in (byte_bpe, piece_bpe)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(*held.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield of(tokens, part)

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tokenised(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Rows of SCHEMA, one for SLICE bytes of texts or one longer text: tokens of a space and the text by both tokenizers, once for each different word.

    Both tokenizers end a token where a word ends, so groups and links lie within words. Strings of special tokens are plain text. A text that is null, empty, or whose joined tokens aren't its bytes has none.
    """
    return _in_tasks(docs, Tokens.coded, SCHEMA, byte_bpe, piece_bpe)


def _aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """align() with groups in one string, joined by ;."""
    out = _in_tasks(docs, Tokens.documents, ALIGNED, byte_bpe, piece_bpe)
    # every end that isn't the second of a shared one begins a link
    return out.select("rid", "doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.size("links")).alias("n_groups"), "groups", "links")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, groups (as strings) and links (an A id and a B id in a long) of every document; lazy."""
    groups = F.when(F.col("groups") == "", F.array().cast("array<string>")).otherwise(F.split("groups", ";"))
    return _aligned(docs, byte_bpe, piece_bpe).withColumn("groups", groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its A id has more); as many rows as there are pairs."""
    counts = cut(aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Texts without tokens (null, empty, bytes not reproduced) have zeros and an empty string. Repeated rows are documents of their
    own, and a doc_id may be null. Few pairs make up most links: those are joined where the links lie, and only links of the
    others, summed by document, are exchanged. Columns besides doc_id and text aren't read; an empty table gives no rows.
    """
    sha = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    held = written(_aligned(docs, byte_bpe, piece_bpe).select("rid", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), sha, "links"))
    pairs = cut(pair_counts(held))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    common, rare = pairs.where(F.col("n") * COMMON > total), pairs.where(F.col("n") * COMMON <= total)
    links = held.select("rid", F.explode("links").alias("pair"))
    near = links.join(F.broadcast(common), "pair").select("rid", "n", F.col("best").cast("long").alias("best")).groupBy("rid").agg(F.sum("n").alias("n"), F.sum("best").alias("best"))
    far = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").groupBy("rid", "pair").agg(F.count(F.lit(1)).alias("times"))
    far = far.join(rare, "pair").select("rid", (F.col("times") * F.col("n")).alias("n"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"))
    sums = near.unionByName(far).groupBy("rid").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return held.drop("links").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def link_table(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """a_id, b_id, n, best of pair_counts()."""
    return pairs.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n", "best")
