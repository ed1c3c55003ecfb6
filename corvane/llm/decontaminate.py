"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, U, keyed, slices, spans_hash, unused, utf8

#: Hashed terms, dimensions of the latent space, terms of a passage and of its half.
TERM_BITS, RANK, PASSAGE, HALF = 13, 48, 16, 8
TERMS = 1 << TERM_BITS
#: Terms whose sketches travel together.
BLOCK = 64
#: Parts that the tasks' sketches are added in first.
SALTS = 64
#: Cosine from which a pair of passages is looked at; share of an item's words, in order, that make it a leak; the
#: same if its end, where the answer is, is there too; share of the end's words.
COSINE, COPIED, PARAPHRASED, ANSWERED = 0.45, 0.7, 0.6, 0.85
#: Least share of a passage's squared term weights that an item must have, times the share of it that a short item fills.
SHARED = 0.3
#: Items with fewer words tell nothing; items go to the documents in blocks of about this many.
LEAST_WORDS, ITEM_BLOCK = 4, 4000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term (run of letters and digits, A-Z and accented Latin capitals folded), and where texts begin."""
    data, off = utf8(column)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    folded = _FOLD[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    folded[capital] += 32
    solid = _WORD[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = off[:-1][off[:-1] < off[1:]]
    first[starts] = solid[starts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = starts[1:] - 1
    last[ends] = solid[ends]
    begin = np.flatnonzero(first)
    return spans_hash(folded, begin, np.flatnonzero(last) + 1), np.searchsorted(begin, off)


def dealt(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers padded with TERMS so that each text fills whole rows of `size`, and where each text's rows begin."""
    n = np.diff(at)
    rows = -(-n // size)
    to = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(to[-1] * size, TERMS, np.int32)
    owner = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(h)) - at[:-1][owner] + to[:-1][owner] * size] = (h & U(TERMS - 1)).astype(np.int32)
    return out.reshape(-1, size), to


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each hashed term by the number of passages that have it, over all documents; one more for padding."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        passages = 0
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                f, _ = dealt(*terms(b.column("text")), PASSAGE)
                f.sort(axis=1)
                new = np.ones(f.shape, bool)
                new[:, 1:] = f[:, 1:] != f[:, :-1]
                total += np.bincount(f[new], minlength=TERMS + 1)
                passages += len(f)
        total[TERMS] = passages
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS + 1)
    for r in counted:
        n[r["term"]] = r["n"]
    weight = np.log((n[TERMS] + 1) / (n + 1)) + 0.1
    weight[TERMS] = 0
    return weight.astype(np.float32)


def latent_space(docs: DataFrame, weight: np.ndarray, seed: int = 11) -> np.ndarray:
    """Terms x RANK map of weighted terms to the latent space; the last row, for padding, is 0.

    Randomised singular value decomposition of the TF-IDF matrix A of all passages: each task multiplies its passages
    with one random matrix R and back, so that the sum Z = A'AR needs one pass and TERMS x RANK numbers a task; the
    decomposition of Z (R'Z)^-1 Z' then is that of A'A on the sketched range. Directions are divided by their singular
    value, so that words that all texts share don't hide the others.
    """
    random = np.vstack([np.random.default_rng(seed).standard_normal((TERMS, RANK)), np.zeros((1, RANK))]).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((TERMS + 1, RANK))
        weighted = random * weight[:, None]
        for batch in batches:
            for b in slices(batch, "text", 700_000):
                f, _ = dealt(*terms(b.column("text")), PASSAGE)
                if not len(f):
                    continue
                size = np.sqrt((weight[f] ** 2).sum(1))
                y = weighted[f].sum(1) / np.maximum(size, 1e-6)[:, None] ** 2
                flat = f.reshape(-1)
                order = np.argsort(flat.astype(np.uint16), kind="stable")
                ranked = flat[order]
                new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                of, columns = order // PASSAGE, np.ascontiguousarray(y.T)
                z[ranked[new]] += np.stack([np.add.reduceat(c[of], new) for c in columns], 1)
        z = (z * weight[:, None])[:TERMS].reshape(-1, BLOCK * RANK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), pa.array([r.tobytes() for r in z], pa.binary())], ["block", "z"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in pdf["z"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "z": [total.tobytes()]})

    # tasks x 24 kB would meet in one block's group; so the tasks' sums are added in SALTS parts first
    parts = docs.select("text").mapInArrow(sketch, "block long, z binary").groupBy("block", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    rows = parts.applyInPandas(add, "block long, z binary").groupBy("block").applyInPandas(add, "block long, z binary").collect()
    z = np.zeros((TERMS // BLOCK, BLOCK * RANK))
    for r in rows:
        z[r["block"]] = np.frombuffer(r["z"], np.float64)
    z, r0 = z.reshape(TERMS, RANK), random[:TERMS].astype(np.float64)
    core = r0.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 1e-9) * 1e-9
    half = z @ (vectors[:, keep] / np.sqrt(values[keep])) if keep.any() else np.zeros((TERMS, 1))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    out = u / np.maximum(s, max(s.max(), 1e-9) * 1e-6) if s.max() > 0 else u
    out *= np.sqrt(TERMS) / max(np.linalg.norm(out), 1e-9)
    return np.vstack([out * weight[:TERMS, None], np.zeros((1, out.shape[1]))]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a row of the table is one integer of bits."""
    where: dict[int, int] = {}
    for i, v in enumerate(a):
        where[v] = where.get(v, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for v in b:
        m = where.get(v)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


MARKS = 1 << 20


class Items:
    """Benchmark items as passages in the latent space."""

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray):
        h, at = terms(pa.array([t for _, t in rows], pa.large_string()))
        self.ids, self.words, piece, self.of, self.shift = [], [], [], [], []
        for i, (item_id, _) in enumerate(rows):
            w = h[at[i] : at[i + 1]]
            if len(w) < LEAST_WORDS:
                continue
            self.ids.append(item_id)
            self.words.append(w.tolist())
            last = max(0, len(w) - PASSAGE)
            for a in sorted({*range(0, last, HALF), last}):
                f = (w[a : a + PASSAGE] & U(TERMS - 1)).astype(np.int64)
                piece.append(space[f].sum(0))
                self.of.append(len(self.ids) - 1)
                self.shift.append(a)
        self.vectors = _unit(np.array(piece, np.float32).reshape(len(piece), space.shape[1]))
        self.of, self.shift = np.array(self.of, np.int64), np.array(self.shift, np.int64)
        self.known = np.zeros(MARKS, bool)
        self.has = np.zeros((len(self.ids), TERMS + 1), bool)
        for i, w in enumerate(self.words):
            w = np.array(w, U)
            self.known[(w & U(MARKS - 1)).astype(np.int64)] = True
            self.has[i, (w & U(TERMS - 1)).astype(np.int64)] = True
        self.least = np.array([SHARED * min(1, len(w) / PASSAGE) for w in self.words])
        # items that don't fill a passage, by their number of words; a bit of small for each number that a word occurs in
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.small = np.zeros(MARKS, np.uint16)
        size = np.array([len(w) for w in self.words], np.int64)
        for n in np.unique(size[size < PASSAGE]).tolist():
            p = np.flatnonzero(size[self.of] == n)
            self.short[n] = (self.of[p], np.ascontiguousarray(self.vectors[p].T))
            marks = np.array([w for i in self.of[p] for w in self.words[i]], U) & U(MARKS - 1)
            self.small[marks.astype(np.int64)] |= np.uint16(1 << n)

    def short_hits(self, h: np.ndarray, at: np.ndarray, space: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, items of under PASSAGE words and the place in the text, where windows as long as the item are alike.

        In a passage such an item is one part among others, so that its cosine falls with its length; a window of its
        own length begins at every word here. Windows with too few words of such items are not projected.
        """
        small = self.small[(h & U(MARKS - 1)).astype(np.int64)]
        f = (h & U(TERMS - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n, (item, vectors) in self.short.items():
            if len(h) < n:
                continue
            sums = np.concatenate([[0], np.cumsum((small >> n) & 1, dtype=np.int64)])
            begin = np.flatnonzero((sums[n:] - sums[:-n] >= PARAPHRASED * n) & (owner[n - 1 :] == owner[: len(h) - n + 1]))
            for lo in range(0, len(begin), 2048):
                b = begin[lo : lo + 2048]
                terms_of = f[b[:, None] + np.arange(n)]
                hit = np.flatnonzero((_unit(space[terms_of].sum(1)) @ vectors).reshape(-1) >= COSINE)
                w, i = hit // len(item), item[hit % len(item)]
                ok = self.has[i[:, None], terms_of[w]].sum(1) >= PARAPHRASED * n
                w, i = w[ok], i[ok]
                yield owner[b[w]], i, b[w] - at[owner[b[w]]]

    def leaks(self, h: np.ndarray, at: np.ndarray, space: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(text, item, share of the item in order, share of its end) of the leaks in some texts.

        Passages whose terms, by weight, no item could have are not projected: they can't pass the check below.
        """
        if not len(h) or not len(self.ids):
            return []
        f, to = dealt(h, at, HALF)
        n = np.diff(to)
        owner = np.repeat(np.arange(len(at) - 1), n)
        row = np.flatnonzero(np.concatenate([owner[1:] == owner[:-1], [False]]) | (n[owner] == 1))
        after = np.where(n[owner[row]] > 1, row + 1, -1)  # the last row added below is empty
        power = weight * weight
        known = np.zeros(f.size, bool)
        token = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at)) + np.repeat(to[:-1], np.diff(at)) * HALF
        known[token] = self.known[(h & U(MARKS - 1)).astype(np.int64)]
        f = np.vstack([f, np.full((1, HALF), TERMS, f.dtype)])
        each = power[f]
        whole = each.sum(1)
        mine = (each[:-1] * known.reshape(-1, HALF)).sum(1)
        whole, mine = whole[row] + whole[after], mine[row] + np.append(mine, 0)[after]
        keep = np.flatnonzero(mine >= whole * self.least.min())
        row, after, whole = row[keep], after[keep], whole[keep]
        found: dict[tuple[int, int], set[int]] = {}
        for lo in range(0, len(row), 2048):
            r, z = row[lo : lo + 2048], after[lo : lo + 2048]
            window = _unit(space[f[r]].sum(1) + space[f[z]].sum(1))
            hit = np.flatnonzero((window @ self.vectors.T).reshape(-1) >= COSINE)
            w, p = hit // len(self.vectors), hit % len(self.vectors)
            i = self.of[p]
            got = (self.has[i[:, None], f[r[w]]] * each[r[w]]).sum(1) + (self.has[i[:, None], f[z[w]]] * each[z[w]]).sum(1)
            ok = got >= self.least[i] * whole[lo + w]
            w, p, i = w[ok], p[ok], i[ok]
            start = (r[w] - to[owner[r[w]]]) * HALF - self.shift[p]
            for t, x, s in zip(owner[r[w]].tolist(), i.tolist(), start.tolist(), strict=True):
                found.setdefault((t, x), set()).add(s)
        for t, i, start in self.short_hits(h, at, space):
            for a, b, c in zip(t.tolist(), i.tolist(), start.tolist(), strict=True):
                found.setdefault((a, b), set()).add(c)
        out = []
        for (t, i), starts in found.items():
            item, best, answered, done = self.words[i], 0.0, 0.0, -(10**9)
            end = item[-max(3, len(item) // 3) :]
            slack = PASSAGE // 2 + len(item) // 8
            for s in sorted(starts):
                if s - done < HALF and best >= COPIED:
                    continue
                part = h[max(at[t], at[t] + s - slack) : min(at[t + 1], at[t] + s + len(item) + slack)].tolist()
                own = set(part)
                if sum(x in own for x in item) < PARAPHRASED * len(item):
                    continue
                share = common_subsequence(item, part) / len(item)
                if share > best:
                    best, answered, done = share, common_subsequence(end, part) / len(end), s
            if best >= COPIED or (best >= PARAPHRASED and answered >= ANSWERED):
                out.append((t, i, best, answered))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """k, sub, item_id, overlap and answer_overlap for each document and benchmark item that it gives away.

    Every 16-term passage of every document (in steps of 8) is compared with every passage of every item in the
    latent space, and every window of as many words as an item of under PASSAGE words with that item (in steps of 1);
    where the cosine is COSINE or more, the item's terms must occur around there in order: COPIED of
    them, or PARAPHRASED and ANSWERED of its last third. Items go to the documents in blocks of bounded size. Items that are
    null or have under LEAST_WORDS terms are not looked for; null texts hold nothing; an empty table of either kind
    gives no rows. Rows with equal doc_id and text are found alike; other columns are not looked at.
    """
    rows = keyed(docs)
    n = benchmark.count()
    weight = inverse_frequencies(rows)
    space = latent_space(rows, weight)
    blocks, out = max(1, -(-n // ITEM_BLOCK)), None
    named = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    for b in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = Items(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, *r)), space)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text", 700_000):
                    found = items.leaks(*terms(b.column("text")), space, weight)
                    at = pa.array([x[0] for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("k").take(at), b.column("sub").take(at), pa.array([items.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.float64())],
                        ["k", "sub", "item_id", "overlap", "answer_overlap"],
                    )

        found = rows.mapInArrow(run, "k long, sub long, item_id long, overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, overlap and answer_overlap; see find_leaks()."""
    return find_leaks(docs, benchmark).select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "item_id", F.round("overlap", 6).alias("overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that give away an item.

    Null and empty texts give nothing away and stay; repeated rows stay or go together; with an empty table of items
    all stay. All columns stay, whatever their names.
    """
    k, sub = unused("k", docs), unused("sub", docs)
    gone = find_leaks(docs, benchmark).select(F.col("k").alias(k), F.col("sub").alias(sub)).distinct()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    same = (F.col(sub) == 0) | (F.col(sub) == F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return docs.join(gone, (key == F.col(k)) & same, "left_anti")
