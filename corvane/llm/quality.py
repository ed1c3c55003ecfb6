"""Quality classifier from weak labels: overlapping heuristic labellers, weighed by expectation-maximisation, train a
hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, mix, shingles, slices, spans_hash, utf8, words

# Insults that speak against a text wherever they stand.
INSULTS = "idiot moron stupid trash worthless pathetic disgusting clown scum loser".split()
#: Beginnings of words, in bytes, that labels may speak against; whole words are looked at too.
STEMS = (3, 4, 5, 6, 7, 8, 10)
#: Toxic documents that a stem needs, its least evidence, parts of the labels for held-out scores, the share of clean
#: documents under the threshold, its lower bound, and the words from which a text's length adds no certainty.
STEM_DOCS, STEM_EVIDENCE, FOLDS, CLEAN_KEPT, TOXIC_FROM, SURE_WORDS = 4, 1.2, 4, 0.995, 0.8, 900
MARKS = 1 << 18
BITS = 17
#: Under one half, for texts so short that the scorer can't tell.
KEEP_FROM = 0.4
#: name: (bad from, good to) where a high value is bad; between the two a labeller abstains.
LABELLERS = {
    "odd_ends": (0.10, 0.03), "shouting": (0.50, 0.20), "exclaiming": (0.10, 0.02), "bars": (0.05, 0.0),
    "stutter": (0.15, 0.03), "same_words": (0.70, 0.60), "same_passages": (0.30, 0.10), "no_sentences": (0.995, 0.98),
    "insults": (1.0, 0.0), "toxic_words": (1.0, 0.5),
}
#: The last two know toxic texts, one by a list, the other by what labels showed; the others are of the text's surface.
SURFACE = len(LABELLERS) - 2
#: P(vote bad | good) that a labeller has at least: none is taken for faultless.
SLIP = 0.0002
#: Texts of its own kind that a labeller is taken to have found bad beforehand.
TRUST = 2.0
#: P(vote bad | its own kind) that a labeller has at least, or its kind would turn into another of good texts.
KNOWS = 0.8


def _byte_classes() -> np.ndarray:
    """1 lower-case letter or part of another script's character, 2 A-Z, 3 digit, 4 common punctuation, 5 the rest."""
    t = np.full(256, 5, np.uint8)
    t[97:123] = 1
    t[128:] = 1
    t[65:91] = 2
    t[48:58] = 3
    t[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
    return t


CLASS = _byte_classes()


class Texts:
    """Words, votes and features of a batch of texts."""

    def __init__(self, column: pa.Array):
        self.data, off = utf8(column)
        self.begin, self.end, self.at = words(self.data, off)
        self.n = np.diff(self.at)
        self.h = spans_hash(self.data, self.begin, self.end)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        kinds = CLASS[self.data]
        upper = np.concatenate([[0], np.cumsum(kinds == 2)])
        self.caps = upper[self.end] - upper[self.begin]
        self.kinds, self.off = kinds, off
        self._stems = None
        self.again = np.zeros(len(self.h), bool)
        if len(self.h):
            self.again[1:] = (self.h[1:] == self.h[:-1]) & (self.owner[1:] == self.owner[:-1])

    def _distinct(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        key = np.sort((owner.astype(U) << U(44)) | (h >> U(20)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.bincount((key[new] >> U(44)).astype(np.int64), minlength=len(self.n))

    def votes(self, model: dict) -> np.ndarray:
        """1 good, -1 bad, 0 none, by document and labeller; a document without words gets none.

        toxic_words abstains where the model has learned no words.
        """
        n, m = np.maximum(self.n, 1), len(self.n)
        share = lambda x: np.bincount(self.owner, x, m) / n
        last, single = self.data[self.end - 1] if len(self.end) else self.data[:0], self.end - self.begin == 1
        sh, to = shingles(self.h, self.at)
        count = np.diff(to)
        letters = np.add.reduceat(np.append((self.kinds == 1) | (self.kinds == 2), False).astype(np.int64), np.minimum(self.off[:-1], len(self.kinds))) if m else n
        letters = np.where(np.diff(self.off) > 0, letters, 0)
        caps = np.bincount(self.owner, self.caps, m)
        measured = {
            "odd_ends": share(CLASS[last] == 5),
            "shouting": caps / np.maximum(letters, 1),
            "exclaiming": share(last == ord("!")),
            "bars": share((last == ord("|")) & single),
            "stutter": share(self.again),
            "same_words": 1 - self._distinct(self.h, self.owner) / n,
            "same_passages": 1 - self._distinct(sh, np.repeat(np.arange(m), count)) / np.maximum(count, 1),
            "no_sentences": 1 - share((last == ord(".")) | (last == ord("?"))),
        }
        hits = self.insults(model["terms"])
        measured["insults"] = np.maximum(hits / 2, hits * 100 / n)  # two, or one word in a hundred
        measured["toxic_words"] = self.evidence(*model["toxic"])[0] / model["toxic_from"] if len(model["toxic"][0]) else np.full(m, 0.75)
        out = np.zeros((m, len(LABELLERS)), np.int8)
        for j, (name, (bad, good)) in enumerate(LABELLERS.items()):
            out[:, j] = np.where(measured[name] >= bad, -1, np.where(measured[name] <= good, 1, 0))
            out[self.n < (20 if name in ("same_words", "no_sentences") else 1), j] = 0
        return out

    def features(self) -> np.ndarray:
        """Three hashed features of every word: itself, its shape, and the shapes of it and the word before."""
        if not len(self.h):
            return np.zeros((3, 0), np.int64)
        size = self.end - self.begin
        k = self.kinds.astype(np.int64)
        shape = k[self.begin] + 6 * k[self.end - 1] + 36 * k[np.maximum(self.end - 2, self.begin)] + 216 * np.minimum(size >> 2, 3) + 864 * (self.caps * 2 > size)
        before = np.concatenate([[0], shape[:-1]])
        before[self.at[:-1][self.n > 0]] = 0
        pair = (before * 1728 + shape) * 2 + self.again
        mask = U((1 << BITS) - 1)
        return np.stack([mix(x + U(salt << 40)) & mask for salt, x in ((1, self.h), (2, shape.astype(U)), (3, pair.astype(U)))]).astype(np.int64)

    @staticmethod
    def vote_features(votes: np.ndarray) -> np.ndarray:
        """A hashed feature of every labeller's vote, by document."""
        code = (np.arange(votes.shape[1]) * 3 + votes + 1).astype(U)
        return (mix(code + U(4 << 40)) & U((1 << BITS) - 1)).astype(np.int64)

    def insults(self, terms: np.ndarray) -> np.ndarray:
        """How many words of each text are listed insults."""
        if not len(self.h):
            return np.zeros(len(self.n), np.int64)
        return np.bincount(self.owner, np.isin(self.stems()[-1], terms), len(self.n)).astype(np.int64)

    def stems(self) -> np.ndarray:
        """stem_hashes() of the words; computed once."""
        if self._stems is None:
            self._stems = stem_hashes(self.data, self.begin, self.end)
        return self._stems

    def evidence(self, stems: np.ndarray, weight: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How toxic each text is by learned stems, and how many of its words have one.

        A word counts as its strongest stem does. Their mean is multiplied by the root of the length, as chance goes,
        up to SURE_WORDS: from there on it is the mean alone that tells, or long texts would all be toxic.
        """
        if not len(self.h) or not len(stems):
            return np.zeros(len(self.n)), np.zeros(len(self.n), np.int64)
        h = self.stems()
        most = np.zeros(h.shape[1])
        for x in h:
            at = np.flatnonzero(marks[(x & U(MARKS - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(stems, x[at]), len(stems) - 1)
            most[at] = np.maximum(most[at], np.where(stems[place] == x[at], weight[place], 0))
        n = np.maximum(self.n, 1)
        return np.bincount(self.owner, most, len(n)) / n * np.sqrt(np.minimum(n, SURE_WORDS)), np.bincount(self.owner, most > 0, len(n)).astype(np.int64)

    def folds(self) -> np.ndarray:
        """Part of the labels that each text is in; near copies mostly share their least shingle, thus the part."""
        sh, to = shingles(self.h, self.at)
        out = np.zeros(len(self.n), np.int64)
        some = np.flatnonzero(np.diff(to))
        if len(some):
            out[some] = (np.minimum.reduceat(sh, to[some]) % U(FOLDS)).astype(np.int64)
        return out


def stem_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of each word's beginnings of STEMS bytes (0 if it is not longer) and, last, of the whole word.

    Words are folded (A-Z and accented Latin capitals) and lose the punctuation around them.
    """
    folded = np.where(CLASS[data] == 2, data + np.uint8(32), data)
    folded[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    begin, end, letter = begin.copy(), end.copy(), (CLASS[folded] == 1)
    for _ in range(3):
        off = (begin < end) & ~letter[np.minimum(begin, len(data) - 1)]
        begin += off
        off = (begin < end) & ~letter[np.maximum(end - 1, 0)]
        end -= off
    ends = np.concatenate([*(np.minimum(begin + k, end) for k in STEMS), end])
    out = spans_hash(folded, np.tile(begin, len(STEMS) + 1), ends).reshape(len(STEMS) + 1, -1)
    for j, k in enumerate(STEMS):
        out[j] = np.where(end - begin > k, mix(out[j] + U(k << 40)), U(0))
    out[-1] = np.where(end > begin, out[-1], U(0))
    return out


def _sampled(docs: DataFrame, most: int) -> DataFrame:
    """About `most` documents at most, chosen by a hash of doc_id; all of them if there are fewer."""
    n = docs.select("doc_id").count()
    return docs if n <= most else docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def estimate(patterns: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | kind, a vote) as (kind, labeller, vote) and the share of each kind of document; abstaining tells nothing.

    Kind 0 is good; bad texts are of as many kinds as there are labellers, since each labeller sees another fault and
    texts seldom have all: with one bad kind, two labellers that agree would outvote all others. Labellers are
    independent within a kind; that kinds share labellers is how they depend on each other. Every labeller errs on
    good texts in SLIP of the cases at least, so that a bad vote that is very rare and stands alone is taken for an error,
    finds bad texts of its own kind in KNOWS of the cases at least, and has TRUST of them to begin with.
    Expectation-maximisation begins at: bad of the kinds that labellers say, else good.
    """
    m = patterns.shape[1]
    bad = (patterns == -1).astype(float)
    some, known = bad.any(1), np.concatenate([[True], bad.any(0)])  # a labeller that finds nothing has no kind
    share = np.column_stack([np.where(some, 0.05, 0.95), np.where(some[:, None], 0.95 * bad / np.maximum(bad.sum(1), 1)[:, None], 0.05 / m)]) * known
    table, prior = np.zeros((m + 1, m, 3)), np.full(m + 1, 1 / (m + 1))
    for _ in range(rounds if len(patterns) else 0):
        weight = share * count[:, None]
        prior = (weight.sum(0) + 0.01 + TRUST * (np.arange(m + 1) > 0)) * known
        prior /= prior.sum()
        for j in range(m):
            for c in range(m + 1):
                table[c, j] = np.bincount(patterns[:, j] + 1, weight[:, c], 3) + 0.01 + np.array([TRUST * (c == j + 1), 0, 0])
            table[:, j, 0] = np.maximum(table[:, j, 0] / (table[:, j, 0] + table[:, j, 2]), np.where(np.arange(m + 1) == 0, SLIP, 0))
            table[j + 1, j, 0] = max(table[j + 1, j, 0], KNOWS)
            table[:, j, 1], table[:, j, 2] = 1, 1 - table[:, j, 0]
        share = kinds(table, prior, patterns)
    return table, prior


def kinds(table: np.ndarray, prior: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Posterior of each kind, by row of votes."""
    logs = np.log(np.maximum(prior, 1e-12))[None, :] + sum(np.log(np.maximum(table[:, j, :], 1e-12)).T[votes[:, j] + 1] for j in range(votes.shape[1]))
    logs -= logs.max(1, keepdims=True)
    odds = np.exp(logs)
    return odds / odds.sum(1, keepdims=True)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over (features, shares, posterior) rows; both classes weigh alike."""
    weight, bias, power, power_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-6), 1e-6
    if not rows:
        return weight, bias
    feature = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    importance = y / max(y.sum(), 1e-9) * 0.5 + (1 - y) / max((1 - y).sum(), 1e-9) * 0.5
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(np.bincount(row, weight[feature] * value, len(y)) + bias))) - y) * importance
        grad = np.bincount(feature, g[row] * value, 1 << BITS) + 1e-6 * weight
        power += grad * grad
        power_b += g.sum() ** 2
        weight -= 0.5 * grad / np.sqrt(power)
        bias -= 0.5 * g.sum() / np.sqrt(power_b)
    return weight, bias


def fit(docs: DataFrame, labels: DataFrame | None = None, scorer_sample: int = 4000, stem_sample: int = 30_000) -> dict:
    """The fitted classifier.

    labels (doc_id, toxic), if given, show words and beginnings of words that toxic documents have more often, from
    about stem_sample of them; they make one more labeller. Votes are counted over all documents; a task sends at most
    3**10 patterns. The scorer is fitted on the labellers' posterior for about scorer_sample documents. Both samples
    bound what the driver holds, whatever the size of the tables.
    """
    terms = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    begin, end, _ = words(terms, np.array([0, len(terms)]))
    model = {"terms": stem_hashes(terms, begin, end)[-1], "toxic": _lookup(np.zeros(0, U), np.zeros(0)), "toxic_from": TOXIC_FROM}
    if labels is not None:
        model["toxic"], model["toxic_from"] = toxic_stems(docs, labels, dict(model), stem_sample)
    known = dict(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                t = Texts(b.column("text"))
                total += np.bincount(((t.votes(known) + 1) @ base)[t.n > 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    code = np.array([r["pattern"] for r in rows], np.int64)
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    model["table"], model["prior"] = estimate(patterns, np.array([r["n"] for r in rows], float))
    fitted = dict(model)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                t = Texts(b.column("text"))
                votes, f = t.votes(fitted), t.features()
                p, told = posterior(fitted, votes), t.vote_features(votes)
                out = []
                for i in np.flatnonzero(t.n > 0):
                    found, n = np.unique(f[:, t.at[i] : t.at[i + 1]], return_counts=True)
                    found, n = np.concatenate([found, told[i]]), np.concatenate([n / t.n[i], votes[i] != 0])
                    out.append((found.astype(np.int32).tobytes(), n.astype(np.float32).tobytes(), float(p[i])))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["f", "v", "p"])

    taken = _sampled(docs.where("text is not null"), scorer_sample).select("text").mapInArrow(sample, "f binary, v binary, p double").collect()
    taken = sorted((bytes(r["f"]), bytes(r["v"]), r["p"]) for r in taken)
    model["weight"], model["bias"] = train_scorer([(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32), p) for f, v, p in taken])
    return model


def _lookup(stems: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stems in order, their weights, and a table of their low bits that spares most searches."""
    order = np.argsort(stems)
    marks = np.zeros(MARKS, bool)
    marks[(stems & U(MARKS - 1)).astype(np.int64)] = True
    return stems[order], weight[order], marks


def toxic_stems(docs: DataFrame, labels: DataFrame, model: dict, sample: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """Stems (and whole words) with their evidence, as _lookup() has them, and how toxic a text must be to go.

    Evidence: log of how much more often toxic documents have the stem, by occurrences, less one standard error, by
    documents. Each labelled document is scored by the stems of the other FOLDS - 1 parts; the threshold is what
    CLEAN_KEPT of the clean ones stay under, of those that no labeller finds bad.
    """
    known = _sampled(labels.where("toxic is not null"), sample).select(F.col("doc_id").alias("of"), "toxic").dropDuplicates(["of"])
    # a sample of bounded size is sent to the texts, which are not exchanged
    rows = cut(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("text", F.col("toxic").cast("long").alias("toxic")))

    def pairs(b: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, stem) and how often."""
        t = Texts(b.column("text"))
        if not len(t.h):
            return t, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        h = t.stems().reshape(-1)
        owner = np.tile(t.owner, len(STEMS) + 1)[h > 0]
        h = h[h > 0]
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
        return t, owner[new], h[new], np.diff(np.append(new, len(h)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                stem, n = np.unique(pairs(b)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(n)], ["stem", "n"])

    often = rows.where("toxic = 1").mapInArrow(candidates, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= STEM_DOCS).select("stem").toArrow()
    stems = np.sort(often.column("stem").to_numpy().astype(np.int64).view(U))
    if not len(stems):
        return _lookup(stems, np.zeros(0)), TOXIC_FROM
    # by part of the labels: words or documents that have the stem, of toxic and of clean ones
    names = [f"{x}{f}" for x in ("t", "c", "td", "cd") for f in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 * FOLDS, len(stems) + 1), np.int64)  # the last column counts all words
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                t, owner, h, n = pairs(b)
                slot = np.where(b.column("toxic").to_numpy(zero_copy_only=False) == 1, 0, FOLDS) + t.folds()
                np.add.at(total, (slot, len(stems)), t.n)
                place = np.minimum(np.searchsorted(stems, h), len(stems) - 1)
                has = stems[place] == h
                np.add.at(total, (slot[owner[has]], place[has]), n[has])
                np.add.at(total, (slot[owner[has]] + 2 * FOLDS, place[has]), 1)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], ["at", *names])

    counted = rows.mapInArrow(count, "at long, " + ", ".join(f"{x} long" for x in names)).groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    got = np.zeros((4 * FOLDS, len(stems) + 1))
    got[:, counted.column("at").to_numpy()] = np.stack([counted.column(x).to_numpy() for x in names])
    got = got.reshape(4, FOLDS, -1)

    def learned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, c, td, cd = x[:, :-1]
        words_t, words_c = np.maximum(x[:2, -1], 1)
        evidence = np.log(np.maximum(t, 1e-9) / words_t) - np.log((c + 1) / words_c) - np.sqrt(1 / np.maximum(td, 1) + 1 / (cd + 1))
        good = (td >= STEM_DOCS) & (evidence >= STEM_EVIDENCE)
        return _lookup(stems[good], evidence[good])

    parts = [learned(got.sum(1) - got[:, f]) for f in range(FOLDS)]

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                t = Texts(b.column("text"))
                fold = t.folds()
                score = np.choose(fold, [t.evidence(*p)[0] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(score[(t.n > 0) & (t.votes(model) >= 0).all(1)])], ["score"])

    clean = rows.where("toxic = 0").mapInArrow(held_out, "score double").toArrow().column("score").to_numpy()
    return learned(got.sum(1)), max(TOXIC_FROM, float(np.quantile(clean, CLEAN_KEPT))) if len(clean) else TOXIC_FROM


def posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    return kinds(model["table"], model["prior"], votes)[:, 0]


def judged(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, weak label, toxic words and whether the text stays, for every text of a column."""
    t = Texts(column)
    f, votes = t.features(), t.votes(model)
    z = sum(np.bincount(t.owner, model["weight"][f[j]], len(t.n)) for j in range(3)) / np.maximum(t.n, 1) + (model["weight"][t.vote_features(votes)] * (votes != 0)).sum(1) + model["bias"]
    score = np.where(t.n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
    hits = np.maximum(t.insults(model["terms"]), np.where(votes[:, -1] < 0, t.evidence(*model["toxic"])[1], 0))
    return score, np.where(t.n > 0, posterior(model, votes), 0.0), hits, score >= KEEP_FROM


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, quality_score, weak_label (posterior of the labellers), insults and keep of every document.

    keep: the scorer, linear in words, their shapes and the labellers' votes, gives KEEP_FROM or more. insults: listed
    ones, and where learned words make the text toxic, those. A text that is null or has no words scores 0 and goes.
    Repeated rows get equal answers; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                score, weak, hits, keep = judged(model, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(weak), pa.array(hits), pa.array(keep)], ["doc_id", "quality_score", "weak_label", "insults", "keep"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return held.mapInArrow(run, "doc_id long, quality_score double, weak_label double, insults long, keep boolean")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that score_documents() keeps, with all their columns, whatever their names; no shuffle.

    Null and empty texts go; repeated rows stay or go together; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_000_000):
                yield b.filter(pa.array(judged(model, b.column("text"))[3]))

    return docs.mapInArrow(run, docs.schema)
