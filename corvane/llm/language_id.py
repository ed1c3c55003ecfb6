"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SYMBOLS = 64
_TABLE: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 no letter, a-z one each, all other letters dealt over the rest."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
        t[letters] = 27 + letters % (SYMBOLS - 27)
        t[97:123] = np.arange(1, 27)
        t[65:91] = np.arange(1, 27)
        _TABLE = t
    return _TABLE


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of every letter trigram (a run of other characters borders words) and the row that it is of."""
    texts = texts.fill_null("")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cps = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol_table()[cps].astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    keep = (owner[:-2] == owner[2:]) & (s[1:-1] > 0)  # the middle is a letter
    return code[keep], owner[:-2][keep]


def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """n-gram vectors: the product of the first letter's vector permuted twice, the second's once, the third's."""
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def profiles(docs: DataFrame, dim: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """One bundled vector per language from the rows (text, lang); rows without lang are left out.

    Trigrams are counted per language in each task and summed, so a task sends at most languages x 64**3 rows; one
    vector per language comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for b in slices(batch, "text"):
                langs = b.column("lang").dictionary_encode()
                code, owner = trigrams(b.column("text"))
                which = langs.indices.to_numpy(zero_copy_only=False)[owner]
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(code[which == i], minlength=SYMBOLS**3)
                    held[lang] = held[lang] + n if lang in held else n
                if len(held) > 16:
                    yield from flush()
        yield from flush()

    letters = letter_vectors(dim, seed)

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(dim)
        for i in range(0, len(pdf), 8192):
            part = pdf.iloc[i : i + 8192]
            total += part["n"].to_numpy(np.float64) @ bind(part["code"].to_numpy(), letters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "vector": [total.tolist()]})

    counted = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, code long, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").collect()
    return {r["lang"]: np.array(r["vector"]) for r in sorted(rows, key=lambda r: r["lang"])}


def identify(docs: DataFrame, model: dict[str, np.ndarray], seed: int = 7) -> DataFrame:
    """doc_id, lang_pred and score (cosine with the winning profile, 0 to 1) of every document.

    `und` with score 0 for a null text, a text without letters, or a model without languages. A tie goes to the
    first language by code point. Texts whose only letters stand alone still have their trigram with both borders.
    Repeated rows get equal answers; other columns are not looked at.
    """
    langs = list(model)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in model.values()] or [[0.0]], np.float32)
    dim = unit.shape[1]
    letters = letter_vectors(dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_500_000):
                padded = pa.array([f" {t} " if t else "" for t in b.column("text").to_pylist()], pa.string())
                code, owner = trigrams(padded)
                rows = b.num_rows
                lang, best = np.full(rows, -1), np.zeros(rows)
                if len(code) and langs:
                    used = np.flatnonzero(np.bincount(code, minlength=SYMBOLS**3))
                    index = np.zeros(SYMBOLS**3, np.int64)
                    index[used] = np.arange(len(used))
                    vectors = bind(used, letters)
                    step = max(1, 4_000_000 // len(used))
                    bounds = np.searchsorted(owner, np.arange(0, rows + step, step))
                    for i, at in enumerate(range(0, rows, step)):
                        to = min(rows, at + step)
                        part = slice(bounds[i], bounds[i + 1])
                        n = np.bincount((owner[part] - at) * len(used) + index[code[part]], minlength=(to - at) * len(used))
                        bundled = n.reshape(to - at, -1).astype(np.float32) @ vectors
                        size = np.linalg.norm(bundled, axis=1)
                        cos = (bundled @ unit.T) / np.maximum(size, 1e-9)[:, None]
                        lang[at:to] = np.where(size > 0, cos.argmax(1), -1)
                        best[at:to] = np.where(size > 0, cos.max(1), 0)
                said = [langs[i] if i >= 0 else "und" for i in lang]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string()), pa.array(np.clip(best, 0, 1))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
