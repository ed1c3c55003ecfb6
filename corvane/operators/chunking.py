"""Word windows and paragraph packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def window_starts(n: Column, most: int, overlap: int) -> Column:
    """Starts of the windows over n words; the last window is the first that reaches the end."""
    step = max(1, most - overlap)
    last = F.when(n <= most, F.lit(0)).otherwise(F.ceil((n - most) / F.lit(step)) * step).cast("int")
    return F.sequence(F.lit(0), last, F.lit(step))


def chunk_windows(docs: DataFrame, most: int = 180, overlap: int = 35) -> DataFrame:
    """doc_id, word_offset, chunk and word_count of overlapping windows over whole texts."""
    w = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    out = w.select("doc_id", "w", F.explode(window_starts(F.size("w"), most, overlap)).alias("s"))
    part = F.slice("w", F.col("s") + 1, F.lit(most))
    return out.select("doc_id", F.col("s").cast("long").alias("word_offset"), F.array_join(part, " ").alias("chunk"), F.size(part).cast("long").alias("word_count"))


def pack_paragraphs(text: Column, most: int) -> Column:
    """Neighbouring paragraphs joined while they have at most `most` words together; a fold within the row."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: X.replaced(p, (r"(?U)^\s+|\s+\z", ""))), lambda p: p != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"), F.lit(False).alias("any"))

    def add(acc: Column, p: Column) -> Column:
        n = F.size(words(p))
        full = acc["any"] & (acc["n"] + n > most)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]).alias("done"),
            F.when(full | ~acc["any"], p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p)).alias("held"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
            F.lit(True).alias("any"),
        )

    return F.aggregate(parts, start, add, lambda a: F.array_append(a["done"], a["held"]))


def chunk_documents(docs: DataFrame, most: int = 180, overlap: int = 35, least: int = 8) -> DataFrame:
    """doc_id, part, word_offset, location, text and word_count of each chunk.

    A window of fewer than `least` words is dropped once its document has given a chunk. Only the last window of a
    group can be that short, so it goes unless it is the document's first window.
    """
    if most <= 0 or least <= 0 or not 0 <= overlap < most:
        raise ValueError("most and least must be positive, overlap from 0 to below most")
    groups = docs.select("doc_id", F.posexplode(pack_paragraphs(F.col("text"), most)).alias("g", "group"))
    w = groups.select("doc_id", (F.col("g") + 1).cast("long").alias("part"), words(F.col("group")).alias("w")).where(F.size("w") > 0)
    out = w.select("doc_id", "part", "w", F.explode(window_starts(F.size("w"), most, overlap)).alias("s"))
    piece = F.slice("w", F.col("s") + 1, F.lit(most))
    out = out.select("doc_id", "part", F.col("s").cast("long").alias("word_offset"), F.array_join(piece, " ").alias("text"), F.size(piece).cast("long").alias("word_count"))
    out = out.where((F.col("word_count") >= least) | ((F.col("part") == 1) & (F.col("word_offset") == 0)))
    place = F.concat(F.lit("document, part "), F.col("part").cast("string"), F.lit(", word "), (F.col("word_offset") + 1).cast("string"))
    return out.withColumn("location", place)


def chunk_array(text: Column, most: int = 220, overlap: int = 40, least: int = 1) -> Column:
    """The chunks of a text as chunk_documents gives them (part, word_offset, text, word_count), within the row: their places are their indexes."""

    def of_group(group: Column, g: Column) -> Column:
        # bound once in an array of one, as the words are needed for each window
        def windows(w: Column) -> Column:
            def piece(s: Column) -> Column:
                held = F.slice(w, s + 1, F.lit(most))
                return F.struct((g + 1).cast("long").alias("part"), s.cast("long").alias("word_offset"), F.array_join(held, " ").alias("text"), F.size(held).cast("long").alias("word_count"))

            return F.transform(F.filter(window_starts(F.size(w), most, overlap), lambda s: F.size(w) > 0), piece)

        return F.flatten(F.transform(F.array(words(group)), windows))

    if most <= 0 or least <= 0 or not 0 <= overlap < most:
        raise ValueError("most and least must be positive, overlap from 0 to below most")
    every = F.flatten(F.transform(pack_paragraphs(text, most), of_group))
    return F.filter(every, lambda c: (c["word_count"] >= least) | ((c["part"] == 1) & (c["word_offset"] == 0)))


def chunk_count(text: Column, most: int = 220, overlap: int = 40, least: int = 1) -> Column:
    """How many chunks chunk_array gives; paragraphs are only counted, no group of them and no window is built."""
    if most <= 0 or least <= 0 or not 0 <= overlap < most:
        raise ValueError("most and least must be positive, overlap from 0 to below most")
    # stripped paragraphs, of which none is empty: their pieces between white space are their words
    stripped = F.transform(F.split(text, r"\n\s*\n"), lambda p: X.replaced(p, (r"(?U)^\s+|\s+\z", "")))
    sizes = F.transform(F.filter(stripped, lambda p: p != ""), lambda p: F.size(F.split(p, r"(?U)\s+")))
    step = max(1, most - overlap)

    def windows(n: Column, first: Column) -> Column:
        """Windows of a group of n words; of two that overlap only the last can be short."""
        more = F.when(n <= most, F.lit(0)).otherwise(F.ceil((n - most) / F.lit(step))).cast("int")
        kept = F.least(F.lit(most), n - more * step) >= least
        return F.when(n == 0, F.lit(0)).otherwise(F.when(F.lit(most < least), F.lit(0)).otherwise(more) + F.when(kept, 1).otherwise(0)) + F.when(first & (n > 0) & (F.least(F.lit(most), n) < least), 1).otherwise(0)

    def add(acc: Column, n: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + n > most)
        done = F.when(full, acc["done"] + windows(acc["n"], acc["first"])).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["first"] & ~full).alias("first"))

    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("n"), F.lit(True).alias("first"))
    return F.aggregate(sizes, start, add, lambda a: a["done"] + windows(a["n"], a["first"]))


def numbered(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with a dense chunk_id from 0 in the given order.

    Rows are sorted by range over all tasks; each partition's rows are counted, and the running sums of those counts (a
    row per partition) shift the numbers within it, so no task sees all rows.
    """
    from .numbering import with_row_numbers

    return with_row_numbers(chunks, "chunk_id", *order)


def merge_overlapping(chunks: DataFrame, most: int = 120, by: tuple[str, ...] = ("source", "title", "domain")) -> DataFrame:
    """The columns of by that there are, and text: the chunks (chunk_id, text) of each document joined in order, words
    that two neighbours share kept once. A document's chunks are folded within one row."""
    by = [c for c in by if c in chunks.columns]
    lists = chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk_id", words(F.coalesce("text", F.lit(""))).alias("w")))).alias("cs"))

    def add(acc: Column, c: Column) -> Column:
        w = c["w"]
        n = F.least(F.lit(most), F.size(acc), F.size(w))
        fits = F.filter(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.slice(acc, F.size(acc) - k + 1, k) == F.slice(w, 1, k))
        return F.concat(acc, F.slice(w, F.get(fits, F.lit(0)) + 1, F.size(w)))

    return lists.select(*by, F.array_join(F.aggregate("cs", F.array().cast("array<string>"), add), " ").alias("text"))
