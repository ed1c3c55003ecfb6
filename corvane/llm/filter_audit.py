"""How filters of documents act on one another, in every order, with exact duplicates found by refining a partition."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: Bytes of the first block; each later one is GROWTH times as long as the one before.
FIRST, GROWTH = 1024, 16
#: No string has more bytes.
MOST = (1 << 31) - 1
#: Classes with more than this share of the rows are sent to the tasks, which bounds how many they are.
HOT = 1000


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null; words are runs of everything but space and ASCII controls."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200, "B": 100 * different.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def block_hashes(text: Column) -> Column:
    """Hashes of the text's successive blocks of bytes; those grow, so that seven are enough for any string."""
    raw, blocks, at, size = text.cast("binary"), [], 0, FIRST
    while at < MOST:
        blocks.append(F.when(F.octet_length(raw) > at, F.xxhash64(F.substring(raw, at + 1, min(size, MOST - at)))))
        at, size = at + size, size * GROWTH
    return F.array_compact(F.array(*blocks))


def _split(rows: DataFrame, by: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hot classes, each found by a broadcast of few classes, and the others."""
    few = F.broadcast(hot)
    return rows.join(few, by, "left_semi"), rows.join(few, by, "left_anti")


def _counted(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Classes of two rows or more, by whether they have over total / HOT rows: those are less than HOT."""
    sizes = cut(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return sizes.where(F.col("n") * HOT > total).select("cls"), sizes.where(F.col("n") * HOT <= total).select("cls")


def refine(rows: DataFrame, digest: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """rows (n_chars, blocks, ...) that others may equal, with their class cls, and done when no block is left to split by.

    The first partition is by n_chars, each further one by the next block's hash. Rows alone in their class are dropped
    each time, so that later rounds see fewer rows. As many rounds as the longest text that isn't alone has blocks.
    digest: names the class of a class and a block; if it maps two to one, their texts are told apart afterwards.
    """
    total = rows.count()
    left, at = rows.withColumn("cls", F.col("n_chars").cast("long")), 0
    while True:
        hot, cold = _counted(left, total)
        many, rest = _split(left, "cls", hot)
        left = cut(many.unionByName(rest.join(cold, "cls", "left_semi")))
        most = left.agg(F.max(F.size("blocks"))).first()[0] or 0
        if at >= most:
            return left
        block = F.get("blocks", F.lit(at))
        left, at = left.withColumn("cls", F.when(block.isNull(), F.col("cls")).otherwise(digest(F.col("cls"), block))), at + 1


def class_of(n_chars: Column, blocks: Column, digest: Callable[[Column, Column], Column] = F.xxhash64) -> Column:
    """The class that refine() gives in the end."""
    return F.aggregate(blocks, n_chars.cast("long"), lambda c, b: digest(c, b))


def signed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_chars, blocks and more of every document; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), block_hashes(text).alias("blocks"), *more)


def with_duplicates(docs: DataFrame, *more: Column, digest: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, more, and same, whether a document of smaller doc_id has the same text.

    A null doc_id is neither smaller nor greater than another. Only texts of classes that the refinement leaves are
    compared; equal ones are merged in each task before they are exchanged. Where a class turns out to hold several texts,
    its documents are looked up by whole text. Classes of very many rows are joined where the rows lie.
    """
    shape = lambda df: df.withColumn("cls", class_of(F.col("n_chars"), F.col("blocks"), digest))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    facts = cut(signed(docs, *more))
    names = facts.drop("n_chars", "blocks").columns
    left = refine(facts.select("n_chars", "blocks"), digest)
    hot, cold = _counted(left, facts.count())
    many, rest = _split(shape(signed(docs, text)), "cls", hot)
    texts = many.unionByName(rest.join(cold, "cls", "left_semi")).groupBy("cls", "text").agg(F.min("doc_id").alias("first"))
    classes = cut(texts.groupBy("cls").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")))
    single, mixed = classes.where("texts = 1").drop("texts"), classes.where("texts > 1").select("cls")
    same = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("same")
    common, others = _split(shape(facts), "cls", hot)
    out = common.join(F.broadcast(single.join(F.broadcast(hot), "cls", "left_semi")), "cls", "left").unionByName(others.join(single, "cls", "left"))
    if mixed.isEmpty():
        return out.select(*names, same)
    again = shape(signed(docs, *more, text)).join(mixed, "cls", "left_semi").join(texts, ["cls", "text"])
    return out.join(mixed, "cls", "left_anti").select(*names, same).unionByName(again.select(*names, same))


def steps(letters: str = "ABCDE") -> list[tuple[str, int, int, int]]:
    """filter_order, step, the step's filter as a bit, and the bits of those before, of every order of the filters."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [("".join(o), i + 1, bit[o[i]], sum(bit[x] for x in o[:i])) for o in permutations(letters) for i in range(len(o))]


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each step of each order of the filters does in each part, zeros included.

    counts: part, mask (bit i: fails filter i), n, good, toxic documents. Masks meet the few pairs of a filter and what ran
    before it, and only these sums meet the orders.
    """
    spark, n = counts.sparkSession, len(letters)
    pairs = sorted({x[2:] for x in steps(letters)})
    many = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for b, e in pairs])).alias("p")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda of, when: F.sum(F.when(when, F.col(of)).otherwise(0))
    share = F.lit(factorial(n)) / F.bit_count("mask")  # orders in which a given one of its filters comes first
    sums = counts.select("part", "mask", "n", "good", "toxic", many).select("*", "p.*").groupBy("part", "bit", "earlier").agg(
        total("n", ~gone & ~fails).alias("kept"), total("n", ~gone & fails).alias("removed"), total("n", gone & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", ~gone & fails).alias("good_lost"), total("toxic", ~gone & fails).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).alias("shapley"),
    )
    orders = spark.createDataFrame(steps(letters), "filter_order string, step int, bit int, earlier int")
    return sums.join(F.broadcast(orders), ["bit", "earlier"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")  # 600 rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang, null as an empty string), order of the five filters and step; none for an empty table.

    A null text is empty. Documents of one doc_id, repeated rows too, count each, and don't duplicate each other. Of several
    labels of a doc_id any counts that says quality or toxic 1; a null doc_id has none. Other columns aren't read.
    """
    failed = conditions(F.coalesce(F.col("text"), F.lit("")))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed.values())), F.lit(0))
    rows = with_duplicates(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.alias("others"))
    rows = rows.select("doc_id", "part", (F.col("others") + F.when(F.col("same"), 16).otherwise(0)).alias("mask"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    none = F.lit(None).cast("long")
    rows = rows.where("doc_id is not null").join(known, "doc_id", "left").unionByName(rows.where("doc_id is null").withColumns({"quality": none, "toxic": none}))
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return interactions(cut(counts))
