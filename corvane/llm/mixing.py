"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, word_count

#: Weights dealt to the sources in turn.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target and rate from (source, size) rows.

    Sources by code point, null last, get the weights in turn and divide share of all sizes by weight. Where a
    source would get over most times its size, it gets that, and the rest is divided again. That settles at one
    level: the sources with the least room for their weight are full, all others get level times weight. The
    per-source table (a row a source, aggregated before any shuffle) is all that the ordering windows see.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    per = per.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).alias("w"))
    per = per.withColumn("room", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    per = per.withColumn("left", total * F.lit(float(share)) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    per = per.withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the first source in this order that its share doesn't fill sets the level of all that follow
    per = per.withColumn("nth", F.row_number().over(filled))
    fits = F.col("room") * F.col("open") > F.col("left") * F.col("w")
    level = F.min(F.when(fits, F.struct("nth", (F.col("left") / F.col("open")).alias("level")))).over(whole)
    per = per.withColumn("level", level["level"])
    target = F.least(F.col("room"), F.coalesce(F.col("level") * F.col("w"), F.col("room")))
    return per.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def _times(doc_id: Column, rate: Column, seed: str) -> Column:
    """The whole part of the rate, and one more with the chance of its fraction, decided by a hash."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    chance = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)


def copies(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document.

    A document is emitted floor(rate) times, and once more with the chance of the fraction, decided by a hash of
    seed and doc_id: reruns agree on any partitioning. Null text: size 0. Null source: a source of its own, last.
    Rows that repeat a doc_id are decided alike. Empty table: no rows. Columns besides doc_id, text and source
    are not looked at.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, **kw).withColumnRenamed("source", "its")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["its"]))
    return joined.select("doc_id", "source", "size", "source_size", "target", _times(F.col("doc_id"), F.col("rate"), seed).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """docs, each row as often as copies() says, with a column that counts a row's copies from 1.

    It is called copy, or _copy, __copy, ... where docs has that. Null text: size 0; null source: a source of its own.
    Rows that repeat a doc_id are decided alike, repeated rows each for itself. Empty table: no rows. All columns of
    docs stay as they are, whatever their names.
    """
    name = unused("copy", docs)
    its, rate, n = (unused(x, docs) for x in ("its", "rate", "n"))
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, **kw).select(F.col("source").alias(its), F.col("rate").alias(rate))
    joined = docs.join(targets, docs["source"].eqNullSafe(targets[its]))
    joined = joined.withColumn(n, _times(F.col("doc_id"), F.col(rate), seed).cast("int"))
    return joined.select(*docs.columns, F.posexplode(F.array_repeat(F.lit(0), F.col(n))).alias(name, n)).withColumn(name, F.col(name) + 1).drop(n)
