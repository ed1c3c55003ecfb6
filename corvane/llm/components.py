"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (a, b): root is the smallest id of its component.

    Each round every node's neighbours are linked to the smallest of them, first the larger neighbours, then the
    smaller ones; a component becomes a star around its smallest node in logarithmically many rounds. A node's
    neighbours are only aggregated, never gathered, and each round is written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        near = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        joined = near.join(low, F.col("a") == F.col("of"))
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("of").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def fewer(e: DataFrame, n: int) -> DataFrame:
        """A partition for some hundred thousand edges: a few edges in all partitions cost a task each and round."""
        return e.coalesce(n // EDGES + 1)

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    told = sums(e)
    e = fewer(e, told[0])
    while told[0]:
        e = cut(star(star(e, True), False))
        now = sums(e)
        e = fewer(e, now[0])
        if now == told:
            break
        told = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
