"""Jump consistent hashing of documents into numbered shards, with gapless places in each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, unused

#: Multiplier of the published generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: all keys jump ahead together until each one's next jump would pass the last shard."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, to = np.zeros(len(state), np.int64), np.zeros(len(state), np.float64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = to[moving].astype(np.int64)
        state[moving] = state[moving] * STEP + np.uint64(1)
        to[moving] = np.floor((at[moving] + 1) * (float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1)))
        moving = moving[to[moving] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, *shards: int) -> Column:
    """A struct s0, s1, ... with the shard of a 64-bit key for each number of shards."""
    kind = T.StructType([T.StructField(f"s{i}", T.IntegerType()) for i in range(len(shards))])

    @F.pandas_udf(kind)
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            k = keys.to_numpy(np.int64)
            yield pd.DataFrame({f"s{i}": jump(k, n) for i, n in enumerate(shards)})

    return place(key)


def stable_key(docs: DataFrame, key: str = "doc_id") -> Column:
    """The 64-bit key of a row: an integer key itself, the hash of any other; 0 for null."""
    integral = isinstance(docs.schema[key].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return F.coalesce(F.col(key).cast("long") if integral else F.xxhash64(key), F.lit(0).cast("long"))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", grown: int | None = None) -> DataFrame:
    """docs with the column shard, and grown_shard where there will be `grown` shards; existing columns of these names go.

    Key and number of shards alone decide, so rows of equal key (null too, whose key is 0) are in one shard, and with more
    shards a row stays or goes to a new one. Nothing is shuffled; only the key goes through Arrow.
    """
    ship(docs.sparkSession)
    k, s = unused("k", docs), unused("s", docs)
    out = docs.drop("shard", "grown_shard").withColumn(k, stable_key(docs, key)).withColumn(s, shard_of(F.col(k), shards, *([] if grown is None else [grown])))
    out = out.withColumn("shard", F.col(f"{s}.s0"))
    return (out if grown is None else out.withColumn("grown_shard", F.col(f"{s}.s1"))).drop(k, s)


def with_slots(placed: DataFrame, *order: str) -> DataFrame:
    """placed (shard, ...) with slot, the place within the shard in the given order, from 0 without gaps.

    Rows that agree in shard and order are numbered in any order. The rows, which should be narrow as they are written
    twice, are dealt to ranges of (shard, order) and numbered where they lie; the ranges' and shards' sizes, one row each,
    are added up and sent to them. Ties are broken by where a row was read, so that no group of equal rows must share a task.
    """
    spark = placed.sparkSession
    tie, at, lo = unused("tie", placed), unused("at", placed), (1 << 33) - 1
    rows = cut(placed.withColumn(tie, F.monotonically_increasing_id()))  # ranges are sampled from it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["shard", *order, tie]
    rows = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id()))
    part, before, first = unused("part", rows), unused("before", rows), unused("first", rows)
    sizes = rows.groupBy("shard", F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    # a row a range, and a row a shard: both as many as the settings and the caller say
    running = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy(part).agg(F.sum("n").alias("n")).select(part, running.alias(before))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", ahead.alias(first))
    out = rows.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(ranges), part).join(F.broadcast(shards), "shard")
    return out.withColumn("slot", F.col(before) + F.col(at).bitwiseAND(lo) - F.col(first)).drop(part, before, first, at)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every document.

    A null text has no bytes: size 1, checksum 0. Documents without doc_id share one shard; repeated rows are kept, each
    with a slot of its own. An empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    held = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(held) + 1).cast("long").alias("size"), F.crc32(held).alias("text_crc32"))
    out = with_slots(assign(rows, shards, grown=shards + 1), "doc_id", "text_crc32", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int, key: str = "doc_id", rows_per_file: int = 1_000_000) -> DataFrame:
    """Write docs as Parquet under folder/shard=N and return what was written, as read again.

    Rows go straight from where they are read into their shard's files, without a shuffle; a task writes a file a shard,
    split at rows_per_file. A docs without rows writes an empty table.
    """
    out = assign(docs, shards, key)
    out.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def grow_shards(spark: SparkSession, folder: str, grown_folder: str, old: int, new: int, key: str = "doc_id") -> DataFrame:
    """Of shards written by write_shards, write to grown_folder what leaves them when there are `new` instead of `old`.

    About 1 - old/new of the rows move, all of them into the shards from old on; the others needn't be touched. Readers of
    the grown set take of folder what assign() leaves in its shard, and all of grown_folder.
    """
    if not 1 <= old <= new:
        raise ValueError("shards are only appended")
    held = spark.read.parquet(folder)
    moved = assign(held.withColumnRenamed("shard", was := unused("was", held)), new, key).where(f"shard <> `{was}`").drop(was)
    moved.write.partitionBy("shard").parquet(grown_folder)
    return spark.read.schema(moved.schema).parquet(grown_folder)
