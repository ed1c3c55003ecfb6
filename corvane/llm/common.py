"""Session, table and numpy helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table

__all__ = ["ship", "table"]

#: Runs of these are words: everything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Key of a row whose doc_id is null; it sorts before every other.
NO_ID = -(1 << 63)
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder, so that what follows never computes it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """cut() for large tables: a compressed Parquet table, which doesn't keep df's shuffles in use as a checkpoint does."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more.

    It does so once the driver's garbage collector has found them, which may not run for long by itself. Python tells of
    dropped references in a thread that looks for them ten times a second.
    """
    for _ in range(2):
        time.sleep(0.2)
        spark._jvm.System.gc()


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that no table has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def has_repeats(docs: DataFrame) -> bool:
    """Whether any doc_id, null too, is that of several rows."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def keyed(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """text and the key (k, sub) of a row, and carry as rest; k is the doc_id, or NO_ID for null.

    Rows with equal doc_id and text are one document; rows that share only the doc_id are told apart by
    the hash of the text in sub, which is 0 where doc_ids are unique. A null text is empty.
    """
    repeated = has_repeats(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
        # always 0, but neither a constant nor nullable: joins and groups have the same two keys and share their exchange
        (F.xxhash64(text) if repeated else F.coalesce(F.col("doc_id").cast("long") % 1, F.lit(0).cast("long"))).alias("sub"),
        *([] if carry is None else [carry.alias("rest")]),
    )


def doc_ids(k: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(k, NO_ID), pa.scalar(None, pa.int64()), k)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow column and where each begins (one more than strings)."""
    strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    if strings.null_count:
        strings = strings.fill_null("" if not pa.types.is_binary(strings.type) else b"")
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    off = np.frombuffer(strings.buffers()[1], np.int64 if wide else np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    held = strings.buffers()[2]
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes in the column, one row at least."""
    _, off = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the constants of a well-known finaliser)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
    return out


_UP = _DOWN = np.zeros(0, U)


def spans_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[begin:end], mixed with the length; one pass over data."""
    global _UP, _DOWN
    if len(_UP) <= len(data):
        _UP, _DOWN = _powers(_BASE, len(data) + 1024), _powers(_INVERSE, len(data) + 1024)
    run = np.empty(len(data) + 1, U)
    run[0] = 0
    run[1:] = data
    run[1:] += U(1)
    run[1:] *= _UP[: len(data)]
    np.cumsum(run, out=run)
    out = run[end]
    out -= run[begin]
    out *= _DOWN[begin]
    out += (end - begin).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and how many words begin before each string (one more than strings)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = off[:-1][(off[:-1] < off[1:])]
    first[starts] |= solid[starts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = starts[1:] - 1 if len(starts) > 1 else starts[:0]
    last[ends] |= solid[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, off)


def windowed(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out + U(0x9E3779B97F4A7C15)) ^ h[i : i + n] if k <= 3 else out * U(0x9FB21C651E98DF25) + h[i : i + n]
    return mix(out)


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document and where each document's begin.

    at: where each document's words begin in h. A document of 1 to k-1 words has one shingle, of all its words.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    pos = np.arange(to[-1]) - to[:-1][owner] + at[:-1][owner]
    grams = windowed(np.concatenate([h, np.zeros(k, U)]), k)
    out = grams[pos] if len(pos) else np.zeros(0, U)
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = np.full(1, n[d], U)
        for i in range(at[d], at[d + 1]):
            x = mix(x * U(0x9FB21C651E98DF25) + h[i : i + 1])
        out[to[d]] = x[0]
    return out, to
