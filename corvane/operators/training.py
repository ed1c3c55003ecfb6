"""Conversations, chat examples, token blocks and byte-pair encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import with_row_numbers

# Control tokens in the order of their ids; byte b is token 6 + b, merges follow from 262.
SPECIAL = "<|pad|> <|bos|> <|eos|> <|system|> <|user|> <|assistant|>".split()
BYTE_OFFSET = len(SPECIAL)


def byte_tokens(c: Column) -> Column:
    """Token ids of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + BYTE_OFFSET)


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, user, assistant: each user turn and the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return t.where("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), F.col("t2").alias("assistant"))


def expand_query(pairs: DataFrame, questions: DataFrame, most: int = 18, titles: bool = False) -> DataFrame:
    """conv_id, expanded: a short or pronominal question with up to `most` new terms of the last three turns.

    Terms come newest turn first: names of both sides, source titles (array column titles, if told), then the user's words.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = pairs.withColumn("r", F.row_number().over(w)).where("r <= 3")
    names = F.regexp_extract_all(F.concat("user", F.lit(" "), F.substring("assistant", 1, 500)), F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"), F.lit(0))
    parts = [X.tokens(F.array_join(names, " ; ")), *([X.tokens(F.array_join("titles", " ; "))] if titles else []), X.tokens(F.col("user"))]
    terms = recent.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("r", F.concat(*parts).alias("t")))).alias("x"))  # three rows a conversation
    q = questions.join(terms, "conv_id", "left").withColumn("own", X.tokens(F.col("question")))
    pronouns = F.array(*map(F.lit, X.PRONOUN_TERMS))
    follow = (F.size("own") <= 6) | F.arrays_overlap("own", pronouns)
    fresh = F.slice(F.array_distinct(F.filter(F.flatten(F.transform("x", lambda e: e["t"])), lambda t: (F.length(t) > 2) & ~F.array_contains("own", t) & ~F.array_contains(pronouns, t))), 1, most)
    grown = F.when(follow & F.col("x").isNotNull() & (F.size(fresh) > 0), F.concat("question", F.lit(" "), F.array_join(fresh, " ")))
    return q.select("conv_id", F.coalesce(grown, F.col("question")).alias("expanded"))


def sft_messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages: the non-empty messages of known roles in order."""
    kept = turns.where(F.lower(F.trim("role")).isin("system", "user", "assistant") & (F.trim("text") != ""))
    m = kept.select("conv_id", F.struct("turn", F.lower(F.trim("role")).alias("role"), F.trim("text").alias("content")).alias("m"))
    return m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))  # a conversation's turns


def sft_tokens(messages: DataFrame) -> DataFrame:
    """conv_id, input_ids, labels: byte tokens of a chat; only assistant messages (role line included) have labels.

    -100 masks. The end token is labelled if anything is. Role markers are single control tokens.
    """
    ids = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.array(F.when(m["role"] == "system", 3).when(m["role"] == "user", 4).otherwise(5)), byte_tokens(F.concat(F.lit("\n"), m["content"], F.lit("\n")))).alias("ids"),
            (m["role"] == "assistant").alias("told"),
        ),
    )
    s = messages.select("conv_id", ids.alias("s"))
    some = F.exists("s", lambda x: x["told"])
    inputs = F.concat(F.array(F.lit(1)), F.flatten(F.transform("s", lambda x: x["ids"])), F.array(F.lit(2)))
    labels = F.concat(F.array(F.lit(-100)), F.flatten(F.transform("s", lambda x: F.when(x["told"], x["ids"]).otherwise(F.transform(x["ids"], lambda _: F.lit(-100))))), F.array(F.when(some, 2).otherwise(-100)))
    return s.select("conv_id", inputs.alias("input_ids"), labels.alias("labels"))


def pad_truncate(examples: DataFrame, block: int) -> DataFrame:
    """Both arrays cut to `block` and filled to it with the pad token and -100."""
    fit = lambda c, pad: F.concat(F.slice(c, 1, block), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(block) - F.size(c))))
    return examples.select("conv_id", fit("input_ids", 0).alias("input_ids"), fit("labels", -100).alias("labels"))


def train_val_split(docs: DataFrame, fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """doc_id, split: the first max(1, floor(n (1 - fraction))) documents by a seeded hash train, at most n - 1."""
    hashed = docs.select("doc_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256).alias("h"))
    key = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
    ranked = with_row_numbers(hashed.withColumn("key", key), "rank", "key", "doc_id")
    n = F.col("n")
    most = F.greatest(F.lit(1), F.floor(n * (1 - fraction)))
    train = F.when((F.lit(fraction) > 0) & (n > 1), F.least(most, n - 1)).otherwise(most)
    return ranked.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("doc_id", F.when(F.col("rank") < train, "train").otherwise("val").alias("split"))  # one row


def token_stream(docs: DataFrame) -> DataFrame:
    """text and offset: where the tokens of each row begin in the stream of all rows.

    The stream is every row's byte tokens between begin and end tokens, in order of doc_id (null first), then of the
    text's hash. Lengths alone are summed along the order, over ranges of documents; equal rows follow each other.
    """
    n = F.coalesce(F.octet_length("text"), F.lit(0)) + 2
    sized = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), n.cast("long").alias("n"))
    each = sized.groupBy("doc_id", "h").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("times"))
    at = running_offsets(each.withColumn("all", F.col("n") * F.col("times")), "all", "doc_id", "h")
    same = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.h") == F.col("a.h"))
    held = sized.dropDuplicates(["doc_id", "h"]).alias("d").join(at.alias("a"), same)
    return held.select("text", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("a.times") - 1), lambda i: F.col("offset") + i * F.col("a.n"))).alias("offset"))


def token_blocks(docs: DataFrame, block: int = 512, stride: int | None = None) -> DataFrame:
    """block_id, tokens, input_ids and labels of the blocks of block+1 tokens of the whole token_stream().

    Each document gives each block its own share of tokens, so that only a block's tokens meet. Labels are the inputs
    shifted by one. A stream that doesn't fill a block gives none.
    """
    step = stride or block
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 2)).first()[0] or 0
    last = (total - block - 1) // step

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for offset, text in zip(b.column("offset").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32) + BYTE_OFFSET
                t = np.concatenate([[1], raw, [2]]).astype(np.int32)
                first, end = max(0, -((block - offset) // step)), min(last, (offset + len(t) - 1) // step) + 1
                for lo in range(first, end, 2000):
                    rows = [(k, max(0, offset - k * step), t[max(0, k * step - offset) : k * step + block + 1 - offset]) for k in range(lo, min(end, lo + 2000))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["block_id", "at", "part"])

    parts = token_stream(docs).select("offset", "text").mapInArrow(cut, "block_id long, at long, part array<int>")
    whole = parts.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))  # block + 1 tokens
    tokens = whole.select("block_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("tokens"))
    return tokens.select("block_id", "tokens", F.slice("tokens", 1, block).alias("input_ids"), F.slice("tokens", 2, block).alias("labels"))


def block_digests(blocks: DataFrame) -> DataFrame:
    """block_id, n_tokens, first_token, last_token, checksum and label_checksum: sums of tokens by place, from 1."""
    add = lambda c: F.aggregate(F.transform(c, lambda t, i: t.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return blocks.select(
        "block_id", F.size("tokens").cast("long").alias("n_tokens"), F.element_at("tokens", 1).cast("long").alias("first_token"),
        F.element_at("tokens", -1).cast("long").alias("last_token"), add("tokens").alias("checksum"), add("labels").alias("label_checksum"),
    )


def write_tokens(docs: DataFrame, path: str, fraction: float = 0.1, block: int = 512) -> None:
    """Blocks of the train and the val documents as Parquet under path, and meta: documents and tokens of each."""
    split = train_val_split(docs, fraction).groupBy("doc_id").agg(F.min("split").alias("split"))  # rows of one doc_id stay together
    for name in ("train", "val"):
        mine = split.where(F.col("split") == name).select(F.col("doc_id").alias("__id"))
        token_blocks(docs.join(mine, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"), block).write.parquet(f"{path}/{name}")
    corpus_meta(docs, split).withColumn("vocabulary", F.lit(BYTE_OFFSET + 256)).coalesce(1).write.json(f"{path}/meta")


def running_offsets(sized: DataFrame, n: str, key: str, *more: str) -> DataFrame:
    """sized with offset: the sum of n over all rows before in the order of key (null first) and more, by ranges of keys
    whose sums alone meet in one window."""
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sized.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    block = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c <= F.col(key).cast("double")))
    dealt = sized.withColumn("b", F.when(F.col(key).isNull(), -1).otherwise(block))
    sums = dealt.groupBy("b").agg(F.sum(n).alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum(n).over(Window.partitionBy("b").orderBy(key, *more).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("own", F.coalesce(own, F.lit(0))).join(before, "b").select(*sized.columns, (F.col("own") + F.col("base")).cast("long").alias("offset"))


def corpus_meta(docs: DataFrame, split: DataFrame) -> DataFrame:
    """split, documents, tokens with begin and end tokens."""
    of = split.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("__id"), "split")
    return docs.join(of, F.col("doc_id").eqNullSafe(F.col("__id"))).groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 2).alias("tokens"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """left, right, n of neighbouring byte tokens; overlapping pairs count."""
    size = BYTE_OFFSET + 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                t = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64) + BYTE_OFFSET
                pair, n = np.unique(t[:-1] * size + t[1:], return_counts=True)
                total[pair] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found // size), pa.array(found % size), pa.array(total[found])], ["left", "right", "n"])

    return docs.select("text").mapInArrow(count, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def learning_rates(steps: DataFrame, base: float, least: float, warmup: int, total: int) -> DataFrame:
    """step, rate: a linear rise over the warm-up steps, then half a cosine down to the least rate."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("step") - warmup) / F.lit(float(max(1, total - warmup)))))
    fall = F.lit(least) + 0.5 * (1 + F.cos(F.pi() * part)) * (base - least)
    return steps.select("step", F.when(F.col("step") < warmup, base * (F.col("step") + 1) / F.lit(float(max(1, warmup)))).otherwise(fall).alias("rate"))


def epoch_rates(epochs: DataFrame, kind: str, base: float, decay: float = 0.95, least: float = 1e-6, every: int = 50, total: int = 100) -> DataFrame:
    """epoch, rate of the schedules constant, step, exponential, time and cosine; epochs from 1."""
    done = F.col("epoch") - 1
    kinds = {
        "constant": F.lit(base),
        "step": base * F.pow(F.lit(decay), F.floor(done / F.lit(every))),
        "exponential": base * F.pow(F.lit(decay), done),
        "time": F.lit(base) / (1 + decay * done),
        "cosine": least + 0.5 * (base - least) * (1 + F.cos(F.pi() * F.least(F.lit(1.0), done / F.lit(float(max(1, total - 1)))))),
    }
    if kind not in kinds:
        raise ValueError(f"no schedule {kind}")
    rate = kinds[kind] if kind == "constant" else F.greatest(F.lit(least), kinds[kind])
    return epochs.select("epoch", rate.alias("rate"))


def train_test_split(rows: DataFrame, key: str, size: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with split: max(1, round(n size)) rows test, chosen by a seeded hash; the order of rows is kept in key."""
    if not 0 < size < 1:
        raise ValueError("size must be between 0 and 1")
    hashed = rows.select(key, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 52)).alias("h"))
    ranked = with_row_numbers(hashed, "r", "h", key)
    n = F.broadcast(rows.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * F.lit(size))).alias("t")))  # one row
    return rows.join(ranked.crossJoin(n).select(key, F.when(F.col("r") < F.col("t"), "test").otherwise("train").alias("split")), key)


def sft_holdout(examples: DataFrame, key: str = "conv_id", seed: int = 42) -> DataFrame:
    """key, split: one in twenty examples validates, none of fewer than ten."""
    hashed = examples.select(key, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 52)).alias("h"))
    n = F.broadcast(examples.agg(F.count(F.lit(1)).alias("n")))  # one row
    held = F.when(F.col("n") >= 10, F.greatest(F.lit(1), F.floor(F.col("n") / 20))).otherwise(0)
    return with_row_numbers(hashed, "r", "h", key).crossJoin(n).select(key, F.when(F.col("r") < held, "val").otherwise("train").alias("split"))


def context_windows(docs: DataFrame, vocabulary: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, pos, context (ids of the `size` tokens before), target: ids from vocabulary (token, id); unknown words are 1, 0 begins.

    The one-hot form of a row has its ones at context[p] + p * vocabulary size.
    """
    t = docs.select("doc_id", F.posexplode(F.transform(X.language_tokens(F.col("text")), F.lower)).alias("pos", "token"))
    known = t.join(vocabulary, "token", "left").select("doc_id", "pos", F.coalesce("id", F.lit(1)).cast("long").alias("id"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.array(*[F.coalesce(F.lag("id", size - i).over(w), F.lit(0)).cast("long") for i in range(size)])
    return known.select("doc_id", F.col("pos").cast("long").alias("pos"), before.alias("context"), F.col("id").alias("target"))
