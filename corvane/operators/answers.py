"""Cited extractive answers, contexts and prompts from ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def rank_sentences(results: DataFrame, question: str) -> DataFrame:
    """doc_id, pos, sentence, score of the sentences of a few ranked results (doc_id, text, score), best first.

    A sentence of 20 characters or more counts once, where it comes first.
    """
    q = F.lit(question)
    terms = X.question_terms(q)
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)
    s = ranked.select("doc_id", "rank", F.col("score").alias("base"), F.posexplode(X.sentences(F.col("text"))).alias("pos", "raw"))
    s = s.withColumn("sentence", X.replaced(F.col("raw"), (r"\s+", " "))).where(F.length("sentence") >= 20)
    first = F.row_number().over(Window.partitionBy(F.lower("sentence")).orderBy("rank", "pos"))
    s = s.withColumn("nth", first).where("nth = 1")
    overlap = F.size(F.array_intersect(terms, X.tokens(F.col("sentence"))))
    coverage = overlap / F.greatest(F.lit(1), F.size(terms))
    score = 0.7 * F.col("base") + 3.0 * coverage + 0.4 * overlap + X.intent_bonus(q, F.col("sentence")) - 0.015 * F.col("pos") - 0.05 * F.col("rank")
    return s.select("doc_id", "rank", F.col("pos").cast("long").alias("pos"), "sentence", score.alias("score"))


def extractive_answer(ranked: DataFrame, question: str, most: int = 4, characters: int = 1400) -> DataFrame:
    """place, doc_id, sentence, source_number of the answer's sentences.

    The list stops at the first sentence that is 2.5 under the best or would exceed the characters; a best sentence
    with the form of an answer stands alone.
    """
    order = Window.orderBy(F.desc("score"), "rank", "pos")
    s = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("best", F.max("score").over(whole)).withColumn("strong", F.first(X.intent_bonus(F.lit(question), F.col("sentence")) >= 3.0).over(whole))
    s = s.withColumn("used", F.sum(F.length("sentence") + F.when(F.col("place") > 1, 1).otherwise(0)).over(upto))
    stop = (F.col("place") > 1) & ((F.col("score") < F.col("best") - 2.5) | (F.col("used") > characters) | F.col("strong"))
    s = s.withColumn("stopped", F.max(stop).over(upto)).where(~F.col("stopped"))
    s = s.withColumn("firsthand", F.min("place").over(Window.partitionBy("doc_id")))
    number = F.dense_rank().over(Window.orderBy("firsthand"))
    return s.select(F.col("place").cast("long").alias("place"), "doc_id", "sentence", number.cast("long").alias("source_number"))


def runtime_answer(hits: DataFrame, question: str, mode: str = "chat") -> DataFrame:
    """place, number, sentence of the answer from a few hits (doc_id, text, score): sentences that share words with the question."""
    asked = X.runtime_terms(F.lit(question))
    h = hits.withColumn("number", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy()))
    s = h.select("number", "hits", F.posexplode(X.runtime_sentences(F.col("text"))).alias("pos", "raw")).withColumn("sentence", F.trim("raw"))
    overlap = F.size(F.array_intersect(asked, X.runtime_terms(F.col("sentence"))))
    s = s.withColumn("score", overlap + F.least(F.length("sentence"), F.lit(400)) / 2000.0).where(((overlap > 0) | (F.col("hits") == 1)) & (F.col("sentence") != ""))
    order = [F.desc("score"), F.asc("number"), F.asc("pos")]
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy(X.casefold(F.col("sentence"))).orderBy(*order))).where("nth = 1")
    target = 6 if mode in ("explain", "study", "summary") else 3
    s = s.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= target)
    return s.select(F.col("place").cast("long").alias("place"), F.col("number").cast("long").alias("number"), F.concat("sentence", F.lit(" ["), F.col("number").cast("string"), F.lit("]")).alias("sentence"))


def assistant_confidence(matched: Column, terms: Column, best: Column) -> Column:
    coverage = F.least(F.lit(1.0), matched / F.greatest(F.lit(1), terms))
    return F.least(F.lit(0.95), 0.12 + 0.48 * coverage + 0.28 * (1.0 - F.exp(-best / 5.0)))


def runtime_confidence(hits: Column, backend: Column, general: Column) -> Column:
    return F.when(hits > 0, F.least(F.lit(0.98), 0.25 + 0.12 * hits)).when(backend & general, 0.35).otherwise(0.05)


def backend_confidence(sources: Column) -> Column:
    return F.when(sources > 0, F.least(F.lit(0.98), 0.45 + 0.08 * F.least(sources, F.lit(5)))).otherwise(0.25)


def context_pack(hits: DataFrame, most: int = 14_000) -> DataFrame:
    """number, block of the hits that go into a prompt: up to the first that would exceed `most` characters, one at least."""
    w = Window.orderBy(F.desc("score"), "doc_id")  # the hits are a top-k result
    h = hits.withColumn("number", F.row_number().over(w))
    block = F.concat(F.lit("[SOURCE "), F.col("number").cast("string"), F.lit("]\nTitle: "), F.col("title"), F.lit("\nLocation: document\nDomain: "), F.col("domain"), F.lit("\n"), F.trim("text"))
    h = h.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("over", F.max((F.col("used") > most) & (F.col("number") > 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.where(~F.col("over")).select(F.col("number").cast("long").alias("number"), "doc_id", F.length("block").cast("long").alias("characters"), F.sha2("block", 256).alias("block_sha256"))


def render_prompt(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: messages in order between control tokens, ready for the assistant's turn; unknown roles are users."""
    role = F.when(F.lower("role").isin("system", "user", "assistant"), F.lower("role")).otherwise("user")
    m = turns.select("conv_id", F.struct("turn", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim("text"), F.lit("\n")).alias("m")).alias("x"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a conversation's turns
    return g.select("conv_id", F.concat(F.lit("<|bos|>"), F.array_join(F.transform("xs", lambda x: x["m"]), ""), F.lit("<|assistant|>\n")).alias("prompt"))


def plain_prompt(turns: DataFrame) -> DataFrame:
    """conv_id, prompt as ROLE: content paragraphs."""
    m = turns.select("conv_id", F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("m")).alias("x"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return g.select("conv_id", F.concat(F.array_join(F.transform("xs", lambda x: x["m"]), "\n\n"), F.lit("\n\nASSISTANT:")).alias("prompt"))


def legal_notice(answer: Column) -> Column:
    told = F.lower(answer).rlike("not legal advice|lawyer|legal professional")
    return F.when(told, answer).otherwise(F.concat(answer, F.lit("\n\nThis is general information, not legal advice.")))
