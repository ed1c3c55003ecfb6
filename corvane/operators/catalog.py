"""Catalog of documents: duplicates, statistics, listing, updates and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import written


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_first(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key by order, one with null before all others; among equals the one of the least hash.

    Only keys, orders and hashes are aggregated; rows are joined once.
    """
    key_name, mark_name, of, first_name = (unused(x, df) for x in ("key", "mark", "of", "first"))
    mark = F.struct(order.alias("o"), F.xxhash64(*df.columns).alias("h"))
    keyed = df.withColumns({key_name: key, mark_name: mark})
    first = keyed.groupBy(F.col(key_name).alias(of)).agg(F.min(mark_name).alias(first_name))
    out = keyed.join(first, F.col(key_name).eqNullSafe(F.col(of)) & F.col(mark_name).eqNullSafe(F.col(first_name)))
    return out.dropDuplicates([key_name]).drop(key_name, mark_name, of, first_name)  # only whole repeated rows are left to drop


def dedup_keep_first(docs: DataFrame) -> DataFrame:
    """Non-empty documents, one of each content hash: the first by doc_id."""
    return keep_first(docs.where(F.trim("text") != ""), X.content_hash(F.col("text")), F.col("doc_id"))


def import_report(docs: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """status (added or duplicate) and the document that a duplicate repeats, as if imported in order of doc_id.

    present: (content_sha256) of what the catalog holds already.
    A row without text is one of the documents without content; of repeated rows of a doc_id one is first.
    """
    hashed = docs.select("doc_id", X.file_hash(F.col("text")).alias("sha256"), X.content_hash(F.col("text")).alias("content_sha256"))
    rows = written(hashed.withColumn("row", F.monotonically_increasing_id()))  # hashes only; the numbers of rows stay what they are
    first = rows.groupBy(F.col("content_sha256").alias("content")).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    out = rows.join(first, F.col("content_sha256").eqNullSafe(F.col("content"))).withColumn("original_id", F.col("first.doc_id"))
    new = F.col("row") == F.col("first.row")
    if present is not None:
        known = present.select(F.col("content_sha256").alias("held")).distinct()
        out, new = out.join(known, F.col("content_sha256") == F.col("held"), "left"), new & F.col("held").isNull()
    return out.select("doc_id", "sha256", "content_sha256", "original_id", F.when(new, "added").otherwise("duplicate").alias("status"))


def library_stats(docs: DataFrame) -> DataFrame:
    """Documents, distinct sources and characters by domain (lang stands in for it)."""
    return docs.groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.sum(F.length("text")).alias("characters"))


def learning_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents, sections, chunks and words of what was learned, in one row."""
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.lit(1)).alias("sections"), F.sum(X.unicode_word_count(F.col("text"))).alias("words"))
    return a.crossJoin(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))))  # one row each


def list_documents(docs: DataFrame, domain: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents newest first, with title and size; domain None or all: every one."""
    out = docs if domain in (None, "all") else docs.where(F.col("lang") == domain)
    out = out.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("domain"), F.octet_length("text").cast("long").alias("size_bytes"))
    return out.orderBy(F.desc("doc_id")) if limit is None else out.orderBy(F.desc("doc_id")).limit(limit)


def update_metadata(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the lang of changes (doc_id, new_lang) where there is one."""
    return docs.join(changes, "doc_id", "left").withColumn("lang", F.coalesce("new_lang", "lang")).drop("new_lang")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def replace_same_name(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """new, and of old what no new row has the name of, without regard to case."""
    names = new.select(X.casefold(F.col(name)).alias("__n")).distinct()
    return old.join(names, X.casefold(F.col(name)) == F.col("__n"), "left_anti").unionByName(new)


def export_corpus(docs: DataFrame) -> DataFrame:
    """One record per non-empty section: text, title, source, domain."""
    text = X.normalize(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source", F.col("lang").alias("domain")).where("text <> ''")


def feedback_export(rows: DataFrame) -> DataFrame:
    """Prompts with the answer to learn: corrected if there is one, else the response, of rows approved, corrected or rated 1."""
    corrected = F.nullif(F.trim("corrected_response"), F.lit(""))
    kept = rows.where(F.col("approved") | corrected.isNotNull() | (F.col("rating") == 1))
    return kept.select("id", "prompt", F.coalesce(corrected, F.col("response")).alias("answer"))


def last_of(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
