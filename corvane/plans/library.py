"""A library of documents as one object: what the operators need is kept as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics, answers, catalog, chunking, search


@dataclass(frozen=True)
class Library:
    """Documents (doc_id, text, source, title, location, domain, kind); every method returns a lazy DataFrame."""

    documents: DataFrame

    def add(self, documents: DataFrame) -> Library:
        """With new documents, but none whose content is in the library already."""
        have = self.documents.select(X.content_hash(F.col("text")).alias("__h")).distinct()
        new = catalog.dedup_keep_first(documents).join(have, X.content_hash(F.col("text")) == F.col("__h"), "left_anti")
        return Library(self.documents.unionByName(new))

    def delete(self, doc_ids: list[int]) -> Library:
        return Library(self.documents.where(~F.col("doc_id").isin(doc_ids)))

    def chunks(self, most: int = 220, overlap: int = 40) -> DataFrame:
        return chunking.chunk_documents(self.documents, most, overlap, 1)

    def search(self, question: str, limit: int = 6, domain: str | None = None) -> DataFrame:
        """Full-text hits, or substring hits where no document has a word of the question."""
        asked = list(self.documents.sparkSession.range(1).select(X.tokens(F.lit(question))).first()[0])
        where = None if domain in (None, "all") else F.col("domain") == domain
        hits = search.fts(self.documents, asked, limit, where) if asked else self.documents.limit(0).withColumn("score", F.lit(0.0))
        return hits if not hits.isEmpty() else search.substring_search(self.documents if where is None else self.documents.where(where), asked, limit)

    def ask(self, question: str, mode: str = "chat", limit: int = 6, domain: str | None = None) -> DataFrame:
        return answers.runtime_answer(self.search(question, limit, domain), question, mode)

    def summarize(self) -> DataFrame:
        return analytics.summaries(self.documents)

    def characters(self, least: int = 2) -> DataFrame:
        return analytics.character_profiles(analytics.name_sentences(self.documents), least)

    def stats(self) -> DataFrame:
        return self.documents.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("title").alias("titles"))
