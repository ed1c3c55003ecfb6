"""A kept index of terms: postings in blocks with bounds, so that a search reads the asked terms and few of their blocks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Documents in a block, about; folders that terms are dealt to; tokens of the corpus for which each folder gets another file.
BLOCK, BUCKETS, SLICE = 1000, 32, 1_000_000_000


@dataclass(frozen=True)
class TermIndex:
    """An index under a folder, in parts that are added one by one.

    A part is written under a name of its own and counts once a row of the table `commits` names it, so that readers see it
    whole or not at all; what a job that died has written is never read. postings: bucket, term, block, ids, tfs, lens (of the
    block's documents that have the term), n, max_tf, min_len. Blocks are dealt by the hash of the document, so that
    no term has more than a block's documents in a row.

    parts: (part, docs, tokens) to search instead of those that `commits` names, for a caller with commits of its own.
    A part whose docs are negative takes its documents away: its postings are subtracted, so that what is left is found
    and scored as if they had never been added.
    """

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    parts: tuple[tuple[str, int, int], ...] | None = None

    def add(self, docs: DataFrame, commit: bool = True) -> TermIndex:
        """Index the text of documents (doc_id, text); those of null doc_id can't be found and are left out. Nothing is removed or told apart by doc_id."""
        part = self.write(docs)
        if commit:
            self.spark.createDataFrame([part], "part string, docs long, tokens long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return self

    def write(self, docs: DataFrame) -> tuple[str, int, int]:
        """A part of documents (doc_id, text) that nothing names yet: its name, documents and tokens."""
        name = uuid.uuid4().hex
        held = docs.where("doc_id is not null").select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
        sums = held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("tokens")).first()
        block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sums["docs"] // BLOCK))).alias("block")
        each = held.select("doc_id", F.size("t").alias("len"), block, F.explode_outer("t").alias("term")).where("term is not null").withColumn("bucket", self._bucket(F.col("term")))
        each = each.withColumn("slice", F.pmod(F.xxhash64("term", "block"), F.lit(4 + sums["tokens"] // SLICE)))  # so many tasks a bucket
        # one exchange: what follows groups by these two and more
        tf = each.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "block", "doc_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        rows = tf.groupBy("bucket", "slice", "term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("p"))
        rows = rows.select("bucket", "term", F.concat(F.lit(f"{name[:12]}-"), "block").alias("block"), F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"),
                           F.size("p").cast("long").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.len").alias("min_len"))
        rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.folder}/parts/{name}")
        return name, sums["docs"], sums["tokens"]

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def postings(self, terms: list[str]) -> tuple[DataFrame | None, int, float]:
        """The rows of terms with their sign (-1: taken away), read from their buckets alone; documents; their average length."""
        parts = self.parts
        if parts is None:  # a row a call of add()
            parts = [tuple(r) for r in self.spark.read.schema("part string, docs long, tokens long").parquet(f"{self.folder}/commits").collect()]
        n = sum(docs for _, docs, _ in parts)
        named = [(f"{self.folder}/parts/{part}", 1 if docs > 0 else -1) for part, docs, tokens in parts if tokens]
        if not named or not terms or n <= 0:
            return None, n, 0.0
        asked = self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).distinct().collect()
        tables = [self.spark.read.option("basePath", p).parquet(p).withColumn("sign", F.lit(sign)) for p, sign in named]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        return rows.where(F.col("bucket").isin([r["b"] for r in asked]) & F.col("term").isin(terms)), n, sum(tokens for _, _, tokens in parts) / n

    def search(self, terms: list[str], k: int = 10, k1: float = 1.5, b: float = 0.75, seeds: int = 4, among: DataFrame | None = None) -> DataFrame:
        """doc_id, score of the k best documents by BM25 term scores, best first, the smaller doc_id among equals.

        What a block's greatest frequency and least length could score bounds all of its documents. The blocks of greatest
        bound are scored first; then only blocks that could reach the k-th score found there. The result is that of a whole scan.
        among: (doc_id) of the documents that may be found; frequencies and lengths stay those of all.
        """
        rows, bounds, scored = self._ranking(terms, k, k1, b, among)
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, score double")
        away = rows.where("sign < 0")  # belongs to documents of any block, so it is always read
        chosen = lambda of: of if all(docs >= 0 for _, docs, _ in self.parts or ()) else of.unionByName(away)
        first = bounds.orderBy(F.desc("most"), "block").limit(seeds)
        best = [r["score"] for r in scored(chosen(rows.where("sign > 0").join(F.broadcast(first.select("block")), "block"))).collect()]  # k rows
        least = min(best) if len(best) == k else float("-inf")
        return scored(chosen(rows.where("sign > 0").join(bounds.where(F.col("most") >= least).select("block"), "block", "left_semi")))

    def read_share(self, terms: list[str], k: int = 10, k1: float = 1.5, b: float = 0.75) -> float:
        """The share of the terms' blocks that could hold one of the k best."""
        rows, bounds, scored = self._ranking(terms, k, k1, b)
        least, n = scored(rows).agg(F.min("score"), F.count(F.lit(1))).first() if rows is not None else (None, 0)
        return 1.0 if n < k else bounds.agg(F.avg((F.col("most") >= least).cast("double"))).first()[0]

    def _ranking(self, terms: list[str], k: int, k1: float, b: float, among: DataFrame | None = None):
        """The terms' rows, what each block could score, and how rows of blocks become the k best."""
        rows, n, avg = self.postings(list(dict.fromkeys(terms)))
        if rows is None:
            return None, None, None
        found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum(F.col("n") * F.col("sign")).alias("df")).collect()}  # a row a term
        df = F.try_element_at(F.create_map(*[F.lit(x) for p in (found or {"": 0}).items() for x in p]), F.col("term")).cast("double")
        part = lambda tf, size: F.log(1.0 + (F.lit(float(n)) - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg)))
        bounds = rows.where("sign > 0").select("block", part(F.col("max_tf").cast("double"), F.col("min_len")).alias("most")).groupBy("block").agg((F.sum("most") + 1e-6).alias("most"))

        def scored(of: DataFrame) -> DataFrame:
            each = of.select("term", "sign", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
            each = each.select("term", "sign", F.col("p.ids").alias("doc_id"), F.col("p.tfs").cast("double").alias("tf"), F.col("p.lens").alias("len"))
            found = each if among is None else each.join(among.select("doc_id"), "doc_id", "left_semi")
            sums = found.groupBy("doc_id").agg(F.round(F.sum(F.col("sign") * part(F.col("tf"), F.col("len"))), 6).alias("score"), F.sum("sign").alias("live"))
            return sums.where("live > 0").select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)

        return rows, bounds, scored
