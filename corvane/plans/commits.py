"""A library that lasts: documents under a folder, changed by commits that readers see whole or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking
from ..operators.numbering import with_row_numbers
from ..operators.term_index import TermIndex
from ..scratch import discard, scratch, written

COMMIT = "version long, part string, base boolean, documents long, removed long, changed long, last_doc long, last_chunk long, terms array<struct<part:string,docs:long,tokens:long>>, most int, overlap int, indexed boolean"
DOCUMENT = "doc_id long, first_chunk long, n_chunks long, name string, source string, title string, domain string, kind string, size_bytes long, sha256 string, content_sha256 string, text string"
CHANGE = "doc_id long, version long, title string, domain string, kind string"


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this change counts."""


@dataclass(frozen=True)
class Snapshot:
    """A library as of one commit; all that is read from it is of that state, whatever is committed meanwhile."""

    spark: SparkSession
    folder: str
    commits: tuple

    @property
    def version(self) -> int:
        return self.commits[-1]["version"] if self.commits else 0

    def _since_base(self) -> list:
        base = max((i for i, c in enumerate(self.commits) if c["base"]), default=0)
        return list(self.commits[base:])

    def _read(self, table: str, count: str, schema: str) -> DataFrame | None:
        paths = [f"{self.folder}/parts/{c['part']}/{table}" for c in self._since_base() if c[count]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    @cached_property
    def documents(self) -> DataFrame:
        """The documents there are, with their latest title, domain and kind."""
        docs = self._read("documents", "documents", DOCUMENT)
        if docs is None:
            return self.spark.createDataFrame([], DOCUMENT)
        removed, changes = self._read("removed", "removed", "doc_id long"), self._read("changes", "changed", CHANGE)
        if removed is not None:
            docs = docs.join(removed, "doc_id", "left_anti")
        if changes is None:
            return docs
        fields = ("title", "domain", "kind")
        latest = changes.groupBy("doc_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"new_{c}") for c in fields])
        docs = docs.join(latest, "doc_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields})
        return docs.select([c.split()[0] for c in DOCUMENT.split(", ")])

    def chunks(self, of: DataFrame | None = None) -> DataFrame:
        """chunk_id, doc_id, chunk_index, part, word_offset, location, text, word_count, title, domain, kind, source.

        Chunks are derived from a document's row, which keeps the id of its first: nothing is exchanged, and what is
        changed or deleted with a document can't be missed in its chunks.
        """
        docs = self.documents if of is None else of
        most, overlap = (self.commits[-1]["most"], self.commits[-1]["overlap"]) if self.commits else (1, 0)
        out = docs.select("*", F.posexplode(chunking.chunk_array(F.col("text"), most, overlap)).alias("at", "c"))
        place = F.concat(F.lit("document, part "), F.col("c.part").cast("string"), F.lit(", word "), (F.col("c.word_offset") + 1).cast("string"))
        return out.select((F.col("first_chunk") + F.col("at")).alias("chunk_id"), "doc_id", F.col("at").cast("long").alias("chunk_index"), "c.part", "c.word_offset", place.alias("location"), "c.text", "c.word_count", "title", "domain", "kind", "source")

    def search(self, question: str, limit: int = 6, where: Column | None = None) -> DataFrame:
        """The best chunks by their terms, with score; `where` is asked of their documents. Frequencies are those of all chunks."""
        parts = tuple((p["part"], p["docs"], p["tokens"]) for c in self._since_base() for p in c["terms"])
        terms = list(self.spark.range(1).select(X.tokens(F.lit(question))).first()[0])
        index = TermIndex(self.spark, f"{self.folder}/terms", parts=parts)
        among = None if where is None else self.documents.where(where).select(F.explode(F.expr("sequence(first_chunk, first_chunk + n_chunks - 1)")).alias("doc_id"))
        hits = [(r["doc_id"], r["score"]) for r in index.search(terms, limit, among=among).collect()]  # limit rows
        held = [(F.col("first_chunk") <= i) & (F.col("first_chunk") + F.col("n_chunks") > i) for i, _ in hits]
        owners = self.documents.where(sum_or(held))
        scores = self.spark.createDataFrame(hits, "chunk_id long, score double")
        return self.chunks(owners).join(F.broadcast(scores), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # limit rows


def sum_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def starts(rows: DataFrame, number: str, size: str, name: str, span: int = 10_000) -> DataFrame:
    """rows with the running sum of size before each, in order of their dense numbers; a row a span meets in one window."""
    dealt = rows.withColumn("span", F.floor(F.col(number) / span))
    totals = dealt.groupBy("span").agg(F.sum(size).alias("total"))
    before = totals.select("span", F.coalesce(F.sum("total").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum(size).over(Window.partitionBy("span").orderBy(number)) - F.col(size)
    return dealt.withColumn("inside", inside).join(before, "span").withColumn(name, F.col("inside") + F.col("before")).drop("span", "inside", "before")


@dataclass(frozen=True)
class StoredLibrary:
    """Documents and their chunks under a folder.

    A change writes Parquet under a name of its own, then one commit file named by the next version, moved into place only
    if no such version is there: a reader sees a change whole or not at all, what a dead job left is never read, and of
    two writers that started from the same version the second gets Conflict. It needs a file system whose rename
    is atomic (HDFS and the like). Ids of documents and chunks count on from the last ones and are never used again.

    most, overlap: words of a chunk and shared by neighbours; indexed: keep postings of the chunks, for `search`. The first
    commit fixes these.
    """

    spark: SparkSession
    folder: str
    most: int = 220
    overlap: int = 40
    indexed: bool = True

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The library now, or as it was at a version."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return Snapshot(self.spark, self.folder, ())
        rows = self.spark.read.schema(COMMIT).json(f"{self.folder}/commits").orderBy("version").collect()  # a row a commit
        if rows and (rows[0]["most"], rows[0]["overlap"], rows[0]["indexed"]) != (self.most, self.overlap, self.indexed):
            raise ValueError("the library was made with other most, overlap or indexed")
        return Snapshot(self.spark, self.folder, tuple(r for r in rows if version is None or r["version"] <= version))

    def add(self, docs: DataFrame, replace_same_name: bool = False) -> DataFrame:
        """Import documents (doc_id, text, and if there are: name, source, title, domain, kind); key, status, doc_id of each row.

        key is the caller's doc_id, which only gives the order. status: added; duplicate, with doc_id of the document that has
        its bytes, or its text but for case and white space; empty, where it has no word (null texts too). Rows may repeat.
        domain auto, empty or null is inferred. With replace_same_name, documents that the library held under the name of a
        row that isn't a duplicate of its bytes leave in the same commit, unless the batch has their bytes too.
        """
        snap, part = self.snapshot(), uuid.uuid4().hex
        rows, kept = self._rows(docs), scratch(self.spark, "import")
        schema = rows.schema
        rows.write.parquet(kept)  # numbers of rows stay what they are
        rows = self.spark.read.schema(schema).parquet(kept)
        asked = rows.select("row", "key", "sha256", "content_sha256", X.casefold(F.col("name")).alias("folded"), (F.col("n_chunks") == 0).alias("empty"))
        held = snap.documents.select("doc_id", "sha256", "content_sha256", X.casefold(F.col("name")).alias("folded"))
        asked = asked.join(held.groupBy("sha256").agg(F.min("doc_id").alias("same_bytes")), "sha256", "left")
        gone = held.select("doc_id").limit(0)
        if replace_same_name:
            names = asked.where("same_bytes is null and not empty").select("folded").distinct()
            stay = asked.where("same_bytes is not null").select(F.col("same_bytes").alias("doc_id")).distinct()
            gone = written(held.join(names, "folded", "left_semi").select("doc_id").join(stay, "doc_id", "left_anti"))
            held = held.join(gone, "doc_id", "left_anti")
        asked = asked.join(held.groupBy("content_sha256").agg(F.min("doc_id").alias("same_text")), "content_sha256", "left")
        asked = written(asked.select("row", "key", "content_sha256", "empty", F.coalesce("same_bytes", "same_text").alias("same")))
        first = asked.where("same is null and not empty").groupBy("content_sha256").agg(F.min(F.struct("key", "row")).alias("f"))
        new = first.select(F.col("f.key").alias("key"), F.col("f.row").alias("row"), "content_sha256").join(rows.select("row", "n_chunks"), "row")
        new = starts(with_row_numbers(written(new), "number", "key", "row"), "number", "n_chunks", "start")
        last_doc, last_chunk = (snap.commits[-1]["last_doc"], snap.commits[-1]["last_chunk"]) if snap.commits else (0, -1)
        new = written(new.select("row", "content_sha256", (F.col("number") + last_doc + 1).alias("doc_id"), (F.col("start") + last_chunk + 1).alias("first_chunk"), "n_chunks"))
        n, chunks = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
        at = f"{self.folder}/parts/{part}"
        given = new.select(F.col("row").alias("new_row"), F.col("content_sha256").alias("content"), F.col("doc_id").alias("new_id"))
        report = asked.join(given, (F.col("content_sha256") == F.col("content")) & F.col("same").isNull() & ~F.col("empty"), "left")
        status = F.when(F.col("empty"), "empty").when(F.col("row") == F.col("new_row"), "added").otherwise("duplicate")
        report.select("key", status.alias("status"), F.coalesce("same", "new_id").alias("doc_id")).write.parquet(f"{at}/report")
        if n:
            columns = [c.split()[0] for c in DOCUMENT.split(", ")]
            rows.drop("content_sha256", "n_chunks").join(new, "row").select(columns).write.parquet(f"{at}/documents")
        discard(self.spark, kept)  # the batch's texts are in the part now
        removed = gone.count() if replace_same_name else 0
        if removed:
            gone.write.parquet(f"{at}/removed")
        if n or removed:
            fresh = self.spark.read.schema(DOCUMENT).parquet(f"{at}/documents") if n else None
            self._commit(snap, part, documents=n, removed=removed, last_doc=last_doc + n, last_chunk=last_chunk + chunks, terms=self._terms(snap, fresh, gone if removed else None))
        return self.spark.read.parquet(f"{at}/report")

    def delete(self, ids: DataFrame) -> int:
        """Documents (doc_id) that the library has leave it, with their chunks and postings; how many."""
        snap, part = self.snapshot(), uuid.uuid4().hex
        gone = written(snap.documents.select("doc_id").join(ids.select("doc_id"), "doc_id", "left_semi"))
        n = gone.count()
        if n:
            gone.write.parquet(f"{self.folder}/parts/{part}/removed")
            self._commit(snap, part, removed=n, terms=self._terms(snap, None, gone))
        return n

    def update(self, changes: DataFrame) -> int:
        """Set title, domain, kind (those of them that changes has) by doc_id; how many documents.

        Null and blank values keep what is there, ids that the library doesn't have count for nothing, and of repeated rows of a doc_id
        the greatest value of each column holds.
        """
        snap, part = self.snapshot(), uuid.uuid4().hex
        fields = [F.max(F.nullif(F.trim(c), F.lit(""))).alias(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in ("title", "domain", "kind")]
        rows = changes.groupBy("doc_id").agg(F.lit(snap.version + 1).cast("long").alias("version"), *fields)
        rows = written(rows.join(snap.documents.select("doc_id"), "doc_id", "left_semi").where("coalesce(title, domain, kind) is not null"))
        n = rows.count()
        if n:
            rows.write.parquet(f"{self.folder}/parts/{part}/changes")
            self._commit(snap, part, changed=n)
        return n

    def compact(self) -> None:
        """One part with all there is; readers of the new version open nothing older."""
        snap, part = self.snapshot(), uuid.uuid4().hex
        at = f"{self.folder}/parts/{part}/documents"
        snap.documents.write.parquet(at)
        docs = self.spark.read.schema(DOCUMENT).parquet(at)
        self._commit(snap, part, base=True, documents=docs.count(), terms=self._terms(snap, docs, None))

    def _rows(self, docs: DataFrame) -> DataFrame:
        have = {c.lower() for c in docs.columns}
        text = F.coalesce(F.col("text"), F.lit(""))
        given = lambda c, other: F.coalesce(F.col(c).cast("string"), other) if c in have else other
        source = given("source", F.lit(""))
        title = given("title", given("name", source))
        domain = F.col("domain").cast("string") if "domain" in have else F.lit(None).cast("string")
        domain = F.when(F.coalesce(domain, F.lit("")).isin("", "auto"), X.infer_domain(title, text)).otherwise(domain)
        return docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("key"), given("name", title).alias("name"), source.alias("source"), title.alias("title"), domain.alias("domain"),
            given("kind", F.lit("txt")).alias("kind"), F.octet_length(text).cast("long").alias("size_bytes"), X.file_hash(text).alias("sha256"), X.content_hash(text).alias("content_sha256"),
            chunking.chunk_count(text, self.most, self.overlap).cast("long").alias("n_chunks"), text.alias("text"),
        )

    def _terms(self, snap: Snapshot, docs: DataFrame | None, gone: DataFrame | None) -> list[dict]:
        """Postings of the chunks of docs, and of those of the documents gone, to be taken away."""
        if not self.indexed:
            return []
        of = Snapshot(self.spark, self.folder, snap.commits or ({"most": self.most, "overlap": self.overlap},))
        index, out = TermIndex(self.spark, f"{self.folder}/terms"), []
        away = None if gone is None else snap.documents.join(gone, "doc_id", "left_semi")
        for rows, sign in ((docs, 1), (away, -1)):
            if rows is not None:
                name, n, tokens = index.write(of.chunks(rows).select(F.col("chunk_id").alias("doc_id"), "text"))
                out.append({"part": name, "docs": sign * n, "tokens": sign * tokens})
        return out

    def _commit(self, snap: Snapshot, part: str, **values) -> None:
        last = snap.commits[-1] if snap.commits else {"last_doc": 0, "last_chunk": -1}
        row = {"version": snap.version + 1, "part": part, "base": False, "documents": 0, "removed": 0, "changed": 0, "last_doc": last["last_doc"], "last_chunk": last["last_chunk"], "terms": []}
        row |= {"most": self.most, "overlap": self.overlap, "indexed": self.indexed} | values
        fs = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        name = f"{row['version']:012}.json"
        held, at = (fs.Path(f"{self.folder}/commits/{n}") for n in (f"_{part}", name))  # readers pass over names with _
        system = at.getFileSystem(conf)
        out = system.create(held, False)
        out.write(json.dumps(row).encode())
        out.close()
        context = fs.FileContext.getFileContext(system.getUri(), conf)
        try:
            context.rename(held, at, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            system.delete(held, False)
            raise Conflict(f"version {row['version']} is there already") from e
