"""Conversion of legacy ARC archives to WARC, and reading both."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices

CRLF = b"\r\n"
SEPARATOR = "\r\n\r\n"
#: Names of an ARC record's header fields, by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def arc_header(version: str, **fields: str) -> bytes:
    return " ".join(fields.get(f) or "-" for f in ARC_FIELDS[version]).encode() + b"\n"


VERSION_LINES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def version_block(version: str, name: str) -> bytes:
    """What an ARC archive begins with; it says how header lines are to be split."""
    told = f"{version} 0 corvane\n{VERSION_LINES[version]}\n".encode()
    return arc_header(version, url=f"filedesc://{name}", ip="0.0.0.0", date="20000101000000", mime="text/plain", status="200", offset="0", filename=name, length=str(len(told))) + told


def arc_record(version: str, name: str, url: str, date: str, block: bytes) -> bytes:
    return arc_header(version, url=quote(url, safe=":/?#[]@!$&'()*+,;=%~"), ip="0.0.0.0", date=date, mime="text/html", status="200", offset="0", filename=name, length=str(len(block))) + block


def write_arc(records: list[tuple[str, str, bytes]], version: str = "1", name: str = "corpus.arc") -> bytes:
    """An ARC archive of (url, 14-digit date, block) records, opened by its version block."""
    return b"".join(x + b"\n" for x in [version_block(version, name), *(arc_record(version, name, *r) for r in records)])


class Stream:
    """Bytes of an archive, inflated a piece at a time: gzip of one or many members, or plain."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self.pieces, self.held, self.at, self.passed = self._inflated(memoryview(content), step), b"", 0, 0

    @staticmethod
    def _inflated(content: memoryview, step: int) -> Iterator[bytes]:
        if bytes(content[:2]) != b"\x1f\x8b":
            yield from (bytes(content[i : i + step]) for i in range(0, len(content), step))
            return
        undo, at, left = zlib.decompressobj(47), 0, b""
        while at < len(content) or left:
            if not left:
                left, at = bytes(content[at : at + step]), at + step
            piece = undo.decompress(left, step)
            left = undo.unconsumed_tail
            if undo.eof:
                left, undo = undo.unused_data, zlib.decompressobj(47)
            if piece:
                yield piece
        if piece := undo.flush():
            yield piece

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.passed += self.at
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    @property
    def place(self) -> int:
        return self.passed + self.at

    def done(self, skip: bytes = b"") -> bool:
        """Whether nothing is left but bytes to skip."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in skip:
                self.at += 1
            if self.at < len(self.held):
                return False
            if not self._more():
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None if it doesn't come."""
        looked = 0
        while (end := self.held.find(mark, self.at + max(0, looked - len(mark)))) < 0:
            looked = len(self.held) - self.at
            if not self._more():
                return None
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None if there are fewer."""
        if len(self.held) - self.at < n:
            pieces, size = [self.held[self.at :]], len(self.held) - self.at
            while size < n and (piece := next(self.pieces, None)) is not None:
                pieces.append(piece)
                size += len(piece)
            self.passed, self.held, self.at = self.place, b"".join(pieces), 0
            if size < n:
                return None
        out, self.at = self.held[self.at : self.at + n], self.at + n
        return out


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC archive, gzipped or not, each with its header fields, place and block.

    The version block says how header lines are to be split; a record's block is as long as its line declares,
    whatever it holds. ValueError for a line that doesn't fit the version or a block that ends early.
    """
    stream, version = Stream(content), None
    while not stream.done(b"\r\n"):
        place, line = stream.place, stream.until(b"\n")
        if line is None:
            raise ValueError(f"ARC header line at byte {place} doesn't end")
        parts = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
        names = ARC_FIELDS.get(version or "")
        if not parts[-1].isdigit() or (names and len(parts) != len(names)):
            raise ValueError(f"not an ARC header line: {parts[:3]}")
        block = stream.take(int(parts[-1]))
        if block is None:
            raise ValueError(f"ARC block of the record at byte {place} ends early")
        if names is None:
            version = block[:1].decode("latin-1")
            if not parts[0].startswith("filedesc:") or version not in ARC_FIELDS:
                raise ValueError("an ARC archive begins with its version block")
            continue
        yield dict(zip(names, parts, strict=True)) | {"version": version, "place": place, "block": block}


def warc_fields(record: dict, archive: str = "") -> dict:
    """Identifier, date, target and payload digest that an ARC record gets as a WARC record.

    The identifier is that of its place in the archive, so that no two records have one. page_id: of the HTTP
    header X-Page-Id of the block.
    """
    head, found, payload = record["block"].partition(CRLF + CRLF)
    if not found or not head.startswith(b"HTTP/"):
        head, payload = b"", record["block"]
    said = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
    digest, d = hashlib.sha256(payload).hexdigest(), (record["date"] + "00000000000000")[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive} {record['place']} {record['url']} {record['date']} {digest}")
    return {"page_id": int(said[1]) if said else None, "id": f"<urn:uuid:{name}>", "date": date, "uri": record["url"], "digest": digest, "payload_bytes": len(payload), "payload": payload}


def write_arcs(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Pages (page_id, url, html) as gzipped ARC files under path, of versions 1 and 2 in turn, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = "12"[part % 2], f"part-{part}.arc"
        begun = False
        for batch in batches:
            for b in slices(batch, "html", 4_000_000):
                out = [] if begun else [version_block(version, name)]
                begun = True
                for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    head = HTTP_HEAD if i is None else HTTP_HEAD.replace(SEPARATOR, f"\r\nX-Page-Id: {i}{SEPARATOR}")
                    out.append(arc_record(version, name, u or "urn:unknown", date, (head + (h or "")).encode()))
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])

    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    held.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_arc(spark: SparkSession, path: str, glob: str = "*.gz") -> DataFrame:
    """page_id, id, date, uri, digest, payload_bytes and payload of each record of the ARC archives under path.

    Archives of version 1 or 2, gzipped (whole or by record) or not, are inflated a piece at a time; a payload that isn't
    UTF-8 has its wrong bytes replaced, digest and length are of the original. A malformed archive fails.
    """
    schema = "page_id long, id string, date string, uri string, digest string, payload_bytes long, payload string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] if n != "payload" else r[n].decode("utf-8", "replace") for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for record in parse_arc(b.column("content")[i].as_py()):
                    rows.append(warc_fields(record, b.column("path")[i].as_py()))
                    size += rows[-1]["payload_bytes"]
                    if len(rows) == 1000 or size > 4_000_000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def write_warc(made: DataFrame, path: str, least: int = 100) -> None:
    """Write the records of read_arc() as gzipped WARC files under path; equal payloads of at least `least` bytes once.

    The smallest page_id of equal payloads is the response, others revisit it; a page without page_id comes last.
    Rows that repeat that smallest page_id are responses too. Which payloads occur more than once is
    aggregated before it is joined, and Spark splits a payload that many pages share. A file is as large as the
    partition that it is written from (spark.sql.adaptive.advisoryPartitionSizeInBytes).
    """
    firsts = (
        made.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("digest").alias("digest_of"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "id"))).alias("o"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and o is not null")
        .select("digest_of", F.col("o.page_id").alias("first"), F.col("o.id").alias("first_id"))
    )
    made = made.join(firsts, made["digest"] == firsts["digest_of"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head, end = F.lit(HTTP_HEAD), F.lit("\r\n")
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))

    def line(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, end), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(revisit, F.col("first_id"))),
        line("X-Refers-To-Page", F.when(revisit, F.col("first").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        end,
        block,
    )
    made.select(record.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; gzip is undone in steps."""
    stream = Stream(content)
    while not stream.done():
        place, head = stream.place, stream.until(CRLF + CRLF)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
        block = stream.take(int(fields["content-length"]))
        if block is None or stream.take(4) != CRLF + CRLF:
            raise ValueError(f"WARC block of the record at byte {place} ends early")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, uri, record_type, payload_bytes, payload_digest, refers_to and payload of each record under path.

    The digest and length of a response are those of the bytes read; a revisit has those of its header, and no payload.
    """
    schema = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
    number = lambda x: int(x) if x is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for f, block in parse_warc(b.column("content")[i].as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    if f["warc-type"] == "revisit":
                        rows.append((number(f.get("x-page-id")), f["warc-target-uri"], "revisit", int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:"), number(f.get("x-refers-to-page")), None))
                    else:
                        rows.append((number(f.get("x-page-id")), f["warc-target-uri"], f["warc-type"], len(payload), hashlib.sha256(payload).hexdigest(), None, payload.decode()))
                    if len(rows) == 1000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to ARC files, convert those to WARC files, all in new folders of the shared one, and read them back.

    Null html is an empty payload; a null url becomes urn:unknown; spaces and controls in urls are escaped; repeated
    rows are records of their own; an empty table gives no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    old, new = scratch(spark, "arc"), scratch(spark, "warc")
    write_arcs(pages, old)
    write_warc(read_arc(spark, old), new)
    return read_warc(spark, new)
