"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .alignment import alignment_report
from .common import table
from .decontaminate import leaks
from .filter_audit import audit
from .fingerprints import fingerprints_with_edits
from .language_id import identify, profiles
from .mixing import copies
from .near_dedup import classes
from .quality import fit, score_documents
from .sharding import shard_documents
from .substring_dedup import remove_substrings
from .suffix_dedup import remove_repeats
from .url_filter import judge
from .warc import archive_round_trip


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = identify(docs, profiles(docs.where(~held_out)))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_url_filter, op4_source_mix, op5_substring_dedup, op6_quality_classifier, op7_arc_to_warc, op8_fingerprints, op9_decontaminate, op10_near_duplicates, op11_jump_shards, op12_token_alignment, op13_filter_audit)}

_OP4 = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE nth % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, source_size * 2e0 AS room FROM per),
filled AS (SELECT *, (SELECT sum(source_size) FROM per) * 15e-1 - coalesce(sum(room) OVER before, 0e0) AS rest,
  (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0e0) AS open, row_number() OVER (ORDER BY room / w, source ASC NULLS LAST) AS nth FROM weighed
  WINDOW before AS (ORDER BY room / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min(rest / open, nth) AS level FROM filled WHERE room * open > rest * w),
targets AS (SELECT source, source_size, least(room, coalesce(level * w, room)) AS target FROM filled, lev),
rated AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT / 4294967296e0 AS chance
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM counted
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES = {"op4_source_mix": _OP4, "op7_arc_to_warc": _OP7, **oracles.ORACLES}
