"""Jump hashing against its published values and a plain loop; slots; shards on disk that grow."""

import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corvane.llm.oracles import ORACLES
from corvane.llm.queries import op11_jump_shards
from corvane.llm.sharding import assign, grow_shards, jump, shard_documents, write_shards

SF = "/root/testdata/sf0.01"


def plain(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump():
    assert jump(np.array([2, 2201, 2202]), 100_001).tolist() == [80343, 22152, 15018]
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    for n in (1, 2, 16, 17, 1000):
        assert jump(keys, n).tolist() == [plain(int(k), n) for k in keys]
    now, then = jump(np.arange(50_000), 16), jump(np.arange(50_000), 17)
    assert np.all((now == then) | (then == 16)) and abs((now != then).mean() - 1 / 17) < 0.005
    assert np.bincount(now).min() > 0.9 * 50_000 / 16


def test_documents_against_plain(spark):
    rows = {r.doc_id: r for r in op11_jump_shards(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        r = rows[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key", plain(i, 16), plain(i, 17))
    for s in range(16):
        mine = sorted(i for i in rows if rows[i].shard == s)
        assert [rows[i].slot for i in mine] == list(range(len(mine)))


def test_documents_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op11_jump_shards"])
    got = op11_jump_shards(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_shard_edges(spark):
    rows = [(None, "a", 1), (None, "a", 1), (None, None, 2), (5, "é" * 100_000, 3), (5, "x", 3), (5, "x", 3), (6, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shard_documents(df).collect()
    assert len(out) == 7 and shard_documents(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.shard == plain(r.doc_id or 0, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_string_keys_and_growth(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("name"), F.lit(7).alias("shard"), "id")
    held = write_shards(df, str(tmp_path / "old"), 8, key="name")
    assert held.count() == 2000 and {r.shard for r in held.select("shard").distinct().collect()} == set(range(8))
    moved = grow_shards(spark, str(tmp_path / "old"), str(tmp_path / "new"), 8, 10, key="name")
    want = assign(df, 10, key="name").where("shard >= 8")
    assert sorted(map(tuple, moved.select("id", "shard").collect())) == sorted(map(tuple, want.select("id", "shard").collect()))
    assert write_shards(df.limit(0), str(tmp_path / "none"), 8, key="name").count() == 0
