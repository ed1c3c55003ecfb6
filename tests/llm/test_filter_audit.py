"""The audit against a loop over orders and its SQL; the refinement against a dictionary of texts."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from corvane.llm.filter_audit import audit, block_hashes, refine, signed, with_duplicates
from corvane.llm.oracles import ORACLES
from corvane.llm.queries import op13_filter_audit

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, part int, mask string, blocks string, quality int"


def brute(rows, labels):
    import re

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        facts.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = mine
            for s, x in enumerate(o, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                total[x] += len(gone)
                out[part, "".join(o), s] = [len(left), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for o in permutations("ABCDE"):
            for s, x in enumerate(o, 1):
                out[part, "".join(o), s].append(total[x])
    return out


def rows_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in df.collect()}


def test_edges_against_brute_force(spark):
    long = "Word other # thing " * 300_000  # several blocks, and a near copy that differs in the last one
    rows = [(1, "a b c", "en"), (2, "a b c", "en"), (3, None, None), (4, "", "de"), (None, "a b c", "en"), (None, None, "en"), (5, long, "en"), (6, long[:-1] + "x", "en"), (7, long, None),
            (8, " ".join(f"w{i}" for i in range(250)), "de"), (8, " ".join(f"w{i}" for i in range(250)), "de"), (9, "UPPER" * 50, ""), (10, "a B c", "en"), (10, "a b c", "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (7, 1, None), (None, 1, 1), (8, 1, 0)]
    df = spark.createDataFrame([(*r, 1, "m", "b", 1) for r in rows], DOCS)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = rows_of(audit(df, lab))
    assert got == brute(rows, labels) and len(got) == 600 * 4
    assert audit(df.limit(0), lab).count() == 0 and len(rows_of(audit(df, lab.limit(0)))) == 2400


def test_whole_table(spark):
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = con.sql(ORACLES["op13_filter_audit"])
    got = sorted(map(tuple, op13_filter_audit(spark, SF).select(*want.columns).collect()))
    assert got == sorted(want.fetchall())


def test_refinement(spark):
    """Only texts that others equal are left, each class of one text; hashes that say nothing still give the same duplicates."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text or "" for r in docs.collect()]
    left = refine(signed(docs, F.xxhash64("text").alias("h"))).collect()
    assert len(left) == sum(texts.count(t) > 1 for t in set(texts) for _ in range(texts.count(t)))
    assert len({r.cls for r in left}) == len({r.h for r in left})
    want = {r.doc_id for r in with_duplicates(docs).where("same").collect()}
    least = {}
    for r in docs.orderBy("doc_id").collect():
        least.setdefault(r.text or "", r.doc_id)
    assert want == {r.doc_id for r in docs.collect() if r.doc_id != least[r.text or ""]}
    assert {r.doc_id for r in with_duplicates(docs, digest=lambda c, b: c).where("same").collect()} == want


def test_blocks(spark):
    sizes = [0, 1, 1023, 1024, 1025, 1024 + 16384, 1024 + 16384 + 1, 300_000]
    df = spark.createDataFrame([(n, "é" * (n // 2) + "x" * (n % 2)) for n in sizes], "n int, text string").withColumn("b", block_hashes(F.col("text")))
    assert [len(r.b) for r in df.orderBy("n").collect()] == [0, 1, 1, 1, 2, 2, 3, 4]
