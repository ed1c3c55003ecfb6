"""Leaks of benchmark items: verbatim, paraphrased and absent."""

import random

from corvane.llm.decontaminate import common_subsequence, drop_leaking, leaks


def corpus():
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    common = vocabulary[:40]
    word = lambda: r.choice(common) if r.random() < 0.5 else r.choice(vocabulary)
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(r.randint(15, 60)))) for i in range(30)]
    docs, want, may = [], set(), set()
    for i in range(400):
        body = text(r.randint(5, 300))
        if i % 8 == 0:
            item, words = items[i % 30]
            words = words.split()
            if i % 16 == 0:
                want.add((i, item))
            else:  # one word in ten replaced
                words = [w if r.random() > 0.1 else word() for w in words]
                may.add((i, item))
            at = r.randint(0, len(body))
            body[at:at] = [w.capitalize() + r.choice(["", ",", ".%%"]) for w in words]
        docs.append((i, " ".join(body)))
    return docs, items, want, may


def test_leaks(spark):
    docs, items, want, may = corpus()
    docs += [(1000, None), (1001, ""), (None, "x " + items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(items + [(90, None), (91, "a b"), (92, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in leaks(df, marks).collect()}
    assert want | {(None, 3)} <= set(got) and set(got) <= want | may | {(None, 3)}
    assert len(may & set(got)) >= 0.9 * len(may) and all(got[p] == 1 for p in want)
    kept = {r.doc_id for r in drop_leaking(df, marks).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert leaks(df, marks).count() == 0
    assert leaks(spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six")], "doc_id long, text string"), marks.limit(0)).count() == 0


def test_common_subsequence():
    assert common_subsequence([1, 2, 3, 4], [9, 2, 4, 3, 4]) == 3
    assert common_subsequence([1], []) == 0


def test_long_text_and_other_columns(spark):
    docs, items, _, _ = corpus()
    filler = " ".join(t for _, t in docs if t)
    rows = [(1, filler[: len(filler) // 2] + " " + items[5][1] + " " + filler, "x", 1.0, None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, overlap double, item_id string")
    got = [(r.doc_id, r.item_id) for r in leaks(df, spark.createDataFrame([(5, items[5][1], "x"), (5, items[5][1], "y")], "item_id long, text string, k string")).collect()]
    assert got == [(1, 5)]
    assert [r.doc_id for r in drop_leaking(df, spark.createDataFrame([(None, items[5][1])], "item_id long, text string")).collect()] == [2]


def test_short_items_verbatim(spark):
    docs, _, _, _ = corpus()
    r = random.Random(7)
    pool = sorted({w for _, t in docs for w in t.lower().replace(".%%", "").replace(",", "").split()})
    items = [(i, " ".join(r.choice(pool) for _ in range(4 + i % 12))) for i in range(480)]
    put, want = [], set()
    for i, (doc_id, t) in enumerate(docs):
        words = t.split()
        for item in (i % 480, (i + 240) % 480) if len(words) > 40 else ():
            at = r.randint(0, len(words))
            words[at:at] = ["|", *items[item][1].split(), "|"]
        put.append((doc_id, " ".join(words)))
    for doc_id, t in put:  # brute force: all words of the item, one after another
        plain = " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
        want |= {(doc_id, i) for i, x in items if f" {x} " in plain}
    assert len(want) > 500
    found = leaks(spark.createDataFrame(put, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x.overlap for x in found}
    by_length = {n: sum(p in got for p in want if 4 + p[1] % 12 == n) / sum(4 + p[1] % 12 == n for p in want) for n in range(4, 16)}
    assert by_length == dict.fromkeys(range(4, 16), 1.0) and all(got[p] == 1 for p in want)
