"""Catalog, chunks, search and answers on a small story."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, answers, bpe, catalog, chunking, numeric, search, training
from corvane.plans.library import Library

STORY = (
    "Mira entered the old tower because Arun was missing. The tower stood beneath Greyhaven, a quiet town by the sea. "
    "Arun carried a silver key. When Mira found the key, Arun said that the door was open. Mira and Arun left before night."
)


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(1, STORY, "story", "fiction"), (2, "The party met in the hall. A contract binds the parties.", "law", "law"), (3, "def f(): return 1  # a function in python", "code", "programming")]
    return spark.createDataFrame([(i, t, n, n, "document", d, "txt") for i, t, n, d in rows], "doc_id long, text string, source string, title string, location string, domain string, kind string")


def test_question(shelf):
    lib = Library(shelf)
    said = " ".join(r.sentence for r in lib.ask("Why did Mira enter the tower?").orderBy("place").collect())
    assert "Arun was missing" in said and "[1]" in said
    hits = search.bm25(shelf, ["mira", "tower"], limit=3)
    top = answers.extractive_answer(answers.rank_sentences(hits, "Why did Mira enter the tower?"), "Why did Mira enter the tower?").collect()
    assert len(top) == 1 and "Arun was missing" in top[0].sentence


def test_filters_and_fallback(shelf):
    lib = Library(shelf)
    assert [r.doc_id for r in lib.search("python", domain="law").collect()] == []
    assert [r.doc_id for r in lib.search("art").collect()] == [2]  # no word art: found within party and parties
    assert lib.delete([1]).search("Mira").count() == 0
    assert lib.add(shelf).documents.count() == 3


def test_statistics_stay_global(shelf):
    both = {r.doc_id: r.score for r in search.bm25(shelf, ["the"], limit=None).collect()}
    some = {r.doc_id: r.score for r in search.bm25(shelf, ["the"], limit=None, where=F.col("domain") == "law").collect()}
    assert some == {2: both[2]}


def test_characters(shelf):
    named = analytics.name_sentences(shelf)
    m = {r.name: r.mentions for r in analytics.name_mentions(named).collect()}
    assert m["Mira"] >= 3 and "When Mira" not in m
    assert ("Mira", "Arun") in {(r.name, r.other) for r in analytics.name_relationships(named).collect()}
    assert analytics.find_character(analytics.character_profiles(named), "mir").first()["name"] == "Mira"


def test_summary(shelf):
    rows = analytics.summary_select(analytics.summary_scores(shelf), 2).where("doc_id = 1").orderBy("place").collect()
    assert len(rows) == 2 and rows[0].pos < rows[1].pos


def test_chunks(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(1, "\n\n".join([words(100), words(100), words(30)])), (2, words(400)), (3, "a b c"), (4, words(180) + "\n\nx y z")]
    got = {}
    for r in chunking.chunk_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.part, r.word_offset, r.word_count))
    assert sorted(got[1]) == [(1, 0, 100), (2, 0, 130)]
    assert sorted(got[2]) == [(1, 0, 180), (1, 145, 180), (1, 290, 110)]
    assert got[3] == [(1, 0, 3)] and got[4] == [(1, 0, 180)]
    n = chunking.numbered(spark.createDataFrame([(i % 7, i) for i in range(100)], "doc_id long, word_offset long"), "doc_id", "word_offset").orderBy("doc_id", "word_offset").collect()
    assert [r.chunk_id for r in n] == list(range(100))


def test_feedback(spark):
    rows = [(1, "p", "r", None, -1, False), (2, "p", "ok", " ", None, True), (3, "p", "bad", "correct", 0, False), (4, "p", "x", None, -1, True), (5, "p", "y", "  ", 1, False)]
    got = catalog.feedback_export(spark.createDataFrame(rows, "id long, prompt string, response string, corrected_response string, rating int, approved boolean")).orderBy("id").collect()
    assert [(r.id, r.answer) for r in got] == [(2, "ok"), (3, "correct"), (4, "x"), (5, "y")]


def test_duplicates(spark):
    rows = [(1, "Same text", "a"), (2, "same  TEXT", "b"), (3, "other", "c"), (4, " ", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in catalog.dedup_keep_first(df).collect()) == [1, 3]
    assert {r.doc_id: r.status for r in catalog.import_report(df).collect()} == {1: "added", 2: "duplicate", 3: "added", 4: "added"}


def test_chat_mask(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "robot", "x"), (2, 0, "user", "a"), (2, 1, "assistant", " ")]
    m = training.sft_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.input_ids, r.labels) for r in training.sft_tokens(m).collect()}
    line = lambda t: [6 + b for b in f"\n{t}\n".encode()]
    assert got[1][0] == [1, 3, *line("s"), 4, *line("hi"), 5, *line("yo"), 2]
    assert got[1][1] == [-100] * (1 + 4 + 5) + [5, *line("yo"), 2]
    assert set(got[2][1]) == {-100}


def test_bpe(spark):
    df = spark.createDataFrame([(1, "low lower lowest"), (2, "नमस्ते low")], "doc_id long, text string")
    merges = bpe.train(df, 268)
    assert merges.count() >= 3 and all(r.same for r in bpe.round_trip(df, merges).collect())
    assert merges.orderBy("rank").first()["n"] >= 4


def test_expansion(spark):
    pairs = spark.createDataFrame([(1, 0, "Tell me about Mira", "Mira lives in Greyhaven.")], "conv_id long, turn long, user string, assistant string")
    q = spark.createDataFrame([(1, "What did she do?"), (2, "What did she do?")], "conv_id long, question string")
    got = {r.conv_id: r.expanded for r in training.expand_query(pairs, q).collect()}
    assert "mira" in got[1] and "greyhaven" in got[1] and got[2] == "What did she do?"


def test_numbers(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i long, k long, v double")
    b = spark.createDataFrame([(0, 0, 5.0), (1, 0, 6.0)], "k long, j long, v double")
    assert {(r.i, r.v) for r in numeric.matmul(a, b).collect()} == {(0, 17.0), (1, 39.0)}
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (1, 0, 1.0)], "i long, j long, v double")
    assert {(r.i, r.j) for r in numeric.argmax(m).collect()} == {(0, 0), (1, 0)}
    assert {(r.i, r.j): round(r.v, 6) for r in numeric.softmax(m).collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0}
    rag = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "i long, row array<double>")
    assert [r.i for r in numeric.ragged(rag).collect()] == [1]
    p = spark.createDataFrame([(1, "CAT", "CUT"), (2, "HELLO WORLD", "HELLO WORD"), (3, "", "x")], "id long, expected string, predicted string")
    cer = {r.id: r.c for r in p.select("id", numeric.character_error_rate(F.col("expected"), F.col("predicted")).alias("c")).collect()}
    assert cer[1] == pytest.approx(1 / 3) and cer[3] == 1.0
    assert {r.id: r.wer for r in numeric.word_error_rate(p).collect()} == {1: 1.0, 2: 0.5, 3: 1.0}


def test_bitmap(spark):
    cells = spark.createDataFrame([(0, x, c == "#") for x, c in enumerate("##.#...##")], "line long, x long, active boolean")
    r = numeric.runs(cells)
    assert sorted((x.start, x.size) for x in r.collect()) == [(0, 2), (3, 1), (7, 2)]
    assert sorted((x.start, x.gap) for x in numeric.gaps(r).collect()) == [(3, 1), (7, 3)]
    dots = spark.createDataFrame([(0, 0, True), (0, 1, True), (5, 5, True)], "y long, x long, active boolean")
    assert numeric.denoise(dots).count() == 2


def test_generation(spark):
    df = spark.createDataFrame([(1, "the cat sat . the cat ran . the cat sat")], "doc_id long, text string")
    g = analytics.ngrams(df)
    assert {r.context: r.next for r in analytics.ngram_next(g).collect()}["the cat"] == "sat"
    assert analytics.generate(g, spark.createDataFrame([(1, "the cat")], "id long, prompt string"), 3).first()["text"].startswith("the cat sat")
    assert analytics.backoff_next(g, "cat").first()["next"] == "sat"


def test_glyphs(spark):
    art = ["##..#", "##...", "....#"]
    cells = spark.createDataFrame([(0, y, x, c == "#") for y, row in enumerate(art) for x, c in enumerate(row)], "line long, y long, x long, active boolean")
    got = {r.glyph: r.v for r in numeric.glyphs(cells, 3, 2).collect()}
    assert got == {1: [1.0] * 6, 2: [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]}


def test_merge_overlapping(spark):
    rows = [("t", 1, "b c d e"), ("t", 0, "a b c"), ("t", 2, ""), ("u", 0, "x")]
    got = {r.title: r.text for r in chunking.merge_overlapping(spark.createDataFrame(rows, "title string, chunk_id long, text string")).collect()}
    assert got == {"t": "a b c d e", "u": "x"}


def test_chunks_join_up_again(spark):
    text = " ".join(f"w{i}" for i in range(700))
    c = chunking.chunk_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = chunking.merge_overlapping(c.selectExpr("cast(doc_id as string) title", "word_offset chunk_id", "chunk text")).first()
    assert got.text == text


def test_schedules(spark):
    with pytest.raises(ValueError):
        training.epoch_rates(spark.range(1).select(F.lit(1).alias("epoch")), "none", 0.1)
    steps = spark.range(0, 30, 10).select(F.col("id").alias("step"))
    got = [r.rate for r in training.learning_rates(steps, 1.0, 0.1, 10, 20).orderBy("step").collect()]
    assert got == [pytest.approx(0.1), pytest.approx(1.0), pytest.approx(0.1)]


@pytest.mark.parametrize("block,stride", [(8, None), (8, 3), (5, 9), (500, None)])
def test_token_blocks(spark, block, stride):
    texts = ["abc", "", "é long text here", None, "x", "more and more"]
    rows = [*enumerate(texts), (2, texts[2]), (None, "no id")]  # a repeated row follows itself, no doc_id comes first
    stream = [t for x in ["no id", *texts[:3], *texts[2:]] for t in [1, *[6 + b for b in (x or "").encode()], 2]]
    step, want = stride or block, []
    for k in range(max(0, 1 + (len(stream) - block - 1) // step)):
        part = stream[k * step : k * step + block + 1]
        want.append((k, part, part[:-1], part[1:]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = training.token_blocks(df, block, stride)
    assert sorted((r.block_id, r.tokens, r.input_ids, r.labels) for r in blocks.collect()) == want
    digests = sorted((r.block_id, r.n_tokens, r.first_token, r.last_token, r.checksum) for r in training.block_digests(blocks).collect())
    assert digests == [(k, len(t), t[0], t[-1], sum(x * (i + 1) for i, x in enumerate(t))) for k, t, _, _ in want]


def test_write_tokens(spark, tmp_path):
    """Every row, those without or with repeated doc_id too, is in the blocks of one split."""
    rows = [(i, f"text {i} " * 20) for i in range(40)] + [(7, "text 7 " * 20), (None, "no id " * 20)]
    training.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), 0.2, 4)
    meta = {r.split: (r.documents, r.tokens) for r in spark.read.json(str(tmp_path / "t/meta")).collect()}
    assert sum(n for n, _ in meta.values()) == len(rows) and sum(t for _, t in meta.values()) == sum(len(t) + 2 for _, t in rows)
    for name, (_, tokens) in meta.items():
        assert spark.read.parquet(str(tmp_path / "t" / name)).count() == 1 + (tokens - 5) // 4


def test_import_report_keeps_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "A "), (3, None), (4, None), (5, "b"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = catalog.import_report(df).collect()
    assert len(got) == 7 and sorted(r.status for r in got) == ["added"] * 4 + ["duplicate"] * 3
    assert {r.doc_id: r.status for r in got if r.doc_id in (2, 3, 4, 5)} == {2: "duplicate", 3: "added", 4: "duplicate", 5: "added"}
    held = catalog.import_report(df.where("doc_id = 5")).select("content_sha256")
    assert {r.doc_id: r.status for r in catalog.import_report(df, held).collect()}[5] == "duplicate"


def test_summary_of_string_ids(spark):
    text = "The silver harbor closed early after the winter storm. Captain Mira guided every vessel home before nightfall."
    got = analytics.summary_scores(spark.createDataFrame([("x-1", text)], "doc_id string, text string")).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {"x-1"}


def test_first_rows_keep_all_columns(spark):
    df = spark.createDataFrame([(2, "a", 1, 1, "x", 5), (1, "A", 2, 2, "y", 6)], "doc_id long, text string, __key int, KEY int, mark string, _key int")
    got = catalog.dedup_keep_first(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "A", 2, 2, "y", 6)]
