"""Alignment of tokenizers against the libraries' own encoders and a loop over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from corvane.llm import alignment as A  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", "<|endoftext|> </s> <s> <unk>", "a▁b", " lead  two   \n\n tabs\t\tx  ", "日本語のテキスト😀🏽 é", "x" * 5000, "don't we'll I've  !!!???", "\x00 nul\r\n", "1234567890 12 3", " ", "  ", "\n", "\n\n", "a\n \nb", "   a", "a   ",
       "ﬁ ½ ①", "é", "　full nbsp em", "x\x1cy \x1f z", "a\nb c\n\nd \n e", "ends\n", "\nbegins", "ab " * 100_000]


@pytest.fixture(scope="module")
def own():
    tok = tokenizers.Tokenizer.from_file(A.BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_BPE)
    return lambda t: (tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t)), A.Tokens(open(A.BYTE_BPE, "rb").read(), open(A.PIECE_BPE, "rb").read())


def ends(ids, table):
    out, at = [], 0
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


def expected(own, t):
    """Ids of both sides; none where bytes are lost."""
    encode, tokens = own
    x, y = encode(t) if t else ([], [])
    raw = f" {t}".encode() if t else b""
    return (x, y) if all(b"".join(s[i] for i in z) == raw for s, z in zip(tokens.tables, (x, y))) else ([], [])


def brute(own, texts):
    rows = []
    for t in texts:
        x, y = expected(own, t)
        ea, eb = ends(x, own[1].tables[0]), ends(y, own[1].tables[1])
        links, j = [], 0
        for i, e in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(y) and (eb[k - 1] if k else 0) < e:
                links.append((x[i], y[k]))
                k += 1
        both, groups, pa, pb = set(ea) & set(eb), [], 0, 0
        at_a, at_b = {e: i + 1 for i, e in enumerate(ea)}, {e: i + 1 for i, e in enumerate(eb)}
        for e in sorted(both):
            groups.append(",".join(map(str, x[pa : at_a[e]])) + "|" + ",".join(map(str, y[pb : at_b[e]])))
            pa, pb = at_a[e], at_b[e]
        rows.append((len(x), len(y), groups, links))
    n = Counter(p for r in rows for p in set(r[3]))
    best = defaultdict(int)
    for (a, _), c in n.items():
        best[a] = max(best[a], c)
    return [(a, b, len(g), len(k), sum(n[p] == best[p[0]] for p in k), sum(n[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'▁ab1.é \x1c<>|"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=4))
def test_words_are_independent(own, texts):
    a, b = own[1](texts)
    assert [(x, y) for x, y in zip(a[0].to_pylist(), b[0].to_pylist())] == [tuple(expected(own, t)) for t in texts]
    assert [x for x in a[1].to_pylist()] == [ends(i, own[1].tables[0]) for i in a[0].to_pylist()]


def test_odd_texts_and_documents(spark, own):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] * 2
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, rid string, n int")
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(own, texts)
    old = A.COMMON
    try:  # all id pairs are exchanged, or all are sent
        for A.COMMON in (1, 10**12):
            assert {r.doc_id: tuple(r)[1:] for r in A.alignment_report(df).collect()} == got
    finally:
        A.COMMON = old


def test_edges(spark):
    df = spark.createDataFrame([(None, "same words"), (None, "same words"), (1, "same words"), (1, None)], "doc_id long, text string")
    rows = A.alignment_report(df).collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows}) == 2 and A.alignment_report(df.limit(0)).count() == 0


def test_forgotten_words(own):
    texts = [f"word{i} other" for i in range(50)]
    before = [x.to_pylist() for pair in own[1](texts) for x in pair]
    own[1].forget()
    old, A.MEMO = A.MEMO, 3
    try:
        assert [x.to_pylist() for pair in own[1](texts) for x in pair] == before == [x.to_pylist() for pair in own[1](texts) for x in pair]
    finally:
        A.MEMO = old


def test_words_are_aligned_once(spark, own):
    texts = [f"Copies of wordings, don't they {i % 3}?\nend" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = A.tokenised(df).collect()
    assert sum(len(r.a_ids) for r in rows) < 100 and sum(len(r.docs) for r in rows) == 300
    got = {r.doc_id: r for r in A.align(df).collect()}
    for i, (n_a, n_b, groups, *_) in enumerate(brute(own, texts)):
        x, y = expected(own, texts[i])
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, len(got[i].groups)) == (n_a, n_b, groups, groups)
        assert [[int(i) for g in got[i].groups for i in g.split("|")[s].split(",")] for s in (0, 1)] == [x, y]


def test_new_words_share_a_text(own, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) + ("\n\nline\n" if i % 3 else ".") for i in range(80)]
    calls = []
    for x in (own[1].a, own[1].b):
        monkeypatch.setattr(type(x), "__call__", lambda self, text, f=type(x).__call__: calls.append(text) or f(self, text))
    own[1].forget()
    a, b = own[1](texts)
    assert [(x, y) for x, y in zip(a[0].to_pylist(), b[0].to_pylist())] == [tuple(expected(own, t)) for t in texts]
    assert len(calls) < len(set(" ".join(texts).split())) / 10
    calls.clear()
    own[1](texts)
    assert not calls


def test_lost_words_are_forgotten(own, monkeypatch):
    """Words that a vocabulary doesn't reproduce have no tokens, but take memory."""
    monkeypatch.setattr(A, "MEMO", 10)
    monkeypatch.setattr(own[1], "tables", [own[1].tables[0], [b"?"] * len(own[1].tables[1])])
    own[1].forget()
    for i in range(50):
        a, _ = own[1]([f"lost{i} word{i}"])
        assert a[0].to_pylist() == [[]]
    assert len(own[1].known) < 10
    own[1].forget()


def test_words_are_aligned_in_the_worker(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert "lambdafunction" not in A.align(df)._jdf.queryExecution().toString()


def test_blanks_between_words(spark, own):
    ends, bad = ["a", "a\n", "\na", "\n", "\n\n", "", "ﬁ", "\na\nb", "▁", "\t", "é́", " ", "x" * 2500], []
    texts = [" ".join((x, y, z)) for x in ends for y in ends for z in ends]
    own[1].forget()
    a, b = own[1](texts)
    for t, x, y in zip(texts, a[0].to_pylist(), b[0].to_pylist()):
        if (x, y) != expected(own, t):
            bad.append(t)
    assert not bad
    df = spark.createDataFrame(list(enumerate(texts[::7])), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment_report(df).collect()}
    assert [got[i] for i in range(len(got))] == brute(own, texts[::7])
