"""Text functions on inline cases."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("a-\nb", "ab"), ("é-\nü x", "éü x"), ("a\t\tb\n\n\n\nc", "a b\n\nc"), ("so­ft hard", "soft hard"), ("a\r\nb\rc", "a\nb\nc"),
        ("1-\n2-\n3", "123"), (" pad ", "pad"), ("a  \n  b", "a\nb"),
    ],
)
def test_normalize(spark, given, want):
    assert value(spark, X.normalize(F.lit(given))) == want


def test_tokens_and_sentences(spark):
    assert value(spark, X.tokens(F.lit("Don’t re-enter café 42!"))) == ["don't", "re-enter", "caf", "42"]
    assert value(spark, X.sentences(F.lit('He ran. "Stop!" she said. ok. And 3.5 left? Yes'))) == ["He ran.", '"Stop!" she said. ok.', "And 3.5 left?", "Yes"]
    assert value(spark, X.runtime_sentences(F.lit("a. b! c"))) == ["a.", "b!", "c"]
    words = X.language_tokens(F.lit('Say (now), "go": 5%!'))
    assert value(spark, words) == ["Say", "(", "now", ")", ",", '"', "go", '"', ":", "5", "%", "!"]
    assert value(spark, X.untokenize(F.array(*map(F.lit, ["Say", "(", "now", ")", ",", "yes", "!", "!", "!"])))) == "Say (now), yes!!!"


def test_hash_ignores_case_and_space(spark):
    same = [value(spark, X.content_hash(F.lit(t))) for t in ("Straße  A", " strasse a\n", "STRASSE A")]
    assert len(set(same)) == 1


def test_domain(spark):
    d = lambda t, s=None: value(spark, X.infer_domain(F.lit("x"), F.lit(t), None if s is None else F.lit(s)))
    assert d("the court and the statute") == "law" and d("a database in python") == "programming"
    assert d("nothing here") == "general" and d("one court") == "general" and d("hm", ".py") == "programming" and d("hm", ".epub") == "fiction"


def test_names(spark):
    n = lambda t: value(spark, X.extract_names(F.lit(t)))
    assert n("When Mira rang the bell, Arun came.") == ["Mira", "Arun"]
    assert n("Dr. Smith met Mr Jones") == ["Dr. Smith", "Mr Jones"]
    assert n("The end. She left") == []


def test_intent(spark):
    b = lambda q, s: value(spark, X.intent_bonus(F.lit(q), F.lit(s)))
    assert b("Why go?", "Because it rained") == 4.0 and b("Why go?", "to see") == 0.8 and b("who?", "He ran") == pytest.approx(-1.8)
    assert b("Who?", "Mira ran") == 3.0 and b("How?", "x") == 0.0 and b("what happened when", "When it fell") == 3.5


def test_html(spark):
    page = "<title>T</title><script>x<p></script><p>a &amp; b</p><!-- no --><div>c<br>d</div>"
    assert value(spark, X.html_to_text(F.lit(page))) == "T\na & b\n\nc\nd"


def test_excerpt(spark):
    assert value(spark, X.excerpt(F.lit("abc def"), 4)) == "abc..." and value(spark, X.excerpt(F.lit("abc"), 4)) == "abc"


def test_character_references(spark):
    """As the standard library has them, common or rare."""
    from html import unescape

    cases = ["&apos; &check; &#150; &#x80; &eacute &eacute; x", "&amp;lt; &lt;b&gt; &quot;q&quot;", "a & b && c &", "&copy2024 &copy 2024 &copy; &middot;", "&#0; &#xD800; &#x110000; &#1; &#65 &#x41;z", "&notit; &notin; &nosuch; &", "&NotEqualTilde; &acE;", None, "", "&nbsp;x&amp;amp;"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", X.character_references(F.col("c")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == [c if c is None else unescape(c) for c in cases]


def test_sentences_keep_their_digits(spark):
    text = "A b. 148.9 c 2. 2 and 12. 33"
    assert value(spark, X.sentences(F.lit(text))) == ["A b.", "148.9 c 2.", "2 and 12.", "33"]
    assert value(spark, X.sentences(F.lit("A. " * 15 + "1 of 15. 6515"))) == ["A."] * 15 + ["1 of 15.", "6515"]


def test_intent_words_end_at_letters_beyond_ascii(spark):
    b = lambda s: value(spark, X.intent_bonus(F.lit("where to"), F.lit(s)))
    assert b("der underöheite") == 0.0 and b("éin") == 0.0 and b("der under, heite") == 1.3


def test_untokenize_closes_long_rows_of_marks(spark):
    words = F.concat(F.array(F.lit("Ai")), F.array_repeat(F.lit("."), 200), F.array(F.lit("Ai")))
    assert value(spark, X.untokenize(words)) == "Ai" + "." * 200 + " Ai"
