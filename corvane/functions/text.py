"""Text functions over columns; everything stays in the JVM but rare character references."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"

# Words that carry no content in questions and sentences.
STOP_WORDS = (
    "a an and are as at be been but by did do does for from had has have he her hers him his how i in is it its me my of on or "
    "our she so that the their them they this to was we were what when where which who why will with you your"
).split()
# Words that refer back to earlier turns.
PRONOUN_TERMS = "he she they them him her his hers their it its this that these those there then".split()
# Capitalized words that are not names.
FALSE_NAMES = (
    "A An And After At Before Beyond But By Chapter During For Finally From He Her Here His How I If In Inside Into It Its Later "
    "Meanwhile Near No Not Now Of Outside On Once Only Or Page She So That The Their Then There They This Those Through To Under "
    "Until We What When Where While Who Why With Without Yet Yes You"
).split()
# The terms of each domain, in the order that decides ties.
DOMAIN_TERMS = {
    "law": ["court", "statute", "plaintiff", "defendant", "jurisdiction", "legal", "constitution", "section ", "article ", "judgment", "liability", "contract"],
    "programming": ["source code", "programming", "algorithm", "function ", "class ", "api ", "compiler", "database", "javascript", "python", "java ", "software"],
    "school": ["exercise", "learning objective", "chapter", "textbook", "theorem", "formula", "question", "answer", "biology", "chemistry", "physics", "mathematics", "history", "geography"],
    "fiction": ["chapter", "novel", "prologue", "epilogue", "said", "asked", "replied"],
}
# Suffixes of program code.
CODE_SUFFIXES = ".py .js .jsx .ts .tsx .java .c .cc .cpp .h .hpp .cs .go .rs .php .rb .sql .sh .ps1 .kt .swift".split()
# Tags that break lines, tags whose content is dropped.
BLOCK_TAGS = "p div section article header footer aside h1 h2 h3 h4 h5 h6 li blockquote br hr tr table pre".split()
SKIP_TAGS = "script style svg math noscript".split()
# The most common character references.
COMMON_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·", "amp": "&"}


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def normalize(c: Column) -> Column:
    """Unix line ends, no soft hyphens, plain spaces, wrapped words joined, at most one empty line, trimmed."""
    return replaced(
        c, (r"\r\n?", "\n"), ("­", ""), (" ", " "), (r"(?U)(?<=\w)-\n(?=\w)", ""), (r"[ \t]+", " "),
        (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+\z", ""),
    )


def tokens(c: Column) -> Column:
    """Lower-cased ASCII words with inner apostrophes and hyphens."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


def language_tokens(c: Column) -> Column:
    """Words in their case and single punctuation marks."""
    return F.regexp_extract_all(F.replace(c, F.lit("’"), F.lit("'")), F.lit(TOKEN + r"|(?U:[^\w\s])"), F.lit(0))


def untokenize(words: Column) -> Column:
    """Words and marks joined as prose."""
    return replaced(F.array_join(words, " "), (r" ([.,!?;:%)\]}])(?= |$)", "$1"), (r"([(\[{\"]) ", "$1"))


def sentences(c: Column) -> Column:
    """Split after . ! ? before a capital, digit or quote."""
    flat = F.replace(normalize(c), F.lit("\n"), F.lit(" "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"), lambda s: F.trim(s)), lambda s: s != "")


def runtime_sentences(c: Column) -> Column:
    """Split after every . ! ? before white space."""
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def runtime_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(c), F.lit(r"[A-Za-z0-9']+"), F.lit(0)))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def unicode_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\w+")).cast("long")


def content_hash(c: Column) -> Column:
    """SHA-256 of the text without regard to case and white space."""
    return F.sha2(casefold(replaced(c, (r"(?U)\s+", " "), (r"^ | $", ""))), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def occurrences(c: Column, term: str | Column) -> Column:
    """How often a term occurs without overlap."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)).cast("long")


def infer_domain(title: Column, text: Column, suffix: Column | None = None) -> Column:
    """law, programming, school or fiction by their terms in the first 12,000 characters; general below two."""
    sample = F.lower(F.concat(title, F.lit("\n"), F.substring(text, 1, 12000)))
    score = {d: sum((occurrences(sample, t) for t in terms[1:]), occurrences(sample, terms[0])) for d, terms in DOMAIN_TERMS.items()}
    if suffix is not None:
        score["fiction"] += F.when(F.lower(suffix) == ".epub", 2).otherwise(0)
    best = F.greatest(*score.values())
    out = F.when(best < 2, "general")
    for d, s in score.items():
        out = out.when(s == best, d)
    return out if suffix is None else F.when(F.lower(suffix).isin(CODE_SUFFIXES), "programming").otherwise(out)


def content_terms(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 2) & ~t.rlike("^[0-9]+$"))


def question_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1)))


def intent_bonus(question: Column, sentence: Column) -> Column:
    """What a sentence gains for having the form of an answer to the question."""
    q, s = F.lower(F.trim(question)), F.lower(sentence)
    why = F.when(s.rlike(r"\b(because|since|therefore|so that|in order to|due to)\b"), 4.0).when(s.rlike(r"\b(to|for)\b"), 0.8).otherwise(0.0)
    when = F.when(s.rlike(r"\b(before|after|during|while|when|night|morning|evening|day|year)\b"), 2.0).otherwise(0.0)
    where = F.when(s.rlike(r"\b(in|inside|outside|beneath|under|above|near|at|toward|through)\b"), 1.3).otherwise(0.0)
    named = F.when(sentence.rlike(r"(?U)\b[A-Z][a-z]{2,}(?!['’]s\b)"), 3.0).otherwise(0.0)
    who = named - F.when(s.rlike(r"^(he|she|they|it|we)\b"), 1.8).otherwise(0.0)
    happened = F.when(s.rlike(r"\bwhen\b"), 3.5).otherwise(0.0)
    return (
        F.when(q.startswith("why"), why).when(q.startswith("when"), when).when(q.startswith("where"), where).when(q.startswith("who"), who)
        .when(q.startswith("what happened") & q.contains("when"), happened).otherwise(0.0)
    )


def excerpt(c: Column, limit: int) -> Column:
    cut = F.trim(F.substring(c, 1, limit))
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("..."))).otherwise(cut)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def character_references(c: Column) -> Column:
    """Character references decoded as HTML 5 has them: all names, those that need no semicolon also before letters, Windows
    characters for 128 to 159, U+FFFD for what is no character.

    Rows that have only the most common names, with their semicolon, are decoded in place; only the others go through Arrow.
    """
    names = "|".join(COMMON_REFERENCES)
    rare = c.rlike(f"&(?!({names});)[#A-Za-z]")
    out = c
    for name, char in COMMON_REFERENCES.items():  # amp is the last, as what it makes isn't decoded again
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(rare, _unescaped(F.when(rare, c))).otherwise(out)


def html_to_text(c: Column) -> Column:
    """Readable text of a page: scripts and comments dropped, block tags break lines, character references decoded."""
    skip, block = "|".join(SKIP_TAGS), "|".join(BLOCK_TAGS)
    bare = replaced(
        c, (rf"(?is)<({skip})\b.*?</({skip})\s*>", ""), (r"(?s)<!--.*?-->", ""), (rf"(?i)</?({block})(\s[^>]*)?/?>", "\n"), (r"<[!/a-zA-Z][^>]*>", ""),
    )
    return normalize(character_references(bare))


def extract_names(sentence: Column) -> Column:
    """Distinct capitalized names of a sentence in order; openers such as When are stripped, titles kept."""
    title = r"(?:Mr|Mrs|Ms|Miss|Dr|Lord|Lady|Sir|Dame|King|Queen|Prince|Princess|Captain|Professor)\.?\s+"
    found = F.regexp_extract_all(sentence, F.lit(rf"(?U)\b(?:{title})?[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}\b"), F.lit(0))
    false = "|".join(FALSE_NAMES)

    def clean(name: Column) -> Column:
        flat = F.regexp_replace(name, r"\s+", " ")
        bare = F.regexp_replace(flat, f"^{title}", "")
        bare = F.regexp_replace(bare, rf"^(?:(?:{false}) )+(?=[A-Z])", "")
        named = F.regexp_replace(flat, f"^({title}).*$", "$1") != flat
        keep = ~bare.rlike(f"^(?:{false})$") & (F.length(bare) >= 2)
        return F.when(keep, F.when(named, flat).otherwise(bare))

    return F.array_distinct(F.filter(F.transform(found, clean), lambda n: n.isNotNull()))
