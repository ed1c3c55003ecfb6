"""Term statistics and ranked search: BM25, full text, vectors and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import written

#: Terms of queries that are sent to all tasks.
FEW = 500_000
#: Accented letters of European languages and their bases.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňőřśšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeginnorsstuuuzzz"


def term_freq(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(docs: DataFrame) -> DataFrame:
    """Documents per term; each document's terms are made distinct before they are exchanged."""
    return docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def length_stats(docs: DataFrame) -> DataFrame:
    n = F.size(X.tokens(F.col("text"))).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.avg(n).alias("avg_length"))


def _count(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


def bm25(docs: DataFrame, query_terms: list[str], k1: float = 1.5, b: float = 0.75, limit: int | None = 10, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """doc_id, score and matched (query terms found) of the best documents.

    Statistics are of all documents; `where` only restricts what is ranked. One aggregate row and a top-k: no exchange
    of documents. Besides term scores, 2.5 for the terms as a phrase and 0.35 for each that the title contains.
    """
    terms = list(dict.fromkeys(query_terms))
    held = docs.withColumn("__t", X.tokens(F.col("text"))).withColumn("__len", F.size("__t"))
    for i, t in enumerate(terms):
        held = held.withColumn(f"__tf{i}", _count(F.col("__t"), t))
    stats = held.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))])
    ranked = (held if where is None else held.where(where)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}").cast("double"), F.col(f"__df{i}")
        idf = F.log(1.0 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__len") / F.nullif("__avg", F.lit(0.0)))))).otherwise(0.0)
    if len(terms) >= 2:
        score += F.when(F.array_join("__t", " ").contains(" ".join(terms)), 2.5).otherwise(0.0)
    title = F.lower(F.col("title")) if "title" in docs.columns else F.lit("")
    score += 0.35 * sum((title.contains(t).cast("int") for t in terms), F.lit(0))
    matched = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__tf{i}") > 0, t) for i, t in enumerate(terms)])), " ")
    out = ranked.withColumn("score", score).withColumn("matched", matched).where(F.col("score") > least)
    out = out.drop("__t", "__len", "__n", "__avg", *[f"__{x}{i}" for x in ("tf", "df") for i in range(len(terms))])
    return out if limit is None else out.orderBy(F.desc("score"), "doc_id").limit(limit)


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """item_id, doc_id, score, rank of the k best documents of every query (item_id, text), by term scores.

    One pass counts documents, lengths and the asked terms' frequencies, a second one scores. That deals documents to tasks
    whole, so that a document's terms, its scores and the rank limit need no other exchange than that of each task's best.
    Up to FEW terms of queries are sent to all tasks.
    """
    asked = queries.select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    sent = F.broadcast if asked.count() <= FEW else lambda t: t
    held = docs.select("doc_id", X.tokens(F.col("text")).alias("t"))
    # the null term counts all documents and their lengths
    each = held.select(F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")))).alias("term"))
    sums = each.join(sent(asked.select("term").distinct().withColumn("asked", F.lit(True))), "term", "left").where("asked or term is null")
    sums = written(sums.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("len").alias("avg")), "sums")
    stats = sums.where("term is null").select(F.col("df").alias("n"), "avg")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(sums.select("term", "df"), "term").crossJoin(F.broadcast(stats)).select("item_id", "term", idf.alias("idf"), "avg")
    dealt = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", X.tokens(F.col("text")).alias("t"))
    postings = dealt.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(sent(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg"))))
    scored = postings.join(sent(weights), "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def fts_terms(c: Column) -> Column:
    """Words without case and accents, split at everything but letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts(docs: DataFrame, query_words: list[str], limit: int | None = 6, where: Column | None = None) -> DataFrame:
    """doc_id, score of the documents that match any word, best first.

    Okapi BM25 over the columns title, location, text, domain and kind with weights 2, 0.5, 1, 0.2, 0.2; lengths over all
    columns; a word asked twice counts twice; a word in half of the documents or more has almost no weight.
    """
    weights = {"title": 2.0, "location": 0.5, "text": 1.0, "domain": 0.2, "kind": 0.2}
    held = docs.select("*", *[fts_terms(F.col(c)).alias(f"__{c}") for c in weights])
    held = held.withColumn("__len", sum((F.size(f"__{c}") for c in weights), F.lit(0)))
    for i, w in enumerate(query_words):
        held = held.withColumn(f"__f{i}", sum((F.lit(v) * _count(F.col(f"__{c}"), w) for c, v in weights.items()), F.lit(0.0)))
    stats = held.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(query_words))])
    held = (held if where is None else held.where(where)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query_words)):
        df, f = F.col(f"__df{i}"), F.col(f"__f{i}")
        raw = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        score += F.when(raw > 0, raw).otherwise(1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("__len") / F.nullif("__avg", F.lit(0.0))))
    hit = sum((F.col(f"__f{i}") for i in range(len(query_words))), F.lit(0.0)) > 0
    out = held.withColumn("score", score).where(hit).drop("__len", "__n", "__avg", *[f"__{c}" for c in weights], *[f"__{x}{i}" for x in ("f", "df") for i in range(len(query_words))])
    return out if limit is None else out.orderBy(F.desc("score"), "doc_id").limit(limit)


def substring_search(docs: DataFrame, query_terms: list[str], limit: int = 6) -> DataFrame:
    """doc_id, score: how often the terms occur anywhere in title and text, even within words."""
    text = X.casefold(F.concat(F.col("title"), F.lit(" "), F.col("text")))
    score = sum((X.occurrences(text, t) for t in query_terms), F.lit(0))
    return docs.withColumn("score", score.cast("double")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)


def semantic(vectors: DataFrame, query: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """vec_id, label, score: the k nearest of the 8k vectors with the greatest dot product; `where` applies after that cut.

    query: one row with the column q. Its one vector is sent to all tasks; only 8k rows come together.
    """
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, v: a + v)
    scored = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select("vec_id", "label", F.round(dot, 4).alias("score"))
    near = scored.orderBy(F.desc("score"), "vec_id").limit(8 * k)
    return (near if where is None else near.where(where)).orderBy(F.desc("score"), "vec_id").limit(k)


def fuse(lexical: DataFrame, meaning: DataFrame, k: int = 6, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """id, score, lexical_rank, semantic_rank of two short ranked lists (id, score), joined by reciprocal rank."""
    # both lists are top-k results of a few rows
    w = Window.orderBy(F.desc("score"), "id")
    a = lexical.select("id", F.row_number().over(w).cast("long").alias("lexical_rank"))
    b = meaning.select("id", F.row_number().over(w).cast("long").alias("semantic_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.col(rank) + 60), F.lit(0.0))
    out = a.join(b, "id", "full_outer").withColumn("score", part(weights[0], "lexical_rank") + part(weights[1], "semantic_rank"))
    return out.orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("semantic_rank")).limit(k)


def by_titles(docs: DataFrame, titles: list[str]) -> DataFrame:
    """Documents with one of the titles, without regard to case; all where no title is given."""
    return docs.where(X.casefold(F.col("title")).isin([t.lower().replace("ß", "ss") for t in titles])) if titles else docs


def with_payload(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """A top-k list of hits (id, score) with the rows of docs (doc_id, ...); the list is sent to them."""
    return docs.join(F.broadcast(hits), F.col("doc_id") == F.col("id")).drop("id")
