"""Registered queries of the library; oracles.py has the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import analytics, answers, bpe, catalog, chunking, numeric, sampling, search, training
from .operators.term_index import TermIndex
from .operators.vector_index import VectorIndex
from .oracles import ORACLES
from .plans.commits import StoredLibrary
from .scratch import scratch
from .session import table
from .streaming.ingest import event_counts

QUESTION = "Why is the eren thble of the erand because and for tionble?"
WORDS = ["eren", "tionble", "thble", "erand"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks of a library."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", "text", "source", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("document").alias("location"), F.col("lang").alias("domain"), F.lit("txt").alias("kind"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# text


@query
def tokenize_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def runtime_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.runtime_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def normalize_text(spark, sf_dir):
    d = docs(spark, sf_dir)
    noisy = F.concat(F.lit("  \r\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\t \r\n\r\n\r\n\r\n ")), F.lit(" ­x \n"))
    return d.select("doc_id", F.sha2(X.normalize(noisy), 256).alias("sha"), F.length(X.normalize(noisy)).cast("long").alias("n"))


@query
def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.unicode_word_count(F.col("text")).alias("words"))


@query
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("content_sha256"), X.file_hash(F.col("text")).alias("sha256"))


@query
def byte_tokens(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", training.byte_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join(F.col("t").cast("array<string>"), " "), 256).alias("ids_sha256"))


@query
def infer_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.infer_domain(F.col("url"), F.col("html")).alias("domain"))


@query
def content_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.content_terms(F.col("text")), " ").alias("terms"))


@query
def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(X.question_terms(F.col("text"))), " ").alias("terms"))


@query
def intent_bonus(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, ["why so", "When was it", "where to", "who is", "what happened when", "how"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.intent_bonus(asked, F.col("text")).alias("bonus"))


@query
def excerpts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.excerpt(F.col("text"), 420).alias("excerpt"))


@query
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.html_to_text(F.col("html")), 256).alias("sha"), F.length(X.html_to_text(F.col("html"))).cast("long").alias("n"))


@query
def language_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.language_tokens(F.col("text")), " ").alias("tokens"))


@query
def untokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.untokenize(X.language_tokens(F.col("text"))).alias("text"))


@query
def runtime_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.runtime_terms(F.col("text"))), " ").alias("terms"))


@query
def legal_notice(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(answers.legal_notice(F.col("text")), 256).alias("sha"))


# catalog


@query
def dedup_keep_first(spark, sf_dir):
    return catalog.dedup_keep_first(docs(spark, sf_dir)).select("doc_id", "source", "n_chars")


@query
def import_report(spark, sf_dir):
    return catalog.import_report(docs(spark, sf_dir)).select("doc_id", "original_id", "status")


@query
def import_summary(spark, sf_dir):
    return catalog.import_report(docs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def library_stats(spark, sf_dir):
    return catalog.library_stats(docs(spark, sf_dir))


@query
def learning_report(spark, sf_dir):
    d = docs(spark, sf_dir)
    return catalog.learning_report(d, chunking.chunk_windows(d)).select("documents", "sections", "words", "chunks")


@query
def list_documents(spark, sf_dir):
    return catalog.list_documents(docs(spark, sf_dir), "de")


@query
def get_chunks(spark, sf_dir):
    c = chunking.chunk_windows(docs(spark, sf_dir).where("doc_id in (3, 7, 11)"), 220, 40)
    return c.orderBy("doc_id", "word_offset").limit(50)


@query
def update_metadata(spark, sf_dir):
    d = docs(spark, sf_dir)
    changes = d.where("doc_id % 10 = 0").select("doc_id", F.lit("xx").alias("new_lang"))
    return catalog.update_metadata(d, changes).select("doc_id", "lang", "source")


@query
def delete_cascade(spark, sf_dir):
    d = docs(spark, sf_dir)
    return catalog.delete_cascade(chunking.chunk_windows(d), d.where("source = 'src0'")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query
def replace_same_name(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Name"), (F.col("doc_id") % 300).cast("string")).alias("name"))
    new = (F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 300 < 150)  # half of the names are renewed; every document is old or new
    return catalog.replace_same_name(d.where(~new), d.where(new).withColumn("name", F.upper("name")))


@query
def export_corpus(spark, sf_dir):
    return catalog.export_corpus(docs(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("sha"), "title", "source", "domain")


@query
def feedback_export(spark, sf_dir):
    prompt = F.substring_index("text", ". ", 1)  # the first sentence; the rest is the response
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), prompt.alias("prompt"), F.substring(F.col("text"), F.length(prompt) + 3, F.length("text")).alias("response"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Corrected: "), F.col("text"))).otherwise(F.lit(" ")).alias("corrected_response"), (F.col("quality") - F.col("toxic")).alias("rating"), (F.col("toxic") == 1).alias("approved"),
    )
    return catalog.feedback_export(rows)


# chunks


@query
def chunk_windows(spark, sf_dir):
    return chunking.chunk_windows(docs(spark, sf_dir))


@query
def chunk_documents(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return chunking.chunk_documents(d).select("doc_id", "part", "word_offset", "location", "text", "word_count")


@query
def library_commits(spark, sf_dir):
    """English documents imported, then all, one source deleted, a domain renamed: what the library holds, with its chunks' ids."""
    d = docs(spark, sf_dir)
    d = d.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), "source", "lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("lang", F.lit("none")).alias("domain"))
    library = StoredLibrary(spark, scratch(spark, "library"), indexed=False)
    library.add(d.where("lang = 'en'"))
    library.add(d)
    library.delete(library.snapshot().documents.where("source = 'src0'"))
    library.update(library.snapshot().documents.where("domain = 'de'").select("doc_id", F.lit("german").alias("domain")))
    return library.snapshot().documents.select("doc_id", "title", "domain", "first_chunk", "n_chunks")


@query
def chunk_numbers(spark, sf_dir):
    c = chunking.chunk_windows(docs(spark, sf_dir)).select("doc_id", "word_offset")
    return chunking.numbered(c, "doc_id", "word_offset")


# search


@query
def term_freq(spark, sf_dir):
    return search.term_freq(docs(spark, sf_dir))


@query
def doc_freq(spark, sf_dir):
    return search.doc_freq(docs(spark, sf_dir))


@query
def doc_length_stats(spark, sf_dir):
    return search.length_stats(docs(spark, sf_dir)).select("n_docs", "n_tokens", r6("avg_length"))


@query
def bm25_search(spark, sf_dir):
    return search.bm25(titled(spark, sf_dir), WORDS, limit=10).select("doc_id", r6("score"), "matched")


@query
def index_search(spark, sf_dir):
    return TermIndex(spark, scratch(spark, "terms")).add(docs(spark, sf_dir)).search(WORDS)


@query
def bm25_filtered(spark, sf_dir):
    return search.bm25(titled(spark, sf_dir), ["the", "of", "doc", "thble"], limit=20, where=F.col("domain") == "fr").select("doc_id", r6("score"), "matched")


@query
def bm25_batch(spark, sf_dir):
    return search.bm25_batch(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def fts_search(spark, sf_dir):
    return search.fts(titled(spark, sf_dir), ["eren", "doc", "reenter", "thble", "eren"], limit=12).select("doc_id", r6("score"))


@query
def substring_fallback(spark, sf_dir):
    return search.substring_search(titled(spark, sf_dir), ["tionb", "ouer"], 12).select("doc_id", "score")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query
def semantic_search(spark, sf_dir):
    return search.semantic(*_vectors(spark, sf_dir), 10)


@query
def vector_index_search(spark, sf_dir):
    """The index of all embeddings, built in two parts, then searched for the first one."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q")).first()[0]
    index = VectorIndex(spark, scratch(spark, "vectors"))
    index.add(e.where("label < 5")).add(e.where("label >= 5 or label is null"))
    return index.search(asked, 10).select("vec_id", "label", "score")


@query
def semantic_filtered(spark, sf_dir):
    return search.semantic(*_vectors(spark, sf_dir), 10, F.col("label") % 2 == 0)


@query
def hybrid_search(spark, sf_dir):
    lexical = search.fts(titled(spark, sf_dir), WORDS, limit=18).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    return search.fuse(lexical, search.semantic(*_vectors(spark, sf_dir), 18).select(F.col("vec_id").alias("id"), "score"), 12).select("id", r6("score"), "lexical_rank", "semantic_rank")


# answers


def _results(spark, sf_dir, n=5):
    return search.bm25(titled(spark, sf_dir), WORDS, limit=n)


@query
def rank_sentences(spark, sf_dir):
    return answers.rank_sentences(_results(spark, sf_dir), QUESTION).select("doc_id", "pos", "sentence", r6("score"))


@query
def extractive_answer(spark, sf_dir):
    return answers.extractive_answer(answers.rank_sentences(_results(spark, sf_dir), QUESTION).withColumn("score", F.round("score", 6)), QUESTION)


@query
def runtime_answer(spark, sf_dir):
    return answers.runtime_answer(_results(spark, sf_dir, 6), QUESTION, "study")


@query
def confidence(spark, sf_dir):
    top = _results(spark, sf_dir, 1).select(F.size(F.split("matched", " ")).alias("m"), "score")
    n = F.col("m")
    return top.select(F.round(answers.assistant_confidence(n, F.lit(len(WORDS)), F.col("score")), 6).alias("assistant"), F.round(answers.runtime_confidence(n, F.lit(True), F.lit(True)), 6).alias("runtime"), F.round(answers.backend_confidence(n), 6).alias("backend"))


@query
def context_pack(spark, sf_dir):
    return answers.context_pack(_results(spark, sf_dir, 40), 14_000)


@query
def prompt_render(spark, sf_dir):
    return answers.render_prompt(turns(spark, sf_dir))


@query
def plain_prompt(spark, sf_dir):
    return answers.plain_prompt(turns(spark, sf_dir))


# corpus analytics


@query
def summary_scores(spark, sf_dir):
    return analytics.summary_scores(docs(spark, sf_dir)).select("doc_id", "pos", r6("score"))


@query
def summary_select(spark, sf_dir):
    return analytics.summaries(docs(spark, sf_dir))


@query
def names_mentions(spark, sf_dir):
    return analytics.name_mentions(analytics.name_sentences(docs(spark, sf_dir)))


@query
def name_relationships(spark, sf_dir):
    return analytics.name_relationships(analytics.name_sentences(docs(spark, sf_dir)))


@query
def character_profiles(spark, sf_dir):
    return analytics.character_profiles(analytics.name_sentences(docs(spark, sf_dir)))


@query
def character_lookup(spark, sf_dir):
    return analytics.find_character(analytics.name_mentions(analytics.name_sentences(docs(spark, sf_dir))), "the a")


@query
def ngram_counts(spark, sf_dir):
    return analytics.ngrams(docs(spark, sf_dir)).select("context", "next", "n")


@query
def ngram_next_greedy(spark, sf_dir):
    return analytics.ngram_next(analytics.ngrams(docs(spark, sf_dir), together=True))


@query
def ngram_backoff(spark, sf_dir):
    return analytics.backoff_next(analytics.ngrams(docs(spark, sf_dir)), "the")


@query
def ngram_generate(spark, sf_dir):
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return analytics.generate(analytics.ngrams(docs(spark, sf_dir), together=True), prompts)


@query
def ngram_sample(spark, sf_dir):
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return sampling.generate(analytics.transitions(docs(spark, sf_dir)), prompts, 16, 0.8)


def _next_tokens(spark, sf_dir):
    """The logarithm of each continuation's count, as logits of its context."""
    n = analytics.ngrams(docs(spark, sf_dir), 2)
    return n.select("context", F.col("next").alias("token"), F.log("n").alias("logit"))


@query
def nucleus(spark, sf_dir):
    return sampling.probabilities(_next_tokens(spark, sf_dir), 0.8, 50, 0.95).select("context", "token", F.round("p", 6).alias("p"))


@query
def vocab_topk(spark, sf_dir):
    return analytics.vocabulary(docs(spark, sf_dir), 500, 2)


# training data


@query
def recent_turns(spark, sf_dir):
    return catalog.last_of(turns(spark, sf_dir), "conv_id", "turn", 3)


@query
def expand_query(spark, sf_dir):
    t = turns(spark, sf_dir)
    asked = t.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", F.concat(F.lit("and it "), "m.text").alias("question"))
    return training.expand_query(training.pairs_of_turns(t), asked)


@query
def sft_messages(spark, sf_dir):
    m = training.sft_messages(turns(spark, sf_dir))
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("chat"))


@query
def sft_tokens_masked(spark, sf_dir):
    t = training.sft_tokens(training.sft_messages(turns(spark, sf_dir)))
    j = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256).alias(c)
    return t.select("conv_id", F.size("input_ids").cast("long").alias("n"), j("input_ids"), j("labels"))


@query
def sft_pad_truncate(spark, sf_dir):
    t = training.pad_truncate(training.sft_tokens(training.sft_messages(turns(spark, sf_dir))), 256)
    j = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256).alias(c)
    return t.select("conv_id", F.size("labels").cast("long").alias("n"), j("input_ids"), j("labels"))


@query
def train_val_split(spark, sf_dir):
    return training.train_val_split(docs(spark, sf_dir), 0.1)


@query
def token_blocks(spark, sf_dir):
    return training.block_digests(training.token_blocks(docs(spark, sf_dir), 512))


@query
def corpus_meta(spark, sf_dir):
    d = docs(spark, sf_dir)
    return training.corpus_meta(d, training.train_val_split(d, 0.1))


@query
def bpe_pair_counts(spark, sf_dir):
    return training.pair_counts(docs(spark, sf_dir))


#: 138 merges.
VOCABULARY = 400


@query
def bpe_train(spark, sf_dir):
    return bpe.train(docs(spark, sf_dir), VOCABULARY)


@query
def bpe_encode_decode(spark, sf_dir):
    d = docs(spark, sf_dir)
    return bpe.round_trip(d, bpe.train(d, VOCABULARY))


# numbers


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("k", "v")).select("i", "label", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


def _scores(spark, sf_dir):
    """Each vector against the mean of each class."""
    e = _embedded(spark, sf_dir)
    return numeric.matmul(e.select("i", "k", "v"), e.groupBy("k", F.col("label").alias("j")).agg(F.avg("v").alias("v")))


def _pairs(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("actual"))
    best = numeric.argmax(_scores(spark, sf_dir).withColumn("v", F.round("v", 9)))
    return truth.join(best, "i").select("i", "actual", F.col("j").alias("predicted"))


@query
def matmul(spark, sf_dir):
    return _scores(spark, sf_dir).select("i", "j", r6("v"))


@query
def matrix_cells(spark, sf_dir):
    m = _scores(spark, sf_dir)
    return numeric.cellwise(numeric.add_bias(m, numeric.column_sums(m)), m, "subtract").select("i", "j", F.round("v", 5).alias("v"))


@query
def softmax(spark, sf_dir):
    return numeric.softmax(_scores(spark, sf_dir)).select("i", "j", r6("v"))


@query
def activations(spark, sf_dir):
    e, v = _embedded(spark, sf_dir), F.col("v")
    return e.select("i", "k", F.round(numeric.sigmoid(v), 6).alias("sigmoid"), F.round(numeric.relu(v), 6).alias("relu"), F.round(numeric.leaky_relu(v), 6).alias("leaky"), F.round(F.tanh(v), 6).alias("tanh"))


@query
def losses(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"))
    cells = numeric.softmax(_scores(spark, sf_dir)).join(truth, "i").select("i", "j", F.col("v").alias("p"), (F.col("j") == F.col("label")).cast("double").alias("y"))
    return numeric.losses(cells).select(r6("mse"), r6("bce"), r6("cce"))


@query
def accuracy(spark, sf_dir):
    return numeric.accuracy(_pairs(spark, sf_dir)).select(r6("accuracy"))


@query
def confusion_matrix(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return numeric.confusion(p, p.select(F.col("actual").alias("c")).distinct())


@query
def one_hot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(numeric.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("row"))


def _edits(spark, sf_dir):
    """Neighbouring items."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z .]", "").alias("expected"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("expected").alias("predicted")), "item_id")


@query
def cer(spark, sf_dir):
    return _edits(spark, sf_dir).select("item_id", F.round(numeric.character_error_rate(F.col("expected"), F.col("predicted")), 6).alias("cer"))


@query
def wer(spark, sf_dir):
    return numeric.word_error_rate(_edits(spark, sf_dir).withColumnRenamed("item_id", "id")).select("id", r6("wer"))


@query
def otsu(spark, sf_dir):
    return numeric.otsu(docs(spark, sf_dir).select((F.col("n_chars") % 256).alias("v")))


def _ink(spark, sf_dir):
    return numeric.text_runs(docs(spark, sf_dir).select(F.col("doc_id").alias("line"), "text"))


@query
def ink_runs(spark, sf_dir):
    return _ink(spark, sf_dir).select("line", "start", "size")


@query
def glyph_gaps(spark, sf_dir):
    return _ink(spark, sf_dir).where("gap is not null").select("line", "start", "gap")


@query
def word_gap(spark, sf_dir):
    return numeric.word_gap(docs(spark, sf_dir).select((F.col("n_chars") % 7 + F.when(F.col("n_chars") % 5 == 0, 20).otherwise(1)).alias("gap")))


@query
def learning_rate(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2500).alias("step")).distinct()
    return training.learning_rates(steps, 3e-4, 3e-5, 100, 2000).select("step", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@query
def epoch_rates(spark, sf_dir):
    epochs = spark.range(1, 101).select(F.col("id").alias("epoch"))
    out = None
    for kind in ("constant", "step", "exponential", "time", "cosine"):
        part = training.epoch_rates(epochs, kind, 0.1, every=10).select(F.lit(kind).alias("schedule"), "epoch", F.round(F.col("rate") * 1000, 6).alias("rate"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def sft_holdout(spark, sf_dir):
    split = training.sft_holdout(training.sft_messages(turns(spark, sf_dir)))
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def train_test_split(spark, sf_dir):
    return training.train_test_split(docs(spark, sf_dir).select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def context_windows(spark, sf_dir):
    v = analytics.vocabulary(docs(spark, sf_dir).withColumn("text", F.lower("text")), 200)
    v = v.select(F.col("term").alias("token"), (F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1).alias("id"))  # 200 rows
    w = training.context_windows(docs(spark, sf_dir), v, 2)
    return w.select("doc_id", "pos", F.col("context")[0].alias("c0"), F.col("context")[1].alias("c1"), "target")


@query
def merge_overlapping(spark, sf_dir):
    c = chunking.chunk_windows(docs(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("title"), F.col("word_offset").alias("chunk_id"), F.col("chunk").alias("text"))
    return chunking.merge_overlapping(c).select("title", F.length("text").cast("long").alias("n"))


@query
def glyph_labels(spark, sf_dir):
    return numeric.recognized(numeric.softmax(_scores(spark, sf_dir).withColumn("v", F.col("v") * 20)), 0.5).select(F.col("i").alias("vec_id"), "label", r6("confidence"))


@query
def activation_derivatives(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    return e.select("i", "k", *[F.round(c, 6).alias(n) for n, c in numeric.derivatives(F.col("v")).items()])


def _predicted(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"))
    return numeric.softmax(_scores(spark, sf_dir)).join(truth, "i").select("i", "j", F.col("v").alias("p"), (F.col("j") == F.col("label")).cast("double").alias("y"))


@query
def loss_derivatives(spark, sf_dir):
    d = numeric.loss_derivatives(F.col("p"), F.col("y"), F.lit(100.0))
    return _predicted(spark, sf_dir).select("i", "j", *[F.round(c, 6).alias(n) for n, c in d.items()])


@query
def binary_accuracy(spark, sf_dir):
    return numeric.binary_accuracy(_predicted(spark, sf_dir), 0.1).select(r6("accuracy"))


@query
def perplexity(spark, sf_dir):
    return numeric.perplexity(_predicted(spark, sf_dir).where("y = 1")).select(r6("mean_loss"), r6("perplexity"))


@query
def ink_sums(spark, sf_dir):
    cells = _embedded(spark, sf_dir).select(F.col("i").alias("y"), F.col("k").alias("x"), (F.col("v") > 0).alias("active"))
    rows, columns = (numeric.ink_sums(cells, a).select(F.lit(a).alias("axis"), F.col(a).alias("place"), "n") for a in ("y", "x"))
    return rows.unionByName(columns)


@query
def title_filter(spark, sf_dir):
    return search.by_titles(titled(spark, sf_dir), ["DOC 3", "Doc 17", "doc 400"]).select("doc_id", "title")


@query
def semantic_payload(spark, sf_dir):
    hits = search.semantic(*_vectors(spark, sf_dir), 10).select(F.col("vec_id").alias("id"), "score")
    return search.with_payload(hits, docs(spark, sf_dir)).select("doc_id", "source", "score")


@query
def kind_stats(spark, sf_dir):
    return titled(spark, sf_dir).groupBy("domain", "kind").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("title").alias("titles"))


# extensions


@query
def event_windows(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events")).select(F.col("begin").cast("string").alias("begin"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def event_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.rollup(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
