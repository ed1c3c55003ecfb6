"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

from .functions.text import BLOCK_TAGS, DOMAIN_TERMS, FALSE_NAMES, PRONOUN_TERMS, SKIP_TAGS, STOP_WORDS

TOK = "[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*"


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOK}'), lambda t: replace(lower(t), '’', ''''))"


def ltok(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '{TOK}|[^\p{{L}}\p{{N}}\p{{M}}_\s\x{{85}}\x{{A0}}]'), lambda t: replace(t, '’', ''''))"


def norm(x: str) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    out = f"replace(replace({out}, chr(173), ''), chr(160), ' ')"
    for pattern, by in ((r"([\pL\pN_])-\n([\pL\pN_])", r"'\1\2'"), (r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10)||chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return f"trim({out}, ' ' || chr(9) || chr(10))"


def sents(x: str) -> str:
    flat = f"replace({norm(x)}, chr(10), ' ')"
    return rf"list_filter(list_transform(string_split(regexp_replace({flat}, '([.!?])\s+([A-Z0-9\"''])', '\1'||chr(1)||'\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def chash(x: str) -> str:
    return rf"sha256({fold(rf'''trim(regexp_replace({x}, '\s+', ' ', 'g'))''')})"


def ascii_of(x: str) -> str:
    """Letters beyond ASCII as word characters, so that ASCII word boundaries are those of Unicode."""
    return rf"regexp_replace({x}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g')"


def rterms(x: str) -> str:
    return f"list_distinct(regexp_extract_all({fold(x)}, '[A-Za-z0-9'']+'))"


def cterms(x: str) -> str:
    return f"list_filter({tok(x)}, lambda t: NOT list_contains({quoted(STOP_WORDS)}, t) AND length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+'))"


def rsents(x: str) -> str:
    return rf"string_split(regexp_replace(trim({x}), '([.!?])\s+', '\1'||chr(1), 'g'), chr(1))"


def exploded(array: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, unnest(range(len(a))) AS pos, unnest(a) AS sentence FROM (SELECT {key}, {array} AS a FROM {source})"


def bonus(q: str, s: str) -> str:
    w = lambda p: rf"regexp_matches(lower({s}), '\b({p})\b')"
    return f"""CASE WHEN lower(trim({q})) LIKE 'why%' THEN CASE WHEN {w('because|since|therefore|so that|in order to|due to')} THEN 4.0 WHEN {w('to|for')} THEN 0.8 ELSE 0.0 END
 WHEN lower(trim({q})) LIKE 'when%' THEN CASE WHEN {w('before|after|during|while|when|night|morning|evening|day|year')} THEN 2.0 ELSE 0.0 END
 WHEN lower(trim({q})) LIKE 'where%' THEN CASE WHEN {w('in|inside|outside|beneath|under|above|near|at|toward|through')} THEN 1.3 ELSE 0.0 END
 WHEN lower(trim({q})) LIKE 'who%' THEN CASE WHEN regexp_matches({s}, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])[A-Z][a-z]{{2,}}') THEN 3.0 ELSE 0.0 END - CASE WHEN regexp_matches(lower({s}), '^(he|she|they|it|we)\\b') THEN 1.8 ELSE 0.0 END
 WHEN lower(trim({q})) LIKE 'what happened%' AND lower({q}) LIKE '%when%' THEN CASE WHEN {w('when')} THEN 3.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE"""


def untokenized() -> str:
    """Each pass closes every other mark of a row of them."""
    out = f"array_to_string({ltok('text')}, ' ')"
    for _ in range(5):
        out = rf"regexp_replace({out}, ' ([.,!?;:%)\]}}]+)( |$)', '\1\2', 'g')"
    return rf"""SELECT doc_id, regexp_replace({out}, '([(\[{{"]) ', '\1', 'g') AS text FROM documents"""


def domain() -> str:
    sample = "lower(url || chr(10) || substr(html, 1, 12000))"
    sums = {d: " + ".join(f"(length(s) - length(replace(s, '{t}', ''))) // {len(t)}" for t in terms) for d, terms in DOMAIN_TERMS.items()}
    cols = ", ".join(f"{v} AS {k}" for k, v in sums.items())
    names = list(sums)
    return f"""SELECT page_id, CASE WHEN greatest({', '.join(names)}) < 2 THEN 'general' {' '.join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names)} END AS domain
FROM (SELECT page_id, {cols} FROM (SELECT page_id, {sample} AS s FROM pages))"""


def html() -> str:
    skip, block = "|".join(SKIP_TAGS), "|".join(BLOCK_TAGS)
    out = "html"
    for pattern, by in ((rf"(?is)<({skip})\b.*?</({skip})\s*>", "''"), (r"(?s)<!--.*?-->", "''"), (rf"(?i)</?({block})(\s[^>]*)?/?>", "chr(10)"), (r"<[!/a-zA-Z][^>]*>", "''"), ("&copy;?", "'©'"), ("&middot;?", "'·'"), ("&quot;?", "'\"'"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&nbsp;?", "' '"), ("&amp;?", "'&'")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return norm(out)


W = ["eren", "tionble", "thble", "erand"]
QUESTION = "Why is the eren thble of the erand because and for tionble?"
LIBRARY = "SELECT doc_id, text, source, 'doc ' || doc_id AS title, 'document' AS location, lang AS domain, 'txt' AS kind FROM documents"
WORDS_CTE = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
WINDOWS = """d AS (SELECT doc_id, {w} AS w FROM {source}),
e AS (SELECT doc_id, w, unnest(range(0, (CASE WHEN len(w) <= {m} THEN 0 ELSE ceil((len(w) - {m}) / {s}.0)::BIGINT * {s} END) + 1, {s})) AS s FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, s AS word_offset, array_to_string(w[s + 1 : s + {m}], ' ') AS chunk, len(w[s + 1 : s + {m}]) AS word_count FROM e)"""


def windows(m: int = 180, o: int = 35, source: str = "documents") -> str:
    return WINDOWS.format(w=WORDS_CTE, m=m, s=m - o, source=source)


def paragraph_chunks(most: int, overlap: int, least: int) -> str:
    return rf"""t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10)||chr(10)), '\n\s*\n'), lambda p: trim(p, ' ' || chr(9) || chr(10))), lambda p: p <> '') AS ps FROM documents),
st AS (SELECT doc_id, list_transform(ps, lambda p: {{'o': []::VARCHAR[], 'b': p, 'n': len(list_filter(string_split_regex(p, '\s+'), lambda w: w <> ''))}}) AS s FROM t WHERE len(ps) > 0),
rd AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.n + x.n > {most} THEN {{'o': list_append(a.o, a.b), 'b': x.b, 'n': x.n}} ELSE {{'o': a.o, 'b': a.b || chr(10) || chr(10) || x.b, 'n': a.n + x.n}} END) AS r FROM st),
gr AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS part, unnest(g) AS text FROM (SELECT doc_id, list_append(r.o, r.b) AS g FROM rd)),
d AS (SELECT doc_id, part, {WORDS_CTE} AS w FROM gr),
e AS (SELECT doc_id, part, w, unnest(range(0, (CASE WHEN len(w) <= {most} THEN 0 ELSE ceil((len(w) - {most}) / {float(most - overlap)})::BIGINT * {most - overlap} END) + 1, {most - overlap})) AS s FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, part, s AS word_offset, w[s + 1 : s + {most}] AS p FROM e),
cd AS (SELECT * FROM c WHERE len(p) >= {least} OR (part = 1 AND word_offset = 0))"""


def bm25(terms: list[str], limit: int, where: str = "true") -> str:
    """CTEs up to r: doc_id, text, title, domain, score, matched."""
    terms = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1e0 + (n - df{i} + 5e-1) / (df{i} + 5e-1)) * (tf{i} * 25e-1 / (tf{i} + 15e-1 * (25e-2 + 75e-2 * len(t) / av))) ELSE 0e0 END" for i in range(len(terms)))
    phrase = f"CASE WHEN contains(array_to_string(t, ' '), '{' '.join(terms)}') THEN 25e-1 ELSE 0e0 END"
    title = " + ".join(f"contains(title, '{t}')::INT" for t in terms)
    matched = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN tf{i} > 0 THEN '{t}' END" for i, t in enumerate(terms)) + "], lambda x: x IS NOT NULL), ' ')"
    return f"""l AS ({LIBRARY}), h AS (SELECT *, {tok('text')} AS t FROM l), f AS (SELECT *, {tf} FROM h),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av, {df} FROM f),
r AS (SELECT doc_id, text, title, domain, {parts} + {phrase} + 35e-2 * ({title}) AS score, {matched} AS matched FROM f, st WHERE {where} QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, doc_id) <= {limit})"""


def fts(words: list[str], limit: int) -> str:
    cols = {"title": "2e0", "location": "5e-1", "text": "1e0", "domain": "2e-1", "kind": "2e-1"}
    t = ", ".join(rf"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}]+') AS t_{c}" for c in cols)
    f = ", ".join("(" + " + ".join(f"{v} * len(list_filter(t_{c}, lambda x: x = '{w}'))" for c, v in cols.items()) + f") AS f{i}" for i, w in enumerate(words))
    length = " + ".join(f"len(t_{c})" for c in cols)
    df = ", ".join(f"sum((f{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(words)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 5e-1) / (df{i} + 5e-1)) > 0 THEN ln((n - df{i} + 5e-1) / (df{i} + 5e-1)) ELSE 1e-6 END)"
    score = " + ".join(f"{idf(i)} * f{i} * 22e-1 / (f{i} + 12e-1 * (25e-2 + 75e-2 * len / av))" for i in range(len(words)))
    hit = " + ".join(f"f{i}" for i in range(len(words)))
    return f"""l AS ({LIBRARY}), h AS (SELECT doc_id, {t} FROM l), f AS (SELECT doc_id, {length} AS len, {f} FROM h),
st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS av, {df} FROM f),
x AS (SELECT doc_id, round({score}, 6) AS score, {score} AS raw FROM f, st WHERE {hit} > 0 QUALIFY row_number() OVER (ORDER BY raw DESC, doc_id) <= {limit})"""


SEM = """s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS score FROM embeddings
 QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= {n})"""
NAME = r"\b(?:(?:Mr|Mrs|Ms|Miss|Dr|Lord|Lady|Sir|Dame|King|Queen|Prince|Princess|Captain|Professor)\.?\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
_T = r"(?:Mr|Mrs|Ms|Miss|Dr|Lord|Lady|Sir|Dame|King|Queen|Prince|Princess|Captain|Professor)\.?\s+"


def named() -> str:
    false = "|".join(FALSE_NAMES)
    flat = r"regexp_replace(m, '\s+', ' ', 'g')"
    bare = rf"regexp_replace(regexp_replace({flat}, '^{_T}', ''), '^(?:(?:{false}) )+([A-Z])', '\1')"
    clean = f"CASE WHEN regexp_full_match({bare}, '{false}') OR length({bare}) < 2 THEN NULL WHEN regexp_matches({flat}, '^{_T}') THEN {flat} ELSE {bare} END"
    return f"""s AS ({exploded(sents('text'))}),
m AS (SELECT doc_id, pos, sentence, list_filter(list_transform(regexp_extract_all({ascii_of('sentence')}, '{NAME}'), lambda m: {clean}), lambda x: x IS NOT NULL) AS ms FROM s),
nm AS (SELECT doc_id, pos, sentence, list_distinct(ms) AS names FROM m WHERE len(ms) > 0)"""


EMB = "e AS (SELECT vec_id AS i, label::BIGINT AS label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SCORES = EMB + ", ce AS (SELECT k, label AS j, avg(v) AS v FROM e GROUP BY ALL), sc AS (SELECT e.i, ce.j, sum(e.v * ce.v) AS v FROM e JOIN ce USING (k) GROUP BY ALL)"
SOFT = SCORES + ", ex AS (SELECT i, j, exp(v - max(v) OVER (PARTITION BY i)) AS e FROM sc), sm AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS v FROM ex)"
PAIRS = SCORES + ", bp AS (SELECT i, j AS predicted FROM sc QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) = 1), pr AS (SELECT bp.i, t.label::BIGINT AS actual, predicted FROM bp JOIN embeddings t ON t.vec_id = bp.i)"
BYTES = "list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::INT + 6)"


def bytes_of(x: str) -> str:
    return BYTES.format(x=x)


MSG = "SELECT conv_id, turn, lower(trim(role)) AS role, trim(text) AS content FROM conversations WHERE lower(trim(role)) IN ('system', 'user', 'assistant') AND trim(text) <> ''"
SFT = f"""m AS ({MSG}), mt AS (SELECT conv_id, turn, role = 'assistant' AS told, list_concat([CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 ELSE 5 END], {bytes_of("(chr(10) || content || chr(10))")}) AS ids FROM m),
ex AS (SELECT conv_id, list_concat(list_concat([1], flatten(list(ids ORDER BY turn))), [2]) AS input_ids,
 list_concat(list_concat([-100], flatten(list(CASE WHEN told THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn))), [CASE WHEN bool_or(told) THEN 2 ELSE -100 END]) AS labels FROM mt GROUP BY conv_id)"""
INK = "c AS (SELECT doc_id AS line, unnest(range(len(a))) AS x, unnest(a) AS c FROM (SELECT doc_id, string_split(text, '') AS a FROM documents)), i AS (SELECT line, x, x - row_number() OVER (PARTITION BY line ORDER BY x) AS g FROM c WHERE regexp_matches(c, '[a-z]')), rn AS (SELECT line, min(x) AS start, count(*) AS size FROM i GROUP BY line, g)"
NGRAMS = f"""d AS (SELECT doc_id, list_concat(list_concat(['<BOS>', '<BOS>'], {ltok('text')}), ['<EOS>']) AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(2, len(t))) AS i FROM d),
g AS (SELECT t[i - 1] || ' ' || t[i] AS context, t[i + 1] AS next, count(*) AS n, min(doc_id * 1000000 + i) AS place FROM i GROUP BY ALL)"""
SPLIT = """h AS (SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id), 1, 12))::BIGINT AS key FROM documents),
k AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) - 1 AS r, count(*) OVER () AS n FROM h),
sp AS (SELECT doc_id, CASE WHEN r < least(n - 1, greatest(1, floor(n * (1 - 1e-1)))) THEN 'train' ELSE 'val' END AS split FROM k)"""
RANKED = f"""WITH {bm25(W, 5)}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM r),
s AS (SELECT doc_id, rank, score AS base, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM (SELECT doc_id, rank, score, {sents('text')} AS a FROM k)),
n AS (SELECT *, regexp_replace(raw, '\\s+', ' ', 'g') AS sentence FROM s),
u AS (SELECT * FROM n WHERE length(sentence) >= 20 QUALIFY row_number() OVER (PARTITION BY lower(sentence) ORDER BY rank, pos) = 1),
q AS (SELECT list_distinct(list_filter({tok(f"'{QUESTION}'")}, lambda t: NOT list_contains({quoted(STOP_WORDS)}, t) AND length(t) > 1)) AS t),
o AS (SELECT u.*, len(q.t) AS nq, len(list_intersect(q.t, {tok('sentence')})) AS ov FROM u, q),
z AS (SELECT doc_id, rank, pos, sentence, 7e-1 * base + 3e0 * ov / greatest(1, nq) + 4e-1 * ov + {bonus(f"'{QUESTION}'", 'sentence')} - 15e-3 * pos - 5e-2 * rank AS score FROM o)"""

ORACLES = {
    "tokenize_docs": f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS tokens FROM documents",
    "sentence_split": exploded(sents("text")),
    "runtime_sentences": exploded(rsents("text")),
    "normalize_text": f"SELECT doc_id, sha256(t) AS sha, length(t) AS n FROM (SELECT doc_id, {norm('''('  ' || chr(13) || chr(10) || replace(text, '. ', '.' || chr(9) || ' ' || repeat(chr(13) || chr(10), 4) || ' ') || chr(160) || chr(173) || 'x ' || chr(10))''')} AS t FROM documents)",
    "word_count": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')) AS words FROM documents",
    "content_hash": f"SELECT doc_id, {chash('text')} AS content_sha256, sha256(text) AS sha256 FROM documents",
    "byte_tokens": f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS ids_sha256 FROM (SELECT doc_id, {bytes_of('text')} AS t FROM documents)",
    "infer_domain": domain(),
    "content_terms": f"SELECT doc_id, array_to_string({cterms('text')}, ' ') AS terms FROM documents",
    "question_terms": f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({tok('text')}, lambda t: NOT list_contains({quoted(STOP_WORDS)}, t) AND length(t) > 1))), ' ') AS terms FROM benchmark",
    "intent_bonus": f"SELECT doc_id, {bonus('q', 'text')} AS bonus FROM (SELECT doc_id, text, ['why so', 'When was it', 'where to', 'who is', 'what happened when', 'how'][doc_id % 6 + 1] AS q FROM documents)",
    "excerpts": "SELECT doc_id, trim(substr(text, 1, 420)) || CASE WHEN length(text) > 420 THEN '...' ELSE '' END AS excerpt FROM documents",
    "html_to_text": f"SELECT page_id, sha256(t) AS sha, length(t) AS n FROM (SELECT page_id, {html()} AS t FROM pages)",
    "language_tokens": f"SELECT doc_id, array_to_string({ltok('text')}, ' ') AS tokens FROM documents",
    "untokenize": untokenized(),
    "runtime_terms": f"SELECT doc_id, array_to_string(list_sort({rterms('text')}), ' ') AS terms FROM documents",
    "legal_notice": "SELECT doc_id, sha256(CASE WHEN regexp_matches(lower(text), 'not legal advice|lawyer|legal professional') THEN text ELSE text || chr(10) || chr(10) || 'This is general information, not legal advice.' END) AS sha FROM documents",
    "dedup_keep_first": f"SELECT doc_id, source, n_chars FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY {chash('text')} ORDER BY doc_id) = 1",
    "import_report": f"SELECT doc_id, o AS original_id, CASE WHEN doc_id = o THEN 'added' ELSE 'duplicate' END AS status FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {chash('text')}) AS o FROM documents)",
    "import_summary": f"SELECT CASE WHEN doc_id = o THEN 'added' ELSE 'duplicate' END AS status, count(*) AS n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {chash('text')}) AS o FROM documents) GROUP BY 1",
    "library_stats": "SELECT lang AS domain, count(*) AS documents, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS characters FROM documents GROUP BY lang",
    "learning_report": rf"WITH {windows()} SELECT count(*) AS documents, count(*) AS sections, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+')))::BIGINT AS words, (SELECT count(*) FROM c) AS chunks FROM documents",
    "list_documents": "SELECT doc_id, 'doc ' || doc_id AS title, lang AS domain, strlen(text) AS size_bytes FROM documents WHERE lang = 'de'",
    "get_chunks": f"WITH {windows(220, 40, '(SELECT * FROM documents WHERE doc_id IN (3, 7, 11))')} SELECT * FROM c ORDER BY doc_id, word_offset LIMIT 50",
    "update_metadata": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents",
    "delete_cascade": f"WITH {windows()} SELECT doc_id, count(*) AS chunks FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0') GROUP BY doc_id",
    "replace_same_name": "WITH d AS (SELECT doc_id, 'Name' || (doc_id % 300) AS name, doc_id % 7 = 0 AND doc_id % 300 < 150 AS new FROM documents), n AS (SELECT doc_id, upper(name) AS name FROM d WHERE new) SELECT doc_id, name FROM d WHERE NOT new AND lower(name) NOT IN (SELECT lower(name) FROM n) UNION ALL SELECT * FROM n",
    "export_corpus": f"SELECT doc_id, sha256({norm('text')}) AS sha, 'doc ' || doc_id AS title, source, lang AS domain FROM documents WHERE {norm('text')} <> ''",
    "feedback_export": """WITH r AS (SELECT doc_id AS id, split_part(text, '. ', 1) AS prompt, substr(text, length(split_part(text, '. ', 1)) + 3) AS response, CASE WHEN doc_id % 3 = 0 THEN trim('Corrected: ' || text) END AS c, quality - toxic AS rating, toxic = 1 AS approved FROM documents JOIN labels USING (doc_id))
SELECT id, prompt, coalesce(c, response) AS answer FROM r WHERE approved OR c IS NOT NULL OR rating = 1""",
    "chunk_windows": f"WITH {windows()} SELECT * FROM c",
    "chunk_documents": f"WITH {paragraph_chunks(180, 35, 8)} SELECT doc_id, part, word_offset, 'document, part ' || part || ', word ' || (word_offset + 1) AS location, array_to_string(p, ' ') AS text, len(p) AS word_count FROM cd",
    "library_commits": f"""WITH {paragraph_chunks(220, 40, 1)},
n AS (SELECT doc_id, count(*) AS n_chunks FROM cd GROUP BY doc_id),
k AS (SELECT *, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS batch FROM documents JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY {chash('text')} ORDER BY CASE WHEN lang = 'en' THEN 1 ELSE 2 END, doc_id) = 1),
i AS (SELECT 'doc ' || doc_id AS title, source, lang, n_chunks, row_number() OVER (ORDER BY batch, doc_id) AS id, sum(n_chunks) OVER (ORDER BY batch, doc_id) - n_chunks AS first_chunk FROM k)
SELECT id AS doc_id, title, CASE WHEN lang = 'de' THEN 'german' ELSE coalesce(lang, 'none') END AS domain, first_chunk::BIGINT AS first_chunk, n_chunks FROM i WHERE source IS DISTINCT FROM 'src0'""",
    "chunk_numbers": f"WITH {windows()} SELECT doc_id, word_offset, row_number() OVER (ORDER BY doc_id, word_offset) - 1 AS chunk_id FROM c",
    "term_freq": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term",
    "doc_length_stats": f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS avg_length FROM (SELECT len({tok('text')}) AS n FROM documents)",
    "bm25_search": f"WITH {bm25(W, 10)} SELECT doc_id, round(score, 6) AS score, matched FROM r",
    "bm25_filtered": f"WITH {bm25(['the', 'of', 'doc', 'thble'], 20, chr(39).join(['domain = ', 'fr', '']))} SELECT doc_id, round(score, 6) AS score, matched FROM r",
    "bm25_batch": f"""WITH h AS (SELECT doc_id, {tok('text')} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av FROM h),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM h) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({tok('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len / av)))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
    "index_search": f"""WITH h AS (SELECT doc_id, {tok('text')} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av FROM h),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM h) WHERE term IN ('eren', 'tionble', 'thble', 'erand') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len / av)))), 6) AS score
FROM p JOIN df USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "fts_search": f"WITH {fts(['eren', 'doc', 'reenter', 'thble', 'eren'], 12)} SELECT doc_id, score FROM x",
    "substring_fallback": f"WITH l AS ({LIBRARY}), s AS (SELECT doc_id, {fold(chr(39).join(['title || ', ' ', ' || text']))} AS h FROM l) SELECT doc_id, ((length(h) - length(replace(h, 'tionb', ''))) // 5 + (length(h) - length(replace(h, 'ouer', ''))) // 4)::DOUBLE AS score FROM s QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, doc_id) <= 12",
    "vector_index_search": f"WITH {SEM.format(n=80)} SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "semantic_search": f"WITH {SEM.format(n=80)} SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "semantic_filtered": f"WITH {SEM.format(n=80)} SELECT * FROM s WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 10",
    "hybrid_search": f"""WITH {fts(W, 18)}, {SEM.format(n=18)}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM x), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS semantic_rank FROM s)
SELECT id, round(coalesce(55e-2 / (60 + lexical_rank), 0) + coalesce(45e-2 / (60 + semantic_rank), 0), 6) AS score, lexical_rank, semantic_rank FROM a FULL JOIN b USING (id) ORDER BY coalesce(55e-2 / (60 + lexical_rank), 0) + coalesce(45e-2 / (60 + semantic_rank), 0) DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST LIMIT 12""",
    "rank_sentences": f"{RANKED} SELECT doc_id, pos, sentence, round(score, 6) AS score FROM z",
    "extractive_answer": f"""{RANKED}, y AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, rank, pos) AS place FROM z QUALIFY place <= 4),
b AS (SELECT *, max(round(score, 6)) OVER () AS best, first_value({bonus(f"'{QUESTION}'", 'sentence')} >= 3) OVER (ORDER BY place) AS strong, sum(length(sentence) + (place > 1)::INT) OVER (ORDER BY place) AS used FROM y),
v AS (SELECT *, bool_or(place > 1 AND (round(score, 6) < best - 25e-1 OR used > 1400 OR strong)) OVER (ORDER BY place) AS stopped FROM b),
w AS (SELECT *, min(place) OVER (PARTITION BY doc_id) AS f FROM v WHERE NOT stopped)
SELECT place, doc_id, sentence, dense_rank() OVER (ORDER BY f) AS source_number FROM w""",
    "runtime_answer": f"""WITH {bm25(W, 6)}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS number FROM r),
s AS (SELECT number, unnest(range(len(a))) AS pos, trim(unnest(a)) AS sentence FROM (SELECT number, {rsents('text')} AS a FROM k)),
o AS (SELECT *, len(list_intersect({rterms(f"'{QUESTION}'")}, {rterms('sentence')})) AS ov FROM s),
z AS (SELECT *, ov + least(length(sentence), 400) / 2000.0 AS score FROM o WHERE ov > 0 AND sentence <> ''),
u AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY {fold('sentence')} ORDER BY score DESC, number, pos) = 1)
SELECT row_number() OVER (ORDER BY score DESC, number, pos) AS place, number, sentence || ' [' || number || ']' AS sentence FROM u QUALIFY place <= 6""",
    "confidence": f"""WITH {bm25(W, 1)}, m AS (SELECT len(string_split(matched, ' ')) AS m, score FROM r)
SELECT round(least(95e-2, 12e-2 + 48e-2 * least(1e0, m / 4e0) + 28e-2 * (1 - exp(-score / 5))), 6) AS assistant, round(least(98e-2, 25e-2 + 12e-2 * m), 6) AS runtime, round(least(98e-2, 45e-2 + 8e-2 * least(m, 5)), 6) AS backend FROM m""",
    "context_pack": f"""WITH {bm25(W, 40)}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS number FROM r),
b AS (SELECT number, doc_id, '[SOURCE ' || number || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Location: document' || chr(10) || 'Domain: ' || domain || chr(10) || trim(text) AS block FROM k),
u AS (SELECT *, sum(length(block)) OVER (ORDER BY number) AS used FROM b), v AS (SELECT *, bool_or(used > 14000 AND number > 1) OVER (ORDER BY number) AS o FROM u)
SELECT number, doc_id, length(block) AS characters, sha256(block) AS block_sha256 FROM v WHERE NOT o""",
    "prompt_render": "SELECT conv_id, '<|bos|>' || string_agg('<|' || CASE WHEN lower(role) IN ('system', 'user', 'assistant') THEN lower(role) ELSE 'user' END || '|>' || chr(10) || trim(text) || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
    "plain_prompt": "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'ASSISTANT:' AS prompt FROM conversations GROUP BY conv_id",
    "summary_scores": rf"""WITH s AS ({exploded(sents('text'))}), a AS (SELECT *, {cterms('sentence')} AS t FROM s), b AS (SELECT * FROM a WHERE len(t) >= 3 AND length(sentence) >= 25),
u AS (SELECT doc_id, pos, unnest(list_distinct(t)) AS term FROM b), f AS (SELECT doc_id, term, count(*) AS f FROM u GROUP BY ALL), mx AS (SELECT doc_id, max(f) AS most FROM f GROUP BY ALL),
x AS (SELECT u.doc_id, u.pos, sum(f)::DOUBLE AS f FROM u JOIN f USING (doc_id, term) GROUP BY ALL)
SELECT b.doc_id, b.pos, round(x.f / most / sqrt(greatest(1, len(t))) + 35e-2 / (1 + b.pos) + 15e-2 + least(6e-1, 12e-2 * len(regexp_extract_all({ascii_of('sentence')}, '\b[A-Z][a-z]+\b'))), 6) AS score FROM b JOIN x ON b.doc_id = x.doc_id AND b.pos = x.pos JOIN mx ON mx.doc_id = b.doc_id""",
    "names_mentions": f"WITH {named()}, u AS (SELECT doc_id, pos, unnest(names) AS name FROM nm) SELECT name, count(*) AS mentions, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS documents FROM u GROUP BY name HAVING count(*) >= 2",
    "name_relationships": f"WITH {named()}, u AS (SELECT unnest(names) AS name, names FROM nm), p AS (SELECT name, unnest(names) AS other FROM u), c AS (SELECT name, other, count(*) AS together FROM p WHERE name <> other GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY together DESC, other) <= 12",
    "character_lookup": f"WITH {named()}, u AS (SELECT doc_id, pos, unnest(names) AS name FROM nm), g AS (SELECT name, count(*) AS mentions, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS documents FROM u GROUP BY name HAVING count(*) >= 2) SELECT * FROM g WHERE contains(lower(name), 'the a') OR contains('the a', lower(name)) ORDER BY lower(name) = 'the a' DESC, mentions DESC, name LIMIT 1",
    "ngram_counts": f"WITH {NGRAMS} SELECT context, next, n FROM g",
    "ngram_next_greedy": f"WITH {NGRAMS} SELECT context, first(next ORDER BY n DESC, place) AS next, sum(n)::BIGINT AS total FROM g GROUP BY context",
    "ngram_backoff": f"WITH {NGRAMS} SELECT next, sum(n)::BIGINT AS n FROM g WHERE context = 'the' OR suffix(context, ' the') GROUP BY next",
    "nucleus": f"""WITH d AS (SELECT list_concat(list_concat(['<BOS>'], {ltok('text')}), ['<EOS>']) AS t FROM documents),
i AS (SELECT t, unnest(range(1, len(t))) AS i FROM d), g AS (SELECT t[i] AS context, t[i + 1] AS token, ln(count(*)) AS logit FROM i GROUP BY ALL),
k AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY context)) / 8e-1) AS w FROM g QUALIFY rank() OVER (PARTITION BY context ORDER BY logit DESC) <= 50),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY context ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY context) AS whole FROM k)
SELECT context, token, round(w / sum(w) OVER (PARTITION BY context), 6) AS p FROM c WHERE before <= 95e-2 * whole""",
    "vocab_topk": f"SELECT term, count(*) AS n FROM (SELECT unnest({ltok('text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 500",
    "recent_turns": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "expand_query": rf"""WITH l AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS u, t2 AS a FROM l WHERE role = 'user' AND r2 = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3),
t AS (SELECT conv_id, flatten(list(list_concat({tok(r"array_to_string(regexp_extract_all(regexp_replace(u || ' ' || substr(a, 1, 500), '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b'), ' ; ')")}, {tok('u')}) ORDER BY turn DESC)) AS t FROM p GROUP BY conv_id),
q AS (SELECT conv_id, 'and it ' || arg_max(text, turn) AS question FROM conversations GROUP BY conv_id),
o AS (SELECT q.*, {tok('question')} AS own, t.t FROM q LEFT JOIN t USING (conv_id)),
f AS (SELECT *, list_filter(t, lambda x: length(x) > 2 AND NOT list_contains(own, x) AND NOT list_contains({quoted(PRONOUN_TERMS)}, x)) AS c FROM o),
g AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i)[1:18] AS e FROM f)
SELECT conv_id, CASE WHEN len(e) > 0 AND (len(own) <= 6 OR list_has_any(own, {quoted(PRONOUN_TERMS)})) THEN question || ' ' || array_to_string(e, ' ') ELSE question END AS expanded FROM g""",
    "sft_messages": f"SELECT conv_id, count(*) AS n, string_agg(role || '=' || content, '|' ORDER BY turn) AS chat FROM ({MSG}) GROUP BY conv_id",
    "sft_tokens_masked": f"WITH {SFT} SELECT conv_id, len(input_ids) AS n, sha256(array_to_string(input_ids, ',')) AS input_ids, sha256(array_to_string(labels, ',')) AS labels FROM ex",
    "sft_pad_truncate": f"WITH {SFT} SELECT conv_id, 256 AS n, sha256(array_to_string(list_concat(input_ids[1:256], list_transform(range(greatest(0, 256 - len(input_ids))), lambda x: 0)), ',')) AS input_ids, sha256(array_to_string(list_concat(labels[1:256], list_transform(range(greatest(0, 256 - len(labels))), lambda x: -100)), ',')) AS labels FROM ex",
    "train_val_split": f"WITH {SPLIT} SELECT * FROM sp",
    "token_blocks": f"""WITH d AS (SELECT doc_id, list_concat(list_concat([1], {bytes_of('text')}), [2]) AS t FROM documents), o AS (SELECT doc_id, unnest(t) AS t, unnest(range(len(t))) AS i FROM d),
s AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM o), n AS (SELECT count(*) AS n FROM s),
b AS (SELECT p // 512 AS block_id, p % 512 AS k, t FROM s UNION ALL SELECT p // 512 - 1, 512, t FROM s WHERE p % 512 = 0 AND p > 0)
SELECT block_id, count(*) AS n_tokens, arg_min(t, k)::BIGINT AS first_token, arg_max(t, k)::BIGINT AS last_token, sum(t * (k + 1))::BIGINT AS checksum, sum(t * k)::BIGINT AS label_checksum FROM b, n WHERE n > 512 AND block_id <= (n - 513) // 512 GROUP BY block_id""",
    "corpus_meta": f"WITH {SPLIT} SELECT split, count(*) AS documents, sum(strlen(text) + 2)::BIGINT AS tokens FROM documents JOIN sp USING (doc_id) GROUP BY split",
    "bpe_pair_counts": f'SELECT t[i] AS "left", t[i + 1] AS "right", count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {bytes_of("text")} AS t FROM documents)) GROUP BY ALL',
    "matmul": f"WITH {SCORES} SELECT i, j, round(v, 6) AS v FROM sc",
    "matrix_cells": f"WITH {SCORES}, b AS (SELECT j, sum(v) AS b FROM sc GROUP BY j) SELECT i, j, round(v + b - v, 5) AS v FROM sc JOIN b USING (j)",
    "softmax": f"WITH {SOFT} SELECT i, j, round(v, 6) AS v FROM sm",
    "activations": f"WITH {EMB} SELECT i, k, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(0e0, v), 6) AS relu, round(CASE WHEN v > 0 THEN v ELSE v * 1e-2 END, 6) + 0e0 AS leaky, round(tanh(v), 6) + 0e0 AS tanh FROM e",
    "losses": f"""WITH {SOFT}, c AS (SELECT sm.i, sm.v AS p, greatest(1e-7, least(1 - 1e-7, sm.v)) AS q, (sm.j = t.label)::INT::DOUBLE AS y FROM sm JOIN embeddings t ON t.vec_id = sm.i)
SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS bce, round(-sum(y * ln(q)) / count(DISTINCT i), 6) AS cce FROM c""",
    "accuracy": f"WITH {PAIRS} SELECT round(avg((actual = predicted)::INT), 6) AS accuracy FROM pr",
    "confusion_matrix": f"WITH {PAIRS}, c AS (SELECT DISTINCT actual AS c FROM pr) SELECT a.c AS actual, b.c AS predicted, count(pr.i) AS n FROM c a CROSS JOIN c b LEFT JOIN pr ON pr.actual = a.c AND pr.predicted = b.c GROUP BY ALL",
    "activation_derivatives": f"WITH {EMB} SELECT i, k, round(1 / (1 + exp(-v)) * (1 - 1 / (1 + exp(-v))), 6) AS sigmoid, CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END AS relu, CASE WHEN v > 0 THEN 1e0 ELSE 1e-2 END AS leaky, round(1 - tanh(v) * tanh(v), 6) AS tanh FROM e",
    "loss_derivatives": f"WITH {SOFT}, c AS (SELECT sm.i, sm.j, sm.v AS p, greatest(1e-7, least(1 - 1e-7, sm.v)) AS q, sm.j = t.label AS hit FROM sm JOIN embeddings t ON t.vec_id = sm.i) SELECT i, j, round((p - hit::INT) / 50, 6) AS mse, round(CASE WHEN hit THEN -1 / q ELSE 1 / (1 - q) END / 100, 6) AS bce, round(CASE WHEN hit THEN -1 / q / 100 ELSE 0e0 END, 6) AS cce FROM c",
    "binary_accuracy": f"WITH {SOFT} SELECT round(avg(((sm.v >= 1e-1) = (sm.j = t.label))::INT), 6) AS accuracy FROM sm JOIN embeddings t ON t.vec_id = sm.i",
    "perplexity": f"WITH {SOFT} SELECT round(avg(-ln(sm.v)), 6) AS mean_loss, round(exp(avg(-ln(sm.v))), 6) AS perplexity FROM sm JOIN embeddings t ON t.vec_id = sm.i AND sm.j = t.label",
    "ink_sums": f"WITH {EMB} SELECT 'y' AS axis, i AS place, count(*) FILTER (v > 0) AS n FROM e GROUP BY i UNION ALL SELECT 'x', k, count(*) FILTER (v > 0) FROM e GROUP BY k",
    "title_filter": f"SELECT doc_id, title FROM ({LIBRARY}) WHERE doc_id IN (3, 17, 400)",
    "semantic_payload": f"WITH {SEM.format(n=80)}, h AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10) SELECT doc_id, source, score FROM h JOIN documents ON doc_id = vec_id",
    "kind_stats": "SELECT lang AS domain, 'txt' AS kind, count(*) AS documents, count(*) AS titles FROM documents GROUP BY lang",
    "one_hot": "SELECT vec_id, array_to_string(list_transform(range(10), lambda x: (x = label)::INT), '') AS row FROM embeddings",
    "cer": "WITH b AS (SELECT item_id, regexp_replace(text, '[^A-Za-z .]', '', 'g') AS e FROM benchmark) SELECT a.item_id, round(CASE WHEN length(a.e) > 0 THEN levenshtein(a.e, b.e)::DOUBLE / length(a.e) ELSE (length(b.e) > 0)::INT END, 6) AS cer FROM b a JOIN b ON b.item_id = a.item_id + 1",
    "wer": r"""WITH b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z .]', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT a.item_id AS id, a.w AS a, b.w AS b, list_distinct(list_concat(a.w, b.w)) AS u FROM b a JOIN b ON b.item_id = a.item_id + 1),
c AS (SELECT id, len(a) AS n, array_to_string(list_transform(a, lambda x: chr(list_position(u, x)::INT)), '') AS x, array_to_string(list_transform(b, lambda x: chr(list_position(u, x)::INT)), '') AS y FROM p)
SELECT id, round(CASE WHEN n > 0 THEN levenshtein(x, y)::DOUBLE / n ELSE (y <> '')::INT END, 6) AS wer FROM c""",
    "otsu": """WITH h AS (SELECT n_chars % 256 AS v, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT v, sum(n) OVER o AS w, sum(v * n) OVER o AS s, sum(n) OVER () AS n, sum(v * n) OVER () AS total FROM h WINDOW o AS (ORDER BY v)),
b AS (SELECT v, w::DOUBLE * (n - w) * pow(s::DOUBLE / w - (total - s)::DOUBLE / (n - w), 2) AS b FROM s WHERE w < n) SELECT v::BIGINT AS threshold FROM b ORDER BY b DESC, v LIMIT 1""",
    "ink_runs": f"WITH {INK} SELECT line, start, size FROM rn",
    "glyph_gaps": f"WITH {INK}, g AS (SELECT line, start, start - lag(start + size) OVER (PARTITION BY line ORDER BY start) AS gap FROM rn) SELECT * FROM g WHERE gap IS NOT NULL",
    "word_gap": """WITH g AS (SELECT n_chars % 7 + CASE WHEN n_chars % 5 = 0 THEN 20 ELSE 1 END AS gap FROM documents), p AS (SELECT gap FROM g WHERE gap > 0), d AS (SELECT DISTINCT gap FROM p), j AS (SELECT gap, lead(gap) OVER (ORDER BY gap) AS a FROM d),
b AS (SELECT gap, a, a - gap AS jump FROM j WHERE a IS NOT NULL ORDER BY jump DESC, gap LIMIT 1), m AS (SELECT max(gap) AS largest, median(gap) AS typical, count(DISTINCT gap) AS kinds FROM p)
SELECT (CASE WHEN kinds > 1 AND jump >= greatest(2, typical * 75e-2) AND largest >= typical * 18e-1 THEN (gap + a) / 2.0 ELSE largest + 1 END)::DOUBLE AS threshold FROM m LEFT JOIN b ON true""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ROLLUP (day, event_type)",
    "learning_rate": "WITH s AS (SELECT DISTINCT o_orderkey % 2500 AS step FROM orders) SELECT step, round(1e6 * CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 ELSE 3e-5 + 5e-1 * (1 + cos(pi() * least(1e0, (step - 100) / 1900e0))) * (3e-4 - 3e-5) END, 6) AS rate FROM s",
    "epoch_rates": """WITH e AS (SELECT unnest(range(1, 101)) AS epoch), r AS (SELECT 'constant' AS schedule, epoch, 1e-1 AS v FROM e UNION ALL SELECT 'step', epoch, 1e-1 * pow(95e-2, (epoch - 1) // 10) FROM e
UNION ALL SELECT 'exponential', epoch, 1e-1 * pow(95e-2, epoch - 1) FROM e UNION ALL SELECT 'time', epoch, 1e-1 / (1 + 95e-2 * (epoch - 1)) FROM e UNION ALL SELECT 'cosine', epoch, 1e-6 + 5e-1 * (1e-1 - 1e-6) * (1 + cos(pi() * least(1e0, (epoch - 1) / 99e0))) FROM e)
SELECT schedule, epoch, round(1000 * greatest(1e-6, v), 6) AS rate FROM r""",
    "sft_holdout": f"WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM ({MSG})), v AS (SELECT n, CASE WHEN n >= 10 THEN greatest(1, n // 20) ELSE 0 END AS v FROM n) SELECT 'train' AS split, n - v AS n FROM v UNION ALL SELECT 'val', v FROM v WHERE v > 0",
    "train_test_split": "WITH n AS (SELECT count(*) AS n, greatest(1, round(count(*) * 2e-1))::BIGINT AS t FROM documents) SELECT 'test' AS split, t AS n FROM n UNION ALL SELECT 'train', n - t FROM n WHERE n > t",
    "context_windows": f"""WITH t AS (SELECT doc_id, unnest(range(len(a))) AS pos, lower(unnest(a)) AS token FROM (SELECT doc_id, {ltok('text')} AS a FROM documents)),
l AS (SELECT unnest({ltok('lower(text)')}) AS term FROM documents), v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 1 AS id FROM l GROUP BY term QUALIFY id <= 201),
k AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM t LEFT JOIN v ON v.term = t.token)
SELECT doc_id, pos, coalesce(lag(id, 2) OVER w, 0) AS c0, coalesce(lag(id) OVER w, 0) AS c1, id AS target FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "glyph_labels": f"WITH {SCORES}, x AS (SELECT i, j, exp(v * 20 - max(v * 20) OVER (PARTITION BY i)) AS e FROM sc), p AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS v FROM x), b AS (SELECT i, j, v FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY v DESC, j) = 1) SELECT i AS vec_id, CASE WHEN v >= 5e-1 THEN j::VARCHAR ELSE '?' END AS label, round(v, 6) AS confidence FROM b",
}
