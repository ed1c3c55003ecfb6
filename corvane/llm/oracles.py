"""DuckDB SQL for the sharding and filter audit queries."""

#: The checksum goes byte by byte: a table of 256 remainders, then a fold over each text's bytes.
_JUMP = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(b, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(256)) AS b)
),
held AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
sums AS (
    SELECT r, doc_id, octet_length(raw) + 1 AS size,
           xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)),
                           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
    FROM held, crc_table
),
jumps AS (
    SELECT doc_id, n, ((coalesce(doc_id, 0)::HUGEINT % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS k, -1::BIGINT AS b, 0::DOUBLE AS j
    FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (16), (17)) AS shards(n)
    UNION ALL
    SELECT doc_id, n, k2, j::BIGINT, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jumps) WHERE j < n
),
places AS (SELECT doc_id, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown_shard FROM jumps GROUP BY doc_id)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM sums s JOIN places p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
firsts AS (SELECT text AS whole, min(doc_id) AS first FROM texts GROUP BY text),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(split.doc_id > first, false)] AS failed
    FROM split LEFT JOIN known USING (doc_id) JOIN firsts ON text = whole
),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
    WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i
),
steps AS (SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, f.i AS step, o[f.i] AS filter, o[1:f.i - 1] AS before FROM orders, f),
done AS (
    SELECT part, filter_order, step, filter, good, toxic, failed[filter] AS bad, list_contains(list_transform(before, lambda i: failed[i]), true) AS gone,
           len(list_filter(failed, lambda x: x)) AS n_failed
    FROM fails, steps
),
rows AS (
    SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT bad) AS kept, count(*) FILTER (NOT gone AND bad) AS removed,
           count(*) FILTER (gone AND bad) AS redundant, count(*) FILTER (bad AND n_failed = 1) AS unique_fails,
           count(*) FILTER (NOT gone AND bad AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND bad AND toxic = 1) AS toxic_lost
    FROM done GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM rows
"""

ORACLES = {"op11_jump_shards": _JUMP, "op13_filter_audit": _AUDIT}
