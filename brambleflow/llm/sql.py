"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keys AS (
  SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS origin FROM keys WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.origin AS gone
  FROM keys k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), one AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words
), runs AS (
  SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x
  FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), items AS (
  SELECT DISTINCT doc_id, x FROM runs WHERE x IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(x)::BIGINT AS n FROM documents LEFT JOIN items USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM sizes UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.r
), groups AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN groups ON id = doc_id
"""

TOP_K = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

SUFFIX_DEDUP = """
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM raw
), parts AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 1096) AS p FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50, 499)) AS o FROM sized WHERE n >= 50)
), grams AS (
  SELECT doc_id, o + s AS s, md5(substr(p, 2 * s + 1, 100)) AS g
  FROM (SELECT doc_id, o, p, unnest(generate_series(0, least(498, length(p) // 2 - 50))) AS s FROM parts)
), firsts AS (
  SELECT g, min(doc_id) AS origin FROM grams GROUP BY g HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT doc_id, s FROM grams JOIN firsts USING (g) WHERE doc_id <> origin
), marks AS (
  SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s), 51) > 50 AS begins FROM gone
), spans AS (
  SELECT doc_id, s, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marks
), runs AS (
  SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM spans GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(generate_series(0, len(starts)),
    lambda i: substr(h, 2 * coalesce(ends[i], 0) + 1, 2 * (coalesce(starts[i + 1], n) - coalesce(ends[i], 0)))), '') END)) AS kept_sha256
FROM sized LEFT JOIN cut USING (doc_id)
"""

#: CRC-32 of a list of bytes b, byte by byte with the table t.
CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))"

IMPORTANCE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
), words AS (
  SELECT own, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), one AS (
  SELECT own, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words
), runs AS (
  SELECT own, id, w AS a, w || ' ' || lead(w, 1) OVER o AS b, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS c FROM one WINDOW o AS (PARTITION BY own, id ORDER BY i)
), features AS (
  SELECT own, id, a AS f FROM runs UNION ALL SELECT own, id, b FROM runs WHERE b IS NOT NULL UNION ALL SELECT own, id, c FROM runs WHERE c IS NOT NULL
), counted AS (
  SELECT own, id, f, count(*) AS n FROM features GROUP BY ALL
), bytes AS (
  SELECT f, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted))
), buckets AS (
  SELECT f, {CRC} % 10000 AS bucket FROM bytes, crc
), cells AS (
  SELECT own, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM cells GROUP BY bucket
), whole AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, whole
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE own GROUP BY id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents JOIN words ON own AND words.id = doc_id LEFT JOIN weights ON weights.id = doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

RANKED_SEARCH = f"""
WITH words AS (
  SELECT own, id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, '{UPPER}', '{LOWER}'))) AS term
  FROM (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark)
), counted AS (
  SELECT own, id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT id, sum(tf)::BIGINT AS n FROM counted WHERE own GROUP BY id
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes
), frequencies AS (
  SELECT term, count(*)::BIGINT AS df FROM counted WHERE own GROUP BY term
), weights AS (
  SELECT id AS item_id, term, tf * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM counted JOIN frequencies USING (term), corpus WHERE NOT own
), postings AS (
  SELECT id AS doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)) AS impact FROM counted JOIN sizes USING (id), corpus WHERE own
), scored AS (
  SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM weights JOIN postings USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op5_top_k": TOP_K,
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op8_suffix_dedup": SUFFIX_DEDUP,
    "op11_importance": IMPORTANCE,
    "op12_ranked_search": RANKED_SEARCH,
}
