"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents, fold
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark, fold
),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, list_slice(words, pos, pos + least(10, len(words)) - 1) AS pattern
  FROM items, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(pos)
  WHERE len(words) > 0
),
sizes AS (SELECT DISTINCT size FROM patterns),
hits AS (
  SELECT doc_id, pos, size, item_id
  FROM (
    SELECT doc_id, size, pos, list_slice(words, pos, pos + size - 1) AS pattern
    FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(pos)
  ) JOIN patterns USING (size, pattern)
),
covered AS (SELECT doc_id, count(DISTINCT w) AS n FROM hits, unnest(range(pos, pos + size)) AS t(w) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP2 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT 0 AS step, sum(source_size) * 1.5::DOUBLE / sum(weight)::DOUBLE AS level FROM sources
  UNION ALL
  SELECT step + 1, (
    SELECT (sum(source_size) * 1.5::DOUBLE - sum(CASE WHEN weight * level > 2 * source_size THEN 2 * source_size ELSE 0 END))
      / nullif(sum(CASE WHEN weight * level > 2 * source_size THEN 0 ELSE weight END), 0)::DOUBLE FROM sources)
  FROM levels WHERE step < 100 AND level IS NOT NULL
),
targets AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, weight * (SELECT max(level) FROM levels)), 2.0::DOUBLE * source_size) AS target FROM sources
),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""

OP10 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, pos, hash(list_slice(words, pos, pos + 34)) AS h, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS m
  FROM docs, unnest(range(1, len(words) - 33)) AS t(pos)
),
repeated AS (SELECT h, m FROM starts GROUP BY h, m HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, w FROM starts JOIN repeated USING (h, m), unnest(range(pos, pos + 35)) AS t(w)),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body
  FROM (SELECT doc_id, pos, words[pos] AS word FROM docs, unnest(range(1, len(words) + 1)) AS t(pos)) AS w
  ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.w = w.pos
  GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, text, coalesce(doc_id::VARCHAR, '') AS name,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head
  FROM documents
),
leaves AS (
  SELECT row_no, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(name))), lambda crc, i:
        xor((CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(name, (i // 8 + 1)::INTEGER, 1))) ELSE crc END) >> 1,
          CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(name, (i // 8 + 1)::INTEGER, 1))) ELSE crc END) % 2 = 1 THEN 3988292384 ELSE 0 END)
      ) % 2 = 1
      THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM docs
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
),
trees AS (
  SELECT source, 0 AS height, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM trees WHERE n > 1 GROUP BY source, height, idx // 3, n
),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS idx, count(*) OVER () AS n FROM trees WHERE n = 1
),
tops AS (
  SELECT 0 AS height, idx, n, digest FROM subroots
  UNION ALL
  SELECT height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY height, idx // 3, n
),
low AS (
  SELECT row_no, source, 0 AS height, idx, n, coalesce(changed, leaf) AS digest, ''::VARCHAR AS proof FROM placed
  UNION ALL
  SELECT f.row_no, any_value(f.source), f.height + 1, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN k.idx = f.idx THEN f.digest ELSE k.digest END, '' ORDER BY k.idx)),
    f.proof || coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (WHERE k.idx <> f.idx), '')
  FROM low f JOIN trees k ON k.source IS NOT DISTINCT FROM f.source AND k.height = f.height AND k.idx // 3 = f.idx // 3
  WHERE f.n > 1 GROUP BY f.row_no, f.height, f.idx, f.n, f.proof
),
high AS (
  SELECT l.row_no, 0 AS height, s.idx, s.n, l.digest, l.proof FROM low l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source WHERE l.n = 1
  UNION ALL
  SELECT f.row_no, f.height + 1, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN k.idx = f.idx THEN f.digest ELSE k.digest END, '' ORDER BY k.idx)),
    f.proof || coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (WHERE k.idx <> f.idx), '')
  FROM high f JOIN tops k ON k.height = f.height AND k.idx // 3 = f.idx // 3
  WHERE f.n > 1 GROUP BY f.row_no, f.height, f.idx, f.n, f.proof
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT digest FROM tops WHERE n = 1) t ON true
JOIN high f ON f.row_no = p.row_no AND f.n = 1
"""

OP12 = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
docs AS (
  SELECT row_number() OVER () AS doc_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents, fold
),
items AS (
  SELECT row_number() OVER () AS item_no, item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark, fold
),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
sized AS (SELECT doc_no, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m, terms FROM docs, total WHERE len(terms) > 0),
postings AS (SELECT doc_no, m, term, count(*) AS tf FROM (SELECT doc_no, m, unnest(terms) AS term FROM sized) GROUP BY doc_no, m, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, n_docs),
wanted AS (SELECT item_no, term, count(*) AS times FROM (SELECT item_no, unnest(terms) AS term FROM items) GROUP BY item_no, term),
scores AS (
  SELECT item_no, doc_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_no, doc_no
),
ranked AS (
  SELECT item_no, doc_id, score, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST) AS place
  FROM scores JOIN docs USING (doc_no) WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (item_no) WHERE place <= 10
"""

OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT row_no, doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(lines) + 1)) AS t(pos)
),
repeated AS (
  SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3
),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.top AS gone FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no
"""

ORACLE = {"op1_decontaminate": OP1, "op2_mix_sources": OP2, "op10_substring_dedup": OP10, "op11_merkle_manifest": OP11, "op12_ranked_search": OP12, "op13_line_dedup": OP13}
