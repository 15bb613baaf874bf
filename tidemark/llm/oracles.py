"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP3 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_SPACED}) AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

OP4 = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS place FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s GROUP BY source
), k AS (
  SELECT *, 2.0::DOUBLE * total / w AS ratio,
    (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(2 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t WINDOW o AS (ORDER BY 2.0::DOUBLE * total / w, source NULLS LAST)
), f AS (SELECT coalesce(min_by(level, ratio) FILTER (WHERE level < ratio), 1e300) AS level FROM k
), g AS (SELECT source, total, CASE WHEN 2 * total <= f.level * w THEN CAST(2 * total AS DOUBLE) ELSE f.level * w END AS target FROM t, f
), h AS (
  SELECT s.*, g.total, g.target, CASE WHEN total > 0 THEN CAST(floor(floor(target) / total) AS BIGINT) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY s.source, place) AS tied, sum(size) OVER (PARTITION BY s.source ORDER BY place) AS upto
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), r AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * total AS rest FROM h)
SELECT doc_id, size, total AS source_size, target, CAST(whole * size + CASE
    WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size
    WHEN upto - tied < rest THEN floor(CAST(size * (rest - upto + tied) AS DOUBLE) / tied) ELSE 0 END AS BIGINT) AS taken
FROM r
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), h AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1
), g AS (SELECT rid, list(DISTINCT i + k.k) AS gone FROM h SEMI JOIN r USING (h) CROSS JOIN (SELECT unnest(range(0, 35)) AS k) k GROUP BY rid
), x AS (SELECT d.*, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (rid)
), y AS (SELECT *, list_aggregate(list_filter(list_transform(w, lambda t, j: CASE WHEN NOT list_contains(gone, j) THEN t END), lambda t: t IS NOT NULL), 'string_agg', ' ') AS kept FROM x)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM y
"""

OP6 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), li AS (SELECT doc_id, p, l[p] AS t, regexp_matches(l[p], '[^\x20\x09-\x0D]') AS solid FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d)
), s AS (SELECT doc_id, p, t, octet_length(encode(t)) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, sum(octet_length(encode(t))) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM li WHERE solid
), w AS (SELECT doc_id, list(t ORDER BY k) AS w FROM s GROUP BY doc_id
), r AS (
  SELECT a.doc_id, a.k AS i, b.k AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.size + 40 AND b.upto - b.size < a.upto - a.size + 40
  UNION SELECT b.doc_id, a.k, b.k FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.upto - a.size <= b.upto - 40 AND a.upto > b.upto - 40
), h AS (SELECT doc_id, i, j, md5(array_to_string(w[i : j], chr(10))) AS h FROM r JOIN w USING (doc_id)
), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h
), g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS k FROM h JOIN f USING (h) WHERE doc_id > first
), x AS (SELECT li.doc_id, li.p, li.t, CASE WHEN li.solid THEN g.k IS NOT NULL END AS gone FROM li LEFT JOIN s USING (doc_id, p) LEFT JOIN g ON g.doc_id = s.doc_id AND g.k = s.k
), y AS (
  SELECT doc_id, p, t, coalesce(gone, bool_or(gone) OVER (PARTITION BY doc_id) IS NOT NULL
    AND coalesce(last_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AND coalesce(first_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true)) AS gone FROM x
), z AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM documents LEFT JOIN z USING (doc_id)
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), f AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(e, lambda t: t <> 0)) > 0
), l AS (
  SELECT a.rid AS x, b.rid AS y FROM f a JOIN f b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
), c AS (SELECT r.a AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.b GROUP BY r.a
), n AS (SELECT x AS rid, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_ALNUM}) AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_ALNUM}) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, md5(array_to_string(w[i : i + least(len(w), 13) - 1], ' ')) AS h
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT rid, i, m, md5(array_to_string(w[i : i + m - 1], ' ')) AS h
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hit AS (SELECT DISTINCT rid, i, m, item_id FROM p JOIN win USING (h, m)
), n AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, m)) AS k FROM hit) GROUP BY rid
), t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) || '00' AS h FROM p
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(i * 5 // 4 + 1 AS INT), 3) AS INT) >> CAST(7 - (i * 5) % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM h
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

#: crc32 of the decimal digits of {c}: eight steps a byte, the byte coming in with the first.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)"""

OP11 = f"""
WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, {_CRC.format(c="doc_id")} AS h FROM documents
), a AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p
), t AS (SELECT doc_id, n, i, w[i + 1] AS t FROM (SELECT doc_id, n, w, unnest(range(0, n)) AS i FROM d)
), e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e) GROUP BY doc_id, q, isle
), r AS (SELECT doc_id, start, CAST(m AS BIGINT) AS m, CAST(min(q) AS BIGINT) AS q FROM s WHERE m >= greatest(24, 3 * q) GROUP BY doc_id, start, m
), u AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || m || ',' || q || chr(10), '' ORDER BY start, q) AS runs, list({{'start': start, 'm': m, 'q': q}} ORDER BY m::DOUBLE / q DESC, start, q)[1] AS top FROM r GROUP BY doc_id
), g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + m)) AS i FROM r
), k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM t ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.m AS length, top.q AS period, 1000 * top.m // top.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP12 = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS k, len(coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT c, list({{'k': md5(k), 'm': m}} ORDER BY i) AS own FROM t GROUP BY c
), h AS (SELECT c, own, {_CRC.format(c="c")} % 6 AS h FROM l
), b AS (SELECT h.c, list_concat(coalesce(l.own[1 : h.h], []), h.own[h.h + 1 :]) AS s FROM h LEFT JOIN l ON l.c = h.c - h.c % 100
), p AS (SELECT c, len(s) AS n, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_transform(s[1 : d], lambda x: x.k), ',') END AS path, CASE WHEN d = 0 THEN 0 ELSE s[d].m END AS m FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)
), v AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(m) AS m, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY d, path
), w AS (SELECT *, CASE WHEN d = 1 THEN '' ELSE substr(path, 1, 33 * (d - 1) - 1) END AS up FROM v
), f AS (SELECT a.*, (SELECT count(*) FROM w x WHERE x.d = a.d + 1 AND x.up = a.path) AS n_children FROM w a
), z AS (
  SELECT a.d, a.path, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.m) AS BIGINT) AS saved_tokens
  FROM f a JOIN f x ON x.d >= a.d AND (a.d = 0 OR substr(x.path, 1, 33 * a.d - 1) = a.path) GROUP BY a.d, a.path
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, z.n_leaves, z.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN z USING (d, path) LEFT JOIN f u ON u.d = f.d - 1 AND u.path = f.up AND f.d > 0
"""

#: Each string that a template of the chats escapes, and how often it stands in {t}.
_CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>"]
_BREAKS = " + ".join(f"2 * (len({{t}}) - len(replace({{t}}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
_GROWN = f"len({{t}}) + len({{t}}) - len(replace({{t}}, '␛', '')) + {_BREAKS}"

OP13 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), g AS (SELECT *, {_GROWN.format(t="role")} + {_GROWN.format(t="text")} + 32 AS m FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(m) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

ORACLES = {"op2_warc": OP2, "op3_ngram_jaccard_join": OP3, "op4_mixing": OP4, "op5_substring_dedup": OP5, "op6_line_dedup": OP6, "op7_embedding_near_dedup": OP7, "op9_decontamination": OP9, "op11_periodic_runs": OP11, "op12_prefix_trie": OP12, "op13_chat_formatting": OP13}
