"""DuckDB twins of the registered queries that SQL can express."""

OP3 = """
WITH texts AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, ls, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM texts),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS v FROM lines),
windows AS (
  SELECT *, coalesce(lead(v) OVER (PARTITION BY doc_id ORDER BY i), 0) AS v2 FROM hashed),
starts AS (
  SELECT doc_id, ls, n, i, base
  FROM windows, (VALUES (536870909), (715827883), (954437177)) AS b(base)
  WHERE (i = 1 OR ((v * base + v2) % 2147483647) % 8 <> 0)),
followed AS (
  SELECT *, lead(i, 1) OVER w AS next1, lead(i, 2) OVER w AS next2
  FROM starts WINDOW w AS (PARTITION BY doc_id, base ORDER BY i)),
chunks AS (
  SELECT DISTINCT doc_id, i AS start, coalesce(CASE WHEN next1 >= i + 2 THEN next1 ELSE next2 END, n + 1) - 1 AS stop, ls
  FROM followed WHERE i < n),
bodies AS (
  SELECT doc_id, start, stop, array_to_string(ls[start:stop], chr(10)) AS body FROM chunks),
gone AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS r FROM bodies) WHERE r > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM gone),
counted AS (
  SELECT doc_id, count(*) AS n_chunks FROM gone GROUP BY doc_id),
out AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '')) AS kept_sha256
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed,
       coalesce(k.n_chunks, 0) AS n_chunks, o.kept_sha256
FROM documents d LEFT JOIN out o ON o.doc_id = d.doc_id LEFT JOIN counted k ON k.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, ws, least(10, len(ws)) AS n
          FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, w.n, i, item_id FROM doc_windows w JOIN item_windows b ON w.n = b.n AND w.win = b.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said, turn,
         replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS name
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS place FROM t),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
parts AS (
  SELECT p.conv_id, speaker, place // 64 AS block, place, role = speaker AS own,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
              ELSE '<|user name=' || name || CASE WHEN ends_with(name, '<') THEN ' ' ELSE '' END || '|>' END || chr(10) || said || '<|end|>' || chr(10) AS part
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
spans AS (
  SELECT *, CAST(sum(length(part)) OVER (PARTITION BY conv_id, speaker, block ORDER BY place) AS BIGINT) AS stop
  FROM parts)
SELECT conv_id, speaker, CAST(block AS BIGINT) AS block, count(*) AS n_turns,
       string_agg(part, '' ORDER BY place) AS text,
       coalesce(string_agg((stop - length(part) + 14) || '-' || stop, ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM spans GROUP BY conv_id, speaker, block
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE = {
    "op3_line_dedup": OP3,
    "op5_decontamination": OP5,
    "op7_chat_formatting": OP7,
    "op9_top_k": OP9,
}
