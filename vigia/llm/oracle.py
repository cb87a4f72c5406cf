"""DuckDB SQL for the queries that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS p FROM n WHERE n_bytes >= 50)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id
), begins AS (
  SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM hit
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM begins
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT n.doc_id, coalesce(max(s.b), 0), n.n_bytes FROM n LEFT JOIN spans s USING (doc_id) GROUP BY n.doc_id, n.n_bytes
), kept AS (
  SELECT g.doc_id, string_agg(substr(n.h, 2 * g.x + 1, 2 * (g.y - g.x)), '' ORDER BY g.x) AS k
  FROM gaps g JOIN n USING (doc_id) GROUP BY g.doc_id
), sizes AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT n.doc_id, n.n_bytes::BIGINT AS n_bytes, coalesce(z.gone, 0)::BIGINT AS n_removed,
       coalesce(z.spans, 0)::BIGINT AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM n JOIN kept k USING (doc_id) LEFT JOIN sizes z USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sums AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
        + length('<|im_end|>') + 1) AS size
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars
FROM sums
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, min(r.b)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.sh
"""

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), each AS (
  SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM each
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1
  GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id FROM own
), hashed AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda p: ascii(substr(conv_id::VARCHAR, p::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
      lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM ids
), joined AS (
  SELECT h.conv_id, o.i, o.role, o.text FROM hashed h JOIN own o ON o.conv_id = h.base AND o.i <= h.h
  UNION ALL SELECT h.conv_id, o.i + 1000000000, o.role, o.text FROM hashed h JOIN own o ON o.conv_id = h.conv_id AND o.i > h.h
), steps AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, role, text FROM joined
), path AS (
  SELECT conv_id, d, octet_length(encode(text)) AS size,
         sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d)
           OVER (PARTITION BY conv_id ORDER BY d)) AS p
  FROM (SELECT conv_id, d, role, text FROM steps)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), depth AS (
  SELECT conv_id, max(d) AS deep FROM path GROUP BY conv_id
), node AS (
  SELECT p.d, p.p, min(p.conv_id) AS m, count(*) AS n, any_value(p.size) AS size,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.d = e.deep), '') AS ends
  FROM path p JOIN depth e USING (conv_id) GROUP BY p.d, p.p
), above AS (
  SELECT p.conv_id, p.d, n.m FROM path p JOIN node n ON n.d = p.d AND n.p = p.p
), edges AS (
  SELECT n.*, a.m AS up FROM node n LEFT JOIN above a ON a.conv_id = n.m AND a.d = n.d - 1
), fan AS (
  SELECT up AS m, d - 1 AS d, count(*) AS children FROM edges WHERE d > 0 GROUP BY up, d
), sums AS (
  SELECT a.m, a.d, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (f.children IS NULL) AS leaves
  FROM node n JOIN above a ON a.conv_id = n.m AND a.d <= n.d LEFT JOIN fan f ON f.m = n.m AND f.d = n.d
  GROUP BY a.m, a.d
)
SELECT e.m AS conv_id, e.d::BIGINT AS depth, e.up AS parent_conv_id, e.n::BIGINT AS n_convs,
       coalesce(f.children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(e.ends) AS ends_sha256
FROM edges e JOIN sums s ON s.m = e.m AND s.d = e.d LEFT JOIN fan f ON f.m = e.m AND f.d = e.d
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a, min(v.vec_id) AS m FROM reach r JOIN v ON v.r = r.b GROUP BY r.a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(v.vec_id, l.m) AS component_id,
       v.vec_id IS NOT DISTINCT FROM least(v.vec_id, l.m) AS kept
FROM v LEFT JOIN degree d ON d.a = v.r LEFT JOIN least l ON l.a = v.r
"""

ORACLE = {
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op6_chat_format": CHAT_FORMAT,
    "op7_jaccard_join": JACCARD_JOIN,
    "op10_line_dedup": LINE_DEDUP,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_embedding_dedup": EMBEDDING_DEDUP,
}
