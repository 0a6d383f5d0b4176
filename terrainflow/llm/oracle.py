"""DuckDB SQL of the corpus queries that SQL can express within reason; byte windows (op6) take it too long, so a brute-force version stands in."""

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS chars FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' OR i = n AS target FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (target))::BIGINT AS formatted_chars, count(*) FILTER (target) AS n_examples
FROM p GROUP BY 1"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM k WHERE again),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.pos) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
e AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, range(1, 5) t(size)),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM e GROUP BY ALL HAVING f >= 30),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM c, range(1, 4) t(k) WHERE k < size),
s AS (SELECT x.lang, x.phrase, x.a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * x.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts x JOIN g h ON h.lang = x.lang AND h.phrase = head JOIN g t ON t.lang = x.lang AND t.phrase = tail),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS m FROM c, range(2, 4) t(k), range(1, 4) u(i) WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.m IS NULL OR 100::HUGEINT * o.m < 80::HUGEINT * b.a),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

OP13 = r"""
WITH RECURSIVE
bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, coalesce('=' || source, '') AS tree,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS tamper FROM documents, tab),
g AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN tamper THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS t FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM g),
lv(k, tree, idx, n, h) AS (SELECT 0, tree, idx, n, h FROM leaves
  UNION ALL SELECT k + 1, tree, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY k, tree, n, idx // 16),
tops AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
up(k, idx, n, h) AS (SELECT 0, idx, n, subroot FROM tops
  UNION ALL SELECT k + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY k, n, idx // 16),
runs AS (SELECT 0 AS part, k, tree, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM lv WHERE n > 1 GROUP BY k, tree, idx // 16
  UNION ALL SELECT 1, k, '', idx // 16, list(h ORDER BY idx) FROM up WHERE n > 1 GROUP BY k, idx // 16),
places AS (SELECT l.tree, l.idx, l.doc_id, l.h, l.t, s.subroot, s.idx AS at FROM leaves l JOIN tops s USING (tree)),
steps AS (SELECT p.tree, p.idx, list(array_to_string(r.hs[1:slot], '') || '#' || array_to_string(r.hs[slot + 2:], '') ORDER BY r.part, r.k) AS steps FROM (
    SELECT p.tree, p.idx, 0 AS part, k, p.tree AS owner, p.idx // (16 ** k)::BIGINT AS node FROM places p, range(12) t(k)
    UNION ALL SELECT p.tree, p.idx, 1, k, '', p.at // (16 ** k)::BIGINT FROM places p, range(12) t(k)) p
  JOIN runs r ON r.part = p.part AND r.k = p.k AND r.tree = p.owner AND r.run = p.node // 16, LATERAL (SELECT p.node % 16 AS slot) GROUP BY 1, 2),
done AS (SELECT p.*, coalesce(s.steps, []) AS steps, (SELECT h FROM up WHERE n = 1) AS root FROM places p LEFT JOIN steps s USING (tree, idx))
SELECT doc_id, h AS leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '#', '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(t, h)], steps), lambda a, b: sha256(replace(b, '#', a))) AS folded_root, folded_root = root AS verified FROM done"""


def oracle_sql() -> dict[str, str]:
    return {"op1_prefix_targets": OP1, "op2_relative_lempel_ziv": OP2, "op12_misra_gries_phrases": OP12, "op13_merkle_windows": OP13}
