"""DuckDB SQL for those queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import licenses

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT *, string_agg(word, ' ') OVER o AS run, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, word, i, n = 20 AND row_number() OVER (PARTITION BY md5(run), n ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

SUFFIX = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 800 <= len(h) THEN md5(substr(h, 2 * i + 1, 800)) END AS run FROM p),
f AS (SELECT doc_id, i, byte, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM s),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / pow(2, floor(log2(list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))))))) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id"""

_FOLD = rf"regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}')"
DECONTAMINATION = f"""
WITH t AS (SELECT item_id::VARCHAR AS item_id, {_FOLD} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS run FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM t WHERE len(w) > 0)),
d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten, word FROM p, (SELECT DISTINCT n FROM g)),
s AS (SELECT doc_id, i, n, array_to_string(string_split(ten, ' ')[1:n], ' ') AS run, len(string_split(ten, ' ')) AS there FROM q),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON g.run = s.run AND g.n = s.n WHERE s.there >= s.n),
b AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(b.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


EXACT = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))"""


#: The recursion goes through all conversations at once, a turn at a time, with the audit strings as they are. `moves` has every macro from every state.
REPAIR = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS z FROM raw, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN z = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE z <> 0),
told AS (SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
  FROM hurt WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (3, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']),
  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:']), (2, 2, 'II', 6, ['assistant:', 'user:']), (3, 3, 'II', 6, ['user:', 'assistant:'])) AS v(x, z, code, cost, put)),
edits AS (SELECT * FROM (VALUES (0, 0, 'D', 4, NULL, ''), (1, 1, 'D', 4, NULL, ''), (2, 2, 'D', 4, NULL, ''), (3, 3, 'D', 4, NULL, ''), (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (3, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'),
  (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (3, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', '')) AS v(z, y, edit, cost, initial, role)),
moves AS (SELECT x, y, ins.code || edit AS code, ins.cost + edits.cost AS cost, edit, initial, put, edits.role AS new FROM ins JOIN edits ON ins.z = edits.z),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS put FROM counts
  UNION ALL
  SELECT conv_id, i, s, b.cost, b.audit, b.put FROM (
    SELECT d.conv_id, t.i, m.y AS s, min({'cost': d.cost + m.cost + CASE WHEN m.edit <> 'D' AND t.open THEN 3 ELSE 0 END, 'audit': d.audit || m.code,
      'put': list_concat(d.put, m.put, CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [m.new || ':' || t.text] END)}) AS b
    FROM dp d JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1 JOIN moves m ON m.x = d.s AND (m.edit = 'D' OR NOT (t.blank OR t.again)) AND (m.edit <> 'K' OR m.initial = left(t.role, 1))
    GROUP BY d.conv_id, t.i, m.y)),
ends AS (SELECT c.conv_id, min({'cost': d.cost + e.cost, 'audit': d.audit || e.code, 'put': list_concat(d.put, e.put)}) AS b
  FROM counts c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.n JOIN ins e ON e.x = d.s AND e.z IN (0, 3) GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g))::BIGINT AS p FROM grid WINDOW g AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g))::BIGINT AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM grid GROUP BY ALL) WINDOW g AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING,
        "op3_suffix_array_dedup": SUFFIX,
        "op5_embedding_near_dedup": VECTORS,
        "op6_license_scan": licenses.sql(),
        "op8_decontamination": DECONTAMINATION,
        "op11_exact_dedup": EXACT,
        "op12_conversation_repair": REPAIR,
        "op13_source_divergence": DIVERGENCE,
    }
