"""DuckDB SQL for the registered queries that SQL can express."""

#: runs of two lines and more that occur earlier are cut out; blank lines are not compared
LINE_DEDUP = """
WITH split AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, unnest(lines) AS own, unnest(range(len(lines))) AS line FROM split
), kept AS (
    SELECT doc_id, line, trim(own, ' ' || chr(9) || chr(13)) AS own FROM numbered WHERE trim(own, ' ' || chr(9) || chr(13)) <> ''
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i,
           lead(own) OVER (PARTITION BY doc_id ORDER BY line) AS own2,
           lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS last
    FROM kept
), windows AS (
    SELECT *, row_number() OVER (PARTITION BY own, own2 ORDER BY doc_id, i) AS nth FROM placed WHERE own2 IS NOT NULL
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(line, last + 1)))) AS gone FROM windows WHERE nth > 1 GROUP BY doc_id
)
SELECT s.doc_id,
       CASE WHEN g.gone IS NULL THEN s.text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(len(s.lines)), lambda n: NOT list_contains(g.gone, n)), lambda n: s.lines[n + 1]), chr(10)), '') END AS text,
       CAST(coalesce(len(g.gone), 0) AS BIGINT) AS removed_lines
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
"""

#: cosine of double components; sound vectors only, the nearest five of each query
NEAREST = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))
           / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(c.v, lambda x: x * x))) AS score
    FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: unsigned crc32 of a text's bytes, bit by bit over a table made from its polynomial
CRC32 = """
crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)
)"""
#: the crc32 of ``{}``, in a query that has crc_table.t at hand
CRC32_OF = """xor(4294967295, list_reduce(string_split({0}, ''), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, ascii(x))]), CAST(4294967295 AS BIGINT)))"""

#: leaves, levels and climbs of the manifest: runs of two within a language, then over the subroots
MERKLE = f"""
WITH RECURSIVE {CRC32}, hashed AS (
    SELECT doc_id, lang, n_chars,
           sha256(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
               || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')
               || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           sha256(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
               || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-')
               || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS changed,
           {CRC32_OF.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS tampered
    FROM documents, crc_table
), leaves AS (
    SELECT doc_id, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS found,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM hashed
), levels AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 2
), subroots AS (
    SELECT tree AS pos, h, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
    SELECT 0 AS level, pos, n, h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2
), nodes AS (
    SELECT tree, level, pos, n, h FROM levels WHERE n > 1 UNION ALL SELECT -1, level, pos, n, h FROM tops WHERE n > 1
), climb AS (
    SELECT tree AS own, pos AS place, tree, 0 AS level, pos, n, found AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT c.own, c.place, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
           CASE WHEN c.n = 1 THEN c.tree ELSE c.pos // 2 END, CASE WHEN c.n = 1 THEN (SELECT max(n) FROM subroots) ELSE (c.n + 1) // 2 END,
           CASE WHEN c.n = 1 THEN c.folded WHEN c.pos % 2 = 1 THEN sha256(s.h || c.folded) ELSE sha256(c.folded || coalesce(s.h, '')) END,
           c.proof || CASE WHEN c.n = 1 THEN '' ELSE coalesce(s.h, '') END
    FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
    WHERE c.n > 1 OR c.tree >= 0
)
SELECT l.doc_id, l.leaf, b.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM leaves l JOIN climb c ON c.own = l.tree AND c.place = l.pos AND c.tree = -1 AND c.n = 1 JOIN subroots b ON b.pos = l.tree, (SELECT h FROM tops WHERE n = 1) r
"""

#: edits as (state before, inserts, state then): 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row
CONVERSATIONS = f"""
WITH RECURSIVE {CRC32}, spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {CRC32_OF.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
    FROM conversations, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM spaced WHERE fault <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text), copy) AS i,
           right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS ending
    FROM damaged
), marked AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS adjoining
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 1 AND adjoining NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), inserts(before, text, upon) AS (
    VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)
), edits(upon, edit, initial, state, cost) AS (
    VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
           (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3),
           (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4)
), steps AS (
    SELECT before, text || edit AS text, initial, edit, state, 3 * length(text) + cost AS cost FROM inserts JOIN edits USING (upon)
), paths AS (
    SELECT conv_id, 0 AS i, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM counted
    UNION ALL
    SELECT p.conv_id, p.i + 1, s.state, min({{'cost': p.best.cost + s.cost + CASE WHEN m.fault = 'truncated' AND s.edit <> 'D' THEN 3 ELSE 0 END, 'audit': p.best.audit || s.text}})
    FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1
    JOIN steps s ON s.before = p.state AND (s.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (s.initial IS NULL OR s.initial = left(m.role, 1))
    GROUP BY p.conv_id, p.i, s.state
), best AS (
    SELECT p.conv_id, min({{'cost': p.best.cost + 3 * length(e.text), 'audit': p.best.audit || e.text}}) AS best
    FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
    JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(state, text) ON e.state = p.state
    GROUP BY p.conv_id
), walk AS (
    SELECT conv_id, 0 AS k, 0 AS i, 0 AS state, CAST(NULL AS VARCHAR) AS repaired, best.audit AS audit FROM best
    UNION ALL
    SELECT w.conv_id, w.k + 1, CASE WHEN w.edit = 'I' THEN w.i ELSE w.i + 1 END,
           CASE WHEN w.edit = 'D' THEN w.state WHEN w.edit = 'K' AND left(m.role, 1) = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END,
           CASE WHEN w.edit = 'D' THEN w.repaired
                ELSE coalesce(w.repaired || chr(10), '') || CASE WHEN w.edit = 'K' THEN m.role WHEN w.state = 2 THEN 'assistant' ELSE 'user' END || ':'
                     || CASE WHEN w.edit = 'I' THEN '' ELSE m.text END END,
           w.audit
    FROM (SELECT *, substring(audit, k + 1, 1) AS edit FROM walk WHERE k < length(audit)) w
    LEFT JOIN marked m ON w.edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(b.best.cost, 0) AS BIGINT) AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(w.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.k = length(w.audit)
"""
