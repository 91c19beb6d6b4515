"""DuckDB SQL of the queries that SQL can express, written apart from the operators' methods."""

# Secret spans: places by summed lengths; entropy by recounting every window's characters.
SECRETS = r"""
WITH patterns(kind, name, pat, least) AS (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0),
    (1, 'access', 'AKIA[A-Z0-9]+', 18),
    (2, 'hex', '[0-9a-f]+', 16),
    (3, 'entropy_hex', '[0-9A-Fa-f]+', 20),
    (4, 'entropy_base64', '[A-Za-z0-9+/_=-]+', 24)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
    SELECT r, kind, name, least, unnest(found) AS x, unnest(gaps[1:len(found)]) AS gap,
           unnest(vals) AS val, unnest(range(len(found))) AS i
    FROM (SELECT r, kind, name, least,
                 regexp_extract_all(text, pat) AS found,
                 string_split_regex(text, pat) AS gaps,
                 CASE kind WHEN 0 THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
                      ELSE regexp_extract_all(text, pat) END AS vals
          FROM d, patterns)),
p AS (
    SELECT *, sum(len(gap) + len(x)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM m),
base AS (
    SELECT r, kind, name, (stop - len(x))::BIGINT AS start, stop::BIGINT AS stop FROM p
    WHERE kind < 3 AND len(x) >= least AND (kind <> 0 OR len(val) >= 12)),
cand AS (
    SELECT r, kind, name, i, x, stop - len(x) AS start, least AS w,
           CASE kind WHEN 3 THEN 3.05 ELSE 3.9 END AS bits,
           CASE kind WHEN 3 THEN 2 ELSE 1 END AS digits, CASE kind WHEN 3 THEN 2 ELSE 3 END AS letters
    FROM p WHERE kind >= 3 AND len(x) >= least AND NOT regexp_matches(x, '(?i)(^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(256|384|512)-)')),
win AS (
    SELECT r, kind, name, i, start, w, pos, bits, digits, letters, substr(x, (pos + 1)::BIGINT, w) AS s
    FROM (SELECT *, unnest(range(len(x) - w + 1)) AS pos FROM cand)),
hot AS (
    SELECT * FROM win
    WHERE list_aggregate(string_split(s, ''), 'entropy') >= bits
      AND len(regexp_extract_all(s, '[0-9]')) >= digits
      AND len(regexp_extract_all(s, '[A-Za-z]')) >= letters
      AND NOT regexp_matches(s, '(?i)(example|sample|placeholder|dummy|changeme|xxxx|abcdefgh|01234567|12345678)')),
isle AS (
    SELECT *, sum(fresh) OVER (PARTITION BY r, kind, i ORDER BY pos) AS island
    FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, kind, i ORDER BY pos) <= w
                         THEN 0 ELSE 1 END AS fresh FROM hot)),
high AS (
    SELECT r, kind, name, (start + min(pos))::BIGINT AS start,
           (start + max(pos) + max(w))::BIGINT AS stop
    FROM isle GROUP BY r, kind, name, i, start, island),
every AS (SELECT * FROM base UNION ALL SELECT * FROM high),
agg AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)
               FILTER (kind < 3) AS base,
           string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
    FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (r)
"""

# Windows of test items against all word runs of the same length.
DECONTAMINATION = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
           array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i
          FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
runs AS (
    SELECT r, size, i, array_to_string(w[i + 1:i + size], ' ') AS s
    FROM (SELECT r, size, w, unnest(range(len(w) - size + 1)) AS i
          FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT r, i, runs.size, item_id FROM runs JOIN wins USING (size, s)),
covered AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

# Damage and repair, turn by turn: the least (cost, audit) of each last initial after each turn.
CONVERSATIONS = r"""
WITH RECURSIVE moves(st, nxt, added) AS (VALUES
    ('0', '0', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('0', 'u', 'I'),
    ('0', 'a', 'II'), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'a', 'I'), ('a', 'u', 'I')),
follows(st, nxt) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295::BIGINT] || list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda c: ascii(c)::BIGINT),
               lambda crc, b: list_reduce([xor(crc, b)] || list_transform(range(8), lambda z: 0::BIGINT),
                   lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
               4294967295) % 20 AS hit
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM src WHERE hit <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged),
rows AS (
    SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
           CASE WHEN body = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
sizes AS (
    SELECT conv_id, count(*) AS n,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id),
best(conv_id, pos, st, cost, audit) AS (
    SELECT conv_id, 0::BIGINT, '0', 0::BIGINT, '' FROM sizes
    UNION ALL
    SELECT conv_id, pos, st, cost, audit FROM (
        SELECT conv_id, pos, st, cost, audit,
               row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS rn
        FROM (
            SELECT b.conv_id, b.pos + 1 AS pos, e.st,
                   b.cost + 3 * len(m.added) + e.cost AS cost, b.audit || m.added || e.edit AS audit
            FROM best b JOIN moves m USING (st)
            JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1
            CROSS JOIN LATERAL (
                SELECT m.nxt AS st, 4 AS cost, 'D' AS edit
                UNION ALL
                SELECT f.nxt, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM follows f
                WHERE f.st = m.nxt AND f.nxt = r.initial AND r.fault IN ('', 'truncated')
                UNION ALL
                SELECT f.nxt, CASE WHEN r.fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM follows f
                WHERE f.st = m.nxt AND f.nxt <> 's' AND r.fault IN ('', 'truncated')) e))
    WHERE rn = 1),
ended AS (
    SELECT conv_id, cost, audit FROM (
        SELECT b.conv_id, b.cost + 3 * len(m.added) AS cost, b.audit || m.added AS audit,
               row_number() OVER (PARTITION BY b.conv_id
                                  ORDER BY b.cost + 3 * len(m.added), b.audit || m.added) AS rn
        FROM best b JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.pos
        JOIN moves m USING (st) WHERE m.nxt IN ('0', 'a')) WHERE rn = 1),
letters AS (
    SELECT conv_id, i, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos
    FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS i
          FROM ended WHERE audit <> '')),
made AS (
    SELECT l.conv_id, l.i, l.edit, r.role, r.text,
           row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) - 1 AS place,
           first_value(l.edit = 'K' AND r.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY l.i) AS lead
    FROM letters l LEFT JOIN rows r
        ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.pos AND l.edit <> 'I'
    WHERE l.edit <> 'D'),
repaired AS (
    SELECT conv_id, string_agg(
               CASE WHEN edit = 'K' THEN role WHEN (place - lead::INT) % 2 = 0 THEN 'user'
                    ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
               chr(10) ORDER BY place) AS whole
    FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank,
       coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# Scores of every item and document that share a term.
RANKED = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
held AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM held),
asked AS (
    SELECT DISTINCT item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL),
postings AS (
    SELECT r, doc_id, n, term, count(*) AS tf
    FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
gains AS (
    SELECT r, doc_id, term,
           w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))) AS gain
    FROM postings JOIN weights USING (term), total),
scores AS (
    SELECT item_id, doc_id, sum(gain)::BIGINT AS score
    FROM asked JOIN gains USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank
    FROM scores WHERE score > 0)
WHERE rank <= 50
"""
