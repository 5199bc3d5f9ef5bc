"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, upper(sha1(html)) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda k: ('0x' || substr(x, k, 5))::BIGINT) AS v FROM h),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(v, lambda n:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

OP4 = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
e AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, text,
      CASE role WHEN 'user' THEN conv_id || '/' || turn WHEN 'assistant' THEN conv_id || '/' || (turn - 1) END AS call_id FROM m),
deep(conv_id, turn, depth) AS (
    SELECT conv_id, turn, 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.conv_id = m.conv_id AND p.turn = m.turn - 1)
    UNION ALL SELECT m.conv_id, m.turn, depth + 1 FROM deep JOIN m ON m.conv_id = deep.conv_id AND m.turn = deep.turn + 1),
l AS (SELECT e.*, deep.depth::BIGINT AS depth,
      EXISTS (SELECT 1 FROM e c WHERE c.kind = 'call' AND c.call_id = e.call_id) AS called,
      EXISTS (SELECT 1 FROM e r WHERE r.kind = 'result' AND r.call_id = e.call_id) AS answered
      FROM e JOIN deep USING (conv_id, turn))
SELECT conv_id, turn, kind, call_id,
       CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'result' AND NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
       depth, (row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) - 1)::BIGINT AS position,
       CASE WHEN kind = 'call' THEN length(text) BETWEEN 20 AND 100000 AND turn >= 0 END AS valid,
       CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply","type":"call"}'
            WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"tool_call_id":"' || call_id || '","type":"result"}'
            ELSE '{"content":' || to_json(text)::VARCHAR || ',"type":"message"}' END AS json
FROM l
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
      row_number() OVER (ORDER BY source ASC NULLS LAST) AS n, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
f AS (SELECT *, cap / w AS fill FROM n),
g AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY fill, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, budget, least(cap, (SELECT max(level) FROM g WHERE level <= fill) * w) AS target FROM g),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM d WHERE size > 0),
x AS (SELECT q.doc_id, q.source, q.size, q.turn, p.pass, (p.pass * source_size + served)::DOUBLE / target AS finish, budget
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(pass) WHERE target > 0),
y AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS FIRST, pass, turn, doc_id ROWS UNBOUNDED PRECEDING) AS ends FROM x),
z AS (SELECT doc_id, sum(size) AS taken FROM y WHERE ends <= budget GROUP BY doc_id)
SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(z.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN z USING (doc_id)
"""

OP7 = r"""
WITH each AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
worded AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM each),
wide AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM worded WHERE has GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'n')) >= (SELECT greatest(3, least(8, ceil(0.4 * count(DISTINCT coalesce('s' || source, 'n'))))) FROM documents)),
marked AS (SELECT w.*, has AND first IS NOT NULL AND {'d': doc_id, 'p': pos} <> first AS gone FROM worded w LEFT JOIN wide USING (line)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE has) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""

OP10 = r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT p.page_id, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
        FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id),
j AS (SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN fit f USING (page_id)),
seeds AS (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS t, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS d FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst),
steps AS (SELECT src AS a, dst AS b, 0.85 * w / sum(w) OVER (PARTITION BY src) AS t, 0.0 AS d FROM edges
          UNION ALL SELECT dst, src, 0.0, 0.85 * w / sum(w) OVER (PARTITION BY dst) FROM edges),
rounds(k, host, t, d) AS (
    SELECT 0, host, t::DOUBLE, d::DOUBLE FROM seeds
    UNION ALL
    SELECT k + 1, host, sum(t), sum(d) FROM (
        SELECT (SELECT max(k) FROM rounds) AS k, host, t, d FROM seeds
        UNION ALL SELECT r.k, s.b, r.t * s.t, r.d * s.d FROM rounds r JOIN steps s ON s.a = r.host) WHERE k < 30 GROUP BY k, host),
bad AS (SELECT host FROM rounds WHERE k = 30 AND d - t > 0.5)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""

OP11 = """
WITH p AS (SELECT client_id AS c, floor(epoch_us(ts) / 1e6)::BIGINT AS t, arg_max(floor(100 * value + 0.5)::BIGINT, click_id) AS v FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY c ORDER BY t)),
s AS (SELECT c, t, v, CASE WHEN t2 - t <= 900 THEN t2 ELSE t END AS e, CASE WHEN t2 - t <= 900 THEN v2 - v ELSE 0 END AS rise FROM n),
-- The first second of each local day from before the data to after it.
days AS (SELECT epoch(timezone('Europe/Berlin', d))::BIGINT AS a, epoch(timezone('Europe/Berlin', d + INTERVAL 1 DAY))::BIGINT AS b
         FROM (SELECT unnest(generate_series((SELECT to_timestamp(min(t))::DATE - 2 FROM p)::TIMESTAMP, (SELECT to_timestamp(max(t))::DATE + 2 FROM p)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
x AS (SELECT c, a, t, v, rise, greatest(e - t, 1) AS d, t >= a AND t < b AS own, greatest(t, a) - t AS u0, greatest(greatest(t, a), least(e, b)) - t AS u1
      FROM s JOIN days ON (t < b AND e > a) OR (t >= a AND t < b)),
y AS (SELECT *, 2 * v::HUGEINT * u0 + (rise::HUGEINT * u0 * u0 - ((rise::HUGEINT * u0 * u0) % d + d) % d) // d AS a0,
      2 * v::HUGEINT * u1 + (rise::HUGEINT * u1 * u1 - ((rise::HUGEINT * u1 * u1) % d + d) % d) // d AS a1 FROM x),
z AS (SELECT c, a, count(*) FILTER (own)::BIGINT AS n_points, sum(u1 - u0)::BIGINT AS covered_seconds, sum(a1 - a0)::HUGEINT AS area2 FROM y GROUP BY c, a)
SELECT c AS client_id, a AS bucket_start, n_points, covered_seconds, area2::BIGINT AS area2,
       CASE WHEN covered_seconds > 0 THEN (area2 - (area2 % (2 * covered_seconds) + 2 * covered_seconds) % (2 * covered_seconds)) // (2 * covered_seconds) END::BIGINT AS avg_cents
FROM z
"""


def _tree(kind: str, text: str) -> str:
    """Common tables of the trees of d's texts: leaves, paragraphs, sections, roots."""
    return rf"""
{kind}_lines AS (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS pos FROM d),
{kind}_leaves AS (SELECT doc_id, pos, list_transform(regexp_extract_all(line, '(?s).{{0,30}}?[.!?。！？] |.{{1,32}}'), lambda x: sha256(x)) AS leaves FROM {kind}_lines),
{kind}_paragraphs AS (SELECT *, sha256('p' || array_to_string(leaves, '')) AS hash FROM {kind}_leaves),
{kind}_numbered AS (SELECT *, coalesce(sum((hash < '4' OR len(leaves) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM {kind}_paragraphs),
{kind}_sections AS (SELECT doc_id, section, min(pos) AS nth, sha256('s' || string_agg(hash, '' ORDER BY pos)) AS hash,
       string_agg(array_to_string(list_transform(leaves, lambda x: x[:12]), ''), '.' ORDER BY pos) AS short FROM {kind}_numbered GROUP BY doc_id, section),
{kind}_roots AS (SELECT doc_id, sha256('r' || string_agg(hash, '' ORDER BY nth)) AS root, list(hash ORDER BY nth) AS hashes, string_agg(hash[:12] || '=' || short, '/' ORDER BY nth) AS short FROM {kind}_sections GROUP BY doc_id),
{kind}_counts AS (SELECT doc_id, leaf, count(*) AS n FROM (SELECT doc_id, unnest(leaves)[:12] AS leaf FROM {kind}_leaves) GROUP BY ALL)"""


OP12 = rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
      substr(text, 1, length(text) - length(text) // 4) || substr(coalesce(lead(text) OVER w, first_value(text) OVER w), 1, length(text) // 4) AS edited FROM raw WINDOW w AS (ORDER BY doc_id)),
{_tree('own', 'text')},
{_tree('edited', 'edited')},
own_sizes AS (SELECT doc_id, sum(n) AS n FROM own_counts GROUP BY doc_id),
edited_sizes AS (SELECT doc_id, sum(n) AS n FROM edited_counts GROUP BY doc_id),
with_edited AS (SELECT x.doc_id, sum(least(x.n, y.n)) AS n FROM own_counts x JOIN edited_counts y USING (doc_id, leaf) GROUP BY ALL),
with_next AS (SELECT d.doc_id, sum(least(x.n, y.n)) AS n FROM d JOIN own_counts x ON x.doc_id = d.doc_id JOIN own_counts y ON y.doc_id = d.next_id AND y.leaf = x.leaf GROUP BY ALL),
differ AS (SELECT o.doc_id, list_position(list_transform(list_zip(o.hashes, e.hashes), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1 AS k FROM own_roots o JOIN edited_roots e USING (doc_id) WHERE o.root <> e.root),
own_of AS (SELECT k.doc_id, list(n.hash ORDER BY n.pos) FILTER (n.hash IS NOT NULL) AS l FROM differ k LEFT JOIN (SELECT doc_id, hash, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS nth FROM own_numbered) n ON n.doc_id = k.doc_id AND n.nth = k.k GROUP BY ALL),
edited_of AS (SELECT k.doc_id, list(n.hash ORDER BY n.pos) FILTER (n.hash IS NOT NULL) AS l FROM differ k LEFT JOIN (SELECT doc_id, hash, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS nth FROM edited_numbered) n ON n.doc_id = k.doc_id AND n.nth = k.k GROUP BY ALL)
SELECT d.doc_id, d.n::BIGINT AS n_chars, sha256(d.edited) AS edited_sha256, o.root || '|' || o.short AS fingerprint, e.root || '|' || e.short AS edited_fingerprint,
       CASE WHEN o.root = e.root THEN 1.0 ELSE coalesce(2.0 * we.n / (os.n + es.n), 0.0) END::DOUBLE AS near_edited,
       CASE WHEN o.root = x.root THEN 1.0 ELSE coalesce(2.0 * wn.n / (os.n + ns.n), 0.0) END::DOUBLE AS near_next,
       k.k::BIGINT AS changed_section,
       (list_position(list_transform(list_zip(coalesce(oo.l, []), coalesce(eo.l, [])), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1)::BIGINT AS changed_paragraph
FROM d JOIN own_roots o USING (doc_id) JOIN edited_roots e USING (doc_id) JOIN own_roots x ON x.doc_id = d.next_id
LEFT JOIN own_sizes os ON os.doc_id = d.doc_id LEFT JOIN edited_sizes es ON es.doc_id = d.doc_id LEFT JOIN own_sizes ns ON ns.doc_id = d.next_id
LEFT JOIN with_edited we ON we.doc_id = d.doc_id LEFT JOIN with_next wn ON wn.doc_id = d.doc_id LEFT JOIN differ k ON k.doc_id = d.doc_id
LEFT JOIN own_of oo ON oo.doc_id = d.doc_id LEFT JOIN edited_of eo ON eo.doc_id = d.doc_id
"""

OP13 = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
w AS (SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
      UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
c AS (SELECT kind, doc_id, word, count(*) AS n FROM w GROUP BY ALL),
letters AS (SELECT word, unnest(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)) AS byte, unnest(range(strlen(word))) AS i FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
      FROM (SELECT word, list(byte ORDER BY i) AS l FROM letters GROUP BY word), crc),
f AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM c JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM f),
d AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN b USING (word) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM s WHERE n_features >= 20)
SELECT s.*, CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank FROM s LEFT JOIN r USING (doc_id)
"""

ORACLES = {"op2_warc": OP2, "op4_toolchat": OP4, "op6_mixing": OP6, "op7_lines": OP7, "op10_urls": OP10, "op11_tiles": OP11, "op12_merkle": OP12, "op13_importance": OP13}
