"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH m AS (SELECT conv_id AS conv, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS t FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, speaker, t) - 1 AS nth FROM m),
p AS (SELECT DISTINCT conv, speaker AS perspective FROM m WHERE speaker <> 'system'),
e AS (
  SELECT n.conv AS conv_id, perspective, nth // 256 AS part, nth, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(speaker, '\s+', '_', 'g') END || chr(10) AS head,
    replace(t, '<|im_', '<' || chr(8203) || '|im_') || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv IS NOT DISTINCT FROM p.conv),
o AS (SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e)
SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(head || body, chr(10) ORDER BY nth) || chr(10) AS rendered,
  '[' || coalesce(string_agg(CASE WHEN own THEN '{"start":' || CAST(pos AS BIGINT) || ',"end":' || CAST(pos + length(body) AS BIGINT) || '}' END, ',' ORDER BY nth), '') || ']' AS masks,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, perspective, part
"""

NEARDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
c AS (SELECT v, min(w) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.v LEFT JOIN n ON e.vec_id = n.a
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END)) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
c AS (SELECT v, min(w) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
"""


def _seeded(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts]])
    return f"CAST('0x' || left(md5({text}), 13) AS BIGINT)"


def _sainte_lague(name: str, source: str, party: str, vote: str, seats: str, group: str) -> str:
    """CTEs that add ``quota`` to a table by the highest quotients."""
    return f"""
{name}_a AS (SELECT *, sum({vote}) OVER ({group}) AS tv, count(*) OVER ({group}) AS tp FROM {source}),
{name}_b AS (SELECT *, greatest(CASE WHEN tv > 0 THEN CAST(floor({vote} * CAST(greatest({seats} - tp, 0) AS DOUBLE) / tv + 0.5) AS BIGINT) ELSE 0 END - 1, 0) AS sure,
  CASE WHEN {vote} > 0 THEN CAST(floor({vote} * CAST({seats} + tp AS DOUBLE) / tv + 0.5) AS BIGINT) + 1 ELSE 0 END AS most FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(sure) OVER ({group}) AS rest FROM {name}_b),
{name}_d AS (SELECT *, unnest(CASE WHEN most > sure THEN range(sure + 1, most + 1) ELSE [NULL] END) AS k FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({group} ORDER BY {vote} / CAST(k * 2 - 1 AS DOUBLE) DESC NULLS LAST, {', '.join(p + ' NULLS LAST' for p in party.split(', '))}, k) AS n FROM {name}_d),
{name} AS (SELECT {party}, min(sure) + count(*) FILTER (WHERE k IS NOT NULL AND n <= rest) AS quota FROM {name}_e GROUP BY {party})"""


MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce('s' || source, '-') AS key FROM documents),
s AS (SELECT key, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, level * w < cap AS free FROM f),
h AS (SELECT first(level ORDER BY cap / w, source_size) AS reached FROM g WHERE free),
t AS (SELECT key, source_size, CASE WHEN free THEN reached * w ELSE cap END AS target FROM g LEFT JOIN h ON true),
u AS (SELECT *, CAST(round(sum(target) OVER () / 8) AS BIGINT) AS blocks FROM t),
{_sainte_lague("qs", "u", "key", "target", "blocks", "")},
v AS (SELECT u.key, source_size, target, quota AS source_quota, least(greatest(CAST(ceil(source_size / 16384.0) AS BIGINT), 1), 65536) AS n_shards FROM u JOIN qs USING (key)),
x AS (SELECT d.*, source_size, target, source_quota, {_seeded('7', 'doc_id')} AS o, n_shards FROM d JOIN v USING (key)),
y AS (SELECT *, o % n_shards AS shard FROM x),
ps AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS shard_size, min(source_quota) AS source_quota FROM y GROUP BY key, shard HAVING sum(size) > 0),
{_sainte_lague("qp", "ps", "key, shard", "shard_size", "source_quota", "PARTITION BY key")},
z AS (SELECT y.*, sum(size) OVER (PARTITION BY y.key, y.shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS e, ps.shard_size, coalesce(quota, 0) AS quota FROM y LEFT JOIN ps ON ps.key = y.key AND ps.shard = y.shard LEFT JOIN qp ON qp.key = y.key AND qp.shard = y.shard),
b AS (SELECT *, CAST(ceil(shard_size / 8.0) AS BIGINT) AS m, {_seeded('8', 'key', 'shard')} AS shift FROM z),
c AS (SELECT *, least(quota, m * 2) AS q, [2654435761, 2246822519, 3266489917][CAST(shift % 3 + 1 AS INT)] AS prime FROM b),
a AS (SELECT *, CAST(e - size AS BIGINT) AS st, CAST(e AS BIGINT) AS en, q // m AS full_passes, q % m AS more FROM c)
SELECT doc_id, size, source_size, target, source,
  CASE WHEN size > 0 AND q > 0 THEN CAST(full_passes * size + CASE WHEN more > 0 THEN coalesce(list_sum(list_transform(range(st // 8, (en - 1) // 8 + 1), lambda j: CASE WHEN (j * prime + shift) % m < more THEN least(en, (j + 1) * 8) - greatest(st, j * 8) ELSE 0 END)), 0) ELSE 0 END AS BIGINT) ELSE 0 END AS taken,
  CASE WHEN size > 0 AND q > 0 THEN CAST(full_passes + CASE WHEN ((st + size // 2) // 8 * prime + shift) % m < more THEN 1 ELSE 0 END AS INT) ELSE 0 END AS copies
FROM a
"""

ORACLES = {"op3_embedding_neardup": NEARDUP, "op6_jaccard_join": JACCARD, "op9_source_mix": MIX, "op10_chat_rotation": CHAT}
