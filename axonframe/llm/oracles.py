"""DuckDB SQL that states the results of the corpus queries where SQL can express them."""

from __future__ import annotations

from axonframe.llm import chat, mixing, quality, urls

_W = r"[^\x20\x09-\x0D]+"
_S = r"[\x20\x09-\x0D]+"
_ASCII = f"translate({{}}, '{urls.UPPER}', '{urls.LOWER}')"


def _ranks() -> str:
    """Rounds of propagation as a chain of views."""
    d, j = repr(urls.DAMPING), repr(1 - urls.DAMPING)
    rounds = [
        f"r0 AS MATERIALIZED (SELECT node, t0 AS t, d0 AS d FROM seeded), base AS MATERIALIZED (SELECT node, floor(t0 * {j}::DOUBLE)::BIGINT AS t, floor(d0 * {j}::DOUBLE)::BIGINT AS d FROM seeded)"
    ]
    for i in range(urls.ROUNDS):
        rounds.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, sum(t)::BIGINT AS t, sum(d)::BIGINT AS d FROM (SELECT * FROM base UNION ALL "
            f"SELECT b, floor(r.t::DOUBLE * {d}::DOUBLE * s.t)::BIGINT, floor(r.d::DOUBLE * {d}::DOUBLE * s.d)::BIGINT FROM share s JOIN r{i} r ON r.node = s.a) GROUP BY node)"
        )
    return ",\n".join(rounds)


OP1 = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (SELECT page_id, html, {_ASCII.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in urls.RULES)}),
parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS domain, substr(rule, strpos(rule, '/')) AS prefix FROM rules),
ruled AS (
  SELECT r.*, x.rule, x.verdict FROM (SELECT *, row_number() OVER () AS rn FROM rows) r LEFT JOIN (
    SELECT q.rn, arg_max(p.rule, (length(p.rule), p.rule)) AS rule, arg_max(p.verdict, (length(p.rule), p.rule)) AS verdict
    FROM (SELECT *, row_number() OVER () AS rn FROM rows) q JOIN parts p ON (q.host = p.domain OR ends_with(q.host, '.' || p.domain)) AND starts_with(q.path, p.prefix) GROUP BY q.rn
  ) x USING (rn)),
link AS (
  SELECT host AS src, {_ASCII.format("regexp_extract(substr(l, strpos(l, '://') + 3), '^([^/?#]*)', 1)")} AS dst FROM (
    SELECT host, CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END AS l FROM (SELECT host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1))) AS l FROM rows)) WHERE strpos(l, '://') > 0),
links AS (SELECT src, dst, count(*) AS w FROM link WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
known AS (SELECT DISTINCT host FROM (SELECT host FROM rows WHERE host <> '' UNION ALL SELECT dst FROM links)),
lab AS (SELECT string_split(host, '.') AS l FROM known WHERE NOT regexp_matches(host, '^[0-9.]+(:|$)|^\[')),
up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l)::BIGINT)) AS i FROM lab) WHERE len(l) - i >= {urls.MIN_LABELS}),
edges AS (SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY 1, 2),
share AS MATERIALIZED (
  SELECT a, b, sum(t) AS t, sum(d) AS d FROM (
    SELECT src AS a, dst AS b, w / sum(w) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM edges
    UNION ALL SELECT dst, src, 0.0::DOUBLE, w / sum(w) OVER (PARTITION BY dst) FROM edges) GROUP BY 1, 2),
counts AS (SELECT host AS node, coalesce(sum((verdict = 'allow')::BIGINT), 0) AS t, coalesce(sum((verdict = 'block')::BIGINT), 0) AS d FROM ruled GROUP BY host),
seeded AS MATERIALIZED (
  SELECT * FROM (SELECT node, floor({float(urls.MASS)}::DOUBLE * t / greatest(sum(t) OVER (), 1)::DOUBLE)::BIGINT AS t0, floor({float(urls.MASS)}::DOUBLE * d / greatest(sum(d) OVER (), 1)::DOUBLE)::BIGINT AS d0 FROM counts)
  WHERE t0 > 0 OR d0 > 0),
{_ranks()}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(k.d, 0) >= 1 AND coalesce(k.d, 0) > coalesce(k.t, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(k.t, 0) AS trust, coalesce(k.d, 0) AS distrust
FROM ruled LEFT JOIN r{urls.ROUNDS} k ON k.node = ruled.host
"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

_NUM, _DEN = mixing.RATIO


OP3 = rf"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size, md5('7' || coalesce('|' || doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT greatest(1, ceil(count(*) / {mixing.ROWS_PER_SHARD}))::BIGINT AS k FROM r),
d AS (SELECT r.*, ('0x' || substr(h, 1, 8))::BIGINT % k.k AS shard FROM r, k),
parts AS (SELECT source, shard, sum(size)::BIGINT AS tokens, ceil(sum(size) / {mixing.BLOCK_WORDS})::BIGINT AS blocks FROM d GROUP BY 1, 2),
src AS (SELECT source, sum(tokens)::BIGINT AS source_size, ({mixing.MOST} * sum(blocks))::BIGINT AS cap_blocks FROM parts GROUP BY 1),
listed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r, source_size * {mixing.MOST} AS cap, list_value({", ".join(map(str, mixing.WEIGHTS))})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}) + 1] AS weight FROM src),
leveled AS (SELECT *, cap / weight AS key, (sum(source_size) OVER () * {_NUM} - coalesce(sum(cap) OVER before, 0) * {_DEN})::DOUBLE / ((sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) * {_DEN})::DOUBLE AS level
  FROM listed WINDOW before AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, (key, r)) AS level FROM leveled WHERE NOT level * weight > cap),
target AS (SELECT l.*, coalesce(least(cap::DOUBLE, f.level * weight), cap::DOUBLE) AS target, r AS pid FROM leveled l, final f),
party AS (SELECT *, least(floor((2 * {_NUM} * sum(source_size) OVER () + {mixing.BLOCK_WORDS * _DEN}) / {2 * mixing.BLOCK_WORDS * _DEN})::BIGINT, sum(cap_blocks) OVER ()) AS seats_all FROM target),
quotient AS (SELECT pid, seats_all, r, cap_blocks, target, unnest(range(0, cap_blocks)) AS k FROM party),
won AS (SELECT pid, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) AS rank FROM quotient) WHERE rank <= seats_all GROUP BY 1),
quotas AS (SELECT p.*, CASE WHEN target >= {mixing.MOST} * source_size THEN cap_blocks ELSE coalesce(w.quota, 0) END AS quota FROM party p LEFT JOIN won w USING (pid)),
dealt AS (SELECT p.*, q.quota AS of_source, q.source_size, q.target FROM parts p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source),
quotient2 AS (SELECT source, shard, tokens, of_source, unnest(range(0, {mixing.MOST} * blocks)) AS k FROM dealt),
won2 AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens / (2 * k + 1) DESC, shard, k) AS rank FROM quotient2) WHERE rank <= of_source GROUP BY 1, 2),
sh AS (SELECT d.*, coalesce(w.quota, 0) AS quota, greatest(blocks, 1) AS nb FROM dealt d LEFT JOIN won2 w ON d.source IS NOT DISTINCT FROM w.source AND d.shard = w.shard),
run AS (SELECT *, ('0x' || substr(md5('7|' || shard::VARCHAR || coalesce('|' || source, '')), 1, 8))::BIGINT % nb AS first, quota % nb AS extra, quota // nb AS rounds FROM sh),
seq AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM d)
SELECT s.doc_id, s.source, s.size, r.source_size, r.target, (r.rounds * s.size
  + greatest(0, least(s.stop, least(r.first + r.extra, r.nb) * {mixing.BLOCK_WORDS}) - greatest(s.stop - s.size, r.first * {mixing.BLOCK_WORDS}))
  + greatest(0, least(s.stop, greatest(r.first + r.extra - r.nb, 0) * {mixing.BLOCK_WORDS}) - (s.stop - s.size)))::BIGINT AS taken
FROM seq s JOIN run r ON s.source IS NOT DISTINCT FROM r.source AND s.shard = r.shard
"""

_ESC = f"length(regexp_replace({{}}, '{chat.GUARD}', '\\1\\\\\\2\\3', 'g'))"
OP4 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.BEGIN + chat.OPEN + chat.SHUT + chat.END)} + {_ESC.format("role")} + {_ESC.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<[a-z/][^>]*$', ''), '</?b>|<br>', '', 'g'), '\s*</?(?:p|h1)>\s*', chr(1), 'g') AS x FROM a),
c AS (SELECT page_id, url, list_transform(string_split(x, chr(1)), lambda v: trim(regexp_replace(replace(replace(regexp_replace(v, '&quot;', '"', 'g'), '&amp;', '&'), '&amp', '&'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS v FROM b)
SELECT page_id, url, array_to_string(list_filter(v, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(v, lambda x: x <> ''), chr(10))) AS n_chars FROM c
"""

OP6 = rf"""
WITH w AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
g AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
hit AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rn, count(DISTINCT i + j) AS n FROM hit, range(3) z(j) GROUP BY rn),
m AS (
  SELECT w.rn, doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '{_S}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS n_lower
  FROM w LEFT JOIN rep USING (rn)),
k AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM m),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))})::BIGINT AS fail_bits FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (fail_bits & {quality.mask_of(quality.CURRENT)}) = 0 AS kept, fail_bits FROM b
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest
"""

OP11 = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, positive_id, row_number() OVER best AS rank, s.b AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.a, positive_id ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER best <= 10
"""

OP13 = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER best = 1 AS kept, h AS text_sha256
FROM n WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""

ORACLE = {
    "op1_link_trust": OP1, "op2_superminhash": OP2, "op3_sainte_lague_mix": OP3, "op4_chat_round_trip": OP4, "op5_block_labeller": OP5,
    "op6_rule_ledger": OP6, "op9_warc_salvage": OP9, "op11_gnat_negatives": OP11, "op13_salted_exact": OP13,
}
