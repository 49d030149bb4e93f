"""DuckDB SQL of the operators that SQL can express."""

#: Pareto order sampling: water-filled targets, levels per source, and the cut in rank order.
MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
b AS (SELECT *, length(bin(size)) AS bits, CAST(720720 // (16 + length(bin(size))) AS BIGINT) AS worth FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS w, sum(source_size) OVER () AS everything, sum([5, 2, 1][k % 3 + 1]) OVER () AS weights FROM s),
l AS (SELECT *, (CAST(everything AS DOUBLE) * 150 / 100 - 2 * coalesce(sum(source_size) OVER f, 0)) / (weights - coalesce(sum(w) OVER f, 0)) AS level FROM w
  WINDOW f AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level * w > 2 * source_size THEN CAST(2 * source_size AS DOUBLE)
  ELSE least(max(CASE WHEN level * w <= 2 * source_size THEN level END) OVER () * w, CAST(2 * source_size AS DOUBLE)) END AS target FROM l),
g AS (SELECT source, bits, worth, CAST(sum(size) AS BIGINT) AS s FROM b GROUP BY ALL),
r AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY source ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(s * worth) OVER (PARTITION BY source ORDER BY bits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g),
v AS (SELECT r.source, source_size, target, worth, rest, CASE WHEN rest > 0 THEN (target - 2 * before) / CAST(rest AS DOUBLE) END AS level FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source),
m AS (SELECT source, source_size, target, coalesce(max(CASE WHEN level * worth <= 2 THEN level END), 2.0) AS level FROM v GROUP BY ALL),
n AS (SELECT b.*, source_size, target, least(2.0, level * worth) AS wanted, (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM b JOIN m ON m.source IS NOT DISTINCT FROM b.source),
p AS (SELECT *, floor(wanted) AS whole, wanted - floor(wanted) AS p FROM n),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS remain FROM p),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN q IS NOT NULL AND 2 * run - size <= 2 * remain THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c"""

_ASSIGN = """(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _spans(kind: int, pattern: str, value: str, least: int) -> str:
    """Matches of a pattern with their offsets: gaps and matches take turns."""
    name = ("assign", "access", "hex", "generic")[kind]
    return f"""
{name}_m AS (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM texts),
{name}_r AS (SELECT doc_id, source, i, m[i] AS m, sum(length(g[i])) OVER w + coalesce(sum(length(m[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{name} AS (SELECT doc_id, source, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, {kind} AS ord, '{name}' AS kind, {value} AS v FROM {name}_r WHERE length({value}) >= {least})"""


#: Base spans, generic runs outside them, and who owns each value.
SECRETS = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
{_spans(0, _ASSIGN + _VALUE, f"regexp_extract(m, '{_ASSIGN}({_VALUE})', 1)", 12)},{_spans(1, "AKIA[A-Z0-9]{14,}", "m", 18)},{_spans(2, "[0-9a-f]{16,}", "m", 16)},
{_spans(3, "[A-Za-z0-9+/_=-]{20,}", "m", 20)},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
more AS (SELECT * FROM generic x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.a < x.b AND x.a < y.b)),
owned AS (SELECT v, count(DISTINCT source) >= 3 OR (count(DISTINCT source) > 1 AND count(DISTINCT doc_id) >= 10) AS copied FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY v),
every AS (SELECT x.*, copied FROM (SELECT * FROM base UNION ALL SELECT * FROM more) x JOIN owned USING (v) WHERE ord < 3 OR NOT copied),
told AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base_told, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans,
  count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_told, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN told USING (doc_id)"""

#: Windows opened turn by turn over prefix sums, with what each repeats and counts; the digests come from the turns themselves.
CHAT = r"""
WITH RECURSIVE every AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM every),
s AS (SELECT *, i = 0 AND role = 'system' AS sys, length(regexp_replace(role, '[~<\[\n]', 'xx', 'g')) + length(regexp_replace(text, '[~<\[]', 'xx', 'g')) + 13 AS size FROM r),
a AS (SELECT *, coalesce(max(CASE WHEN sys THEN n END) OVER (PARTITION BY conv_id), 0) AS head, sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY i) AS stop FROM s),
t AS (SELECT *, stop - n AS start, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM a WHERE NOT sys),
walk AS (SELECT conv_id, i, k, CAST(0 AS BIGINT) AS origin, i AS first FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.i, t.k, CAST(CASE WHEN t.stop - w.origin > 1024 - t.head - least(256, w.origin) THEN t.start ELSE w.origin END AS BIGINT),
    CASE WHEN t.stop - w.origin > 1024 - t.head - least(256, w.origin) THEN t.i ELSE w.first END FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.k = w.k + 1),
v AS (SELECT t.conv_id, w.first, w.origin, max(t.stop) AS stop, max(t.head) AS head, CAST(sum(t.size) AS BIGINT) AS size FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i GROUP BY ALL),
h AS (SELECT *, greatest(0, least(256, 1024 - head - (stop - origin))) AS room FROM v),
p AS (SELECT h.conv_id, h.first, h.origin, h.stop, h.head, h.size, count(t.i) AS past, CAST(coalesce(sum(t.size), 0) AS BIGINT) AS past_size, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS past_tokens
  FROM h LEFT JOIN t ON t.conv_id = h.conv_id AND t.i < h.first AND t.start >= h.origin - h.room GROUP BY ALL),
c AS (SELECT conv_id, count(*) AS windows, sum(size + past_size) AS chars,
  string_agg((past + CASE WHEN head > 0 AND origin > 0 THEN 1 ELSE 0 END) || ':' || CAST(head + past_tokens + stop - origin AS BIGINT), ',' ORDER BY first) AS told FROM p GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, coalesce(sum(size) FILTER (sys), 0) AS head, coalesce(sum(n) FILTER (sys), 0) AS head_tokens FROM s GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, coalesce(chars, 0) + greatest(coalesce(windows, 0), 1) * head AS formatted_chars, coalesce(told, '0:' || CAST(head_tokens AS BIGINT)) AS windows
FROM d LEFT JOIN c USING (conv_id)"""

ORACLES = {"op3_mix_sources": MIX, "op4_secret_scan": SECRETS, "op8_chat_windows": CHAT}
