"""Pieces of SQL that the oracles share: the document model in DuckDB's dialect."""

LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line_text,
         CAST((i - 1) // 4 AS INTEGER) AS page_no, CAST((i - 1) % 4 AS INTEGER) AS line_in_page
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

SPANS = LINES + """, span_rows AS (
  SELECT doc_id, line_no, page_no, line_in_page, i - 1 AS span_no, p[i] AS span_text
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(line_text, '[^.,]+[.,]*|[.,]+') AS p FROM lines
              WHERE regexp_matches(line_text, '[^[:space:]]')))),
spans AS (
  SELECT doc_id, page_no, line_no, span_no, span_text, regexp_matches(span_text, '[^[:space:]]') AS host, off,
         off * 5.0 AS x0, line_in_page * 12.0 AS y0,
         off * 5.0 + greatest(1.0, length(span_text) * 5.0) AS x1, line_in_page * 12.0 + 12.0 AS y1,
         11.0 AS size, CASE WHEN upper(span_text) = span_text AND lower(span_text) <> span_text THEN 16 ELSE 0 END AS flags
  FROM (SELECT *, coalesce(sum(length(span_text)) OVER (PARTITION BY doc_id, line_no ORDER BY span_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM span_rows))"""

TOKENS = LINES + """, words AS (
  SELECT doc_id, page_no, line_no, i AS k, w[i] AS word
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT *, regexp_split_to_array(line_text, '[[:space:]]+') AS w FROM lines)) WHERE w[i] <> ''),
tokens AS (SELECT doc_id, page_no, word, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS pos FROM words)"""

PAGES = LINES + """, page_texts AS (
  SELECT doc_id, page_no, string_agg(line_text, chr(10) ORDER BY line_no) AS page_text FROM lines GROUP BY ALL)"""


def occurrences(name: str, needle: str) -> str:
    """CTEs that find a needle in lower case, without overlaps, in the lines of ``lines``."""
    n = len(needle)
    return f"""{name}_parts AS (
  SELECT doc_id, page_no, line_no, line_text, i - 1 AS hit_no, g[i] AS gap
  FROM (SELECT *, unnest(range(1, len(g))) AS i
        FROM (SELECT *, string_split(lower(line_text), '{needle}') AS g FROM lines WHERE contains(lower(line_text), '{needle}')))),
{name} AS (
  SELECT doc_id, page_no, line_no, line_text, hit_no,
         sum(length(gap)) OVER (PARTITION BY doc_id, line_no ORDER BY hit_no ROWS UNBOUNDED PRECEDING) + hit_no * {n} AS start,
         sum(length(gap)) OVER (PARTITION BY doc_id, line_no ORDER BY hit_no ROWS UNBOUNDED PRECEDING) + hit_no * {n} + {n} AS stop
  FROM {name}_parts)"""


def hits(name: str, needle: str) -> str:
    """CTEs for the hits of a needle, placed on ``spans``."""
    return occurrences(f"{name}_occ", needle) + f""", {name}_touched AS (
  SELECT o.doc_id, o.page_no, o.line_no, o.line_text, hit_no, start, stop, span_no, span_text, host, off, x0, y0, x1, y1
  FROM {name}_occ o JOIN spans s ON o.doc_id = s.doc_id AND o.line_no = s.line_no AND off < stop AND off + length(span_text) > start),
{name} AS (
  SELECT doc_id, page_no, line_no, hit_no, start, stop, span_no, replaceable,
         CASE WHEN replaceable THEN start - off ELSE 0 END AS span_start,
         CASE WHEN replaceable THEN stop - off ELSE length(line_text) END AS span_stop,
         CASE WHEN replaceable THEN span_text ELSE line_text END AS span_text, x0, y0, x1, y1
  FROM (SELECT doc_id, page_no, line_no, hit_no, start, stop, line_text, min(span_no) AS span_no,
               arg_min(span_text, span_no) AS span_text, arg_min(off, span_no) AS off,
               count(*) = 1 AND count(*) FILTER (host) = 1 AS replaceable,
               min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
        FROM {name}_touched GROUP BY doc_id, page_no, line_no, hit_no, start, stop, line_text))"""
