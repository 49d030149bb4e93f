"""Queries over the document model, find and replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import find
from ..sources import corpus
from . import common_sql as sql

NEEDLE = "tion of"
WORD = "the"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.explode_lines(corpus.table(spark, d, "documents"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their spans."""
    return corpus.line_spans(_lines(spark, d))


def scan_corpus(spark, d):
    return corpus.scan_corpus(spark, d)


def explode_lines(spark, d):
    return _lines(spark, d).where(F.col("line_text").rlike(r"\S")).select("doc_id", "page_no", "line_no", "line_text")


def explode_spans(spark, d):
    return corpus.explode_spans(_lines(spark, d))


def word_stream(spark, d):
    return corpus.word_stream(corpus.table(spark, d, "documents"))


def text_layer_status(spark, d):
    return corpus.text_layer_status(corpus.page_texts(corpus.table(spark, d, "documents")))


def assemble_text(spark, d):
    return corpus.assemble_text(corpus.page_texts(corpus.table(spark, d, "documents")), headings=True)


def find_occurrences(spark, d):
    return find.find_occurrences(_lines(spark, d), NEEDLE).drop("line_text")


def find_occurrences_whole_word(spark, d):
    return find.find_occurrences(_lines(spark, d), WORD, whole_word=True).select("doc_id", "page_no", "line_no", "start", "stop")


def find_hits(spark, d):
    return find.find_hits(_spans(spark, d), NEEDLE)


def reading_order(spark, d):
    return find.reading_order(find.find_hits(_spans(spark, d), "ing")).select("doc_id", "id", "page_no", "line_no", "start")


def find_capped(spark, d):
    return find.find_capped(find.find_hits(_spans(spark, d), WORD), 20).select("doc_id", "page_no", "line_no", "start", "truncated_page")


def find_summary(spark, d):
    docs = corpus.table(spark, d, "documents")
    scanned = docs.select("doc_id", F.ceil(F.size(F.split("text", "\n", -1)) / corpus.LINES_PER_PAGE).cast("int").alias("pages_scanned"), F.col("text").rlike(r"\S").alias("has_text"))
    return find.find_summary(find.find_hits(_spans(spark, d), "in, "), scanned)


def replace_all(spark, d):
    return find.replace_all(_spans(spark, d), "an", "[AN]")


def replace_scanned(spark, d):
    """Where the scan of a document stops at 50 hits."""
    lines = find.scanned_lines(corpus.table(spark, d, "documents"), "an", 50)
    return find.replace_all(corpus.line_spans(lines), "an", "[AN]")


def redact_matches(spark, d):
    return find.redact_matches(_lines(spark, d), NEEDLE, mask="#")


def folded_search(spark, d):
    return find.folded_search(corpus.table(spark, d, "documents"), "Etre")


def find_audit(spark, d):
    return find.find_audit(_lines(spark, d), "ing the")


_CAP = 300_000
QUERIES = {
    "scan_corpus": (
        scan_corpus,
        f"WITH {sql.LINES} SELECT doc_id, page_no, count(*) AS n_lines, sum(length(line_text)) AS n_chars, page_no + 1 AS page_label FROM lines GROUP BY doc_id, page_no",
    ),
    "explode_lines": (explode_lines, f"WITH {sql.LINES} SELECT doc_id, page_no, line_no, line_text FROM lines WHERE regexp_matches(line_text, '[^[:space:]]')"),
    "explode_spans": (explode_spans, f"WITH {sql.SPANS} SELECT * FROM spans"),
    "word_stream": (
        word_stream,
        f"""WITH {sql.TOKENS}, per_page AS (SELECT doc_id, page_no, count(*) AS n FROM tokens GROUP BY ALL),
        read AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {_CAP} AND page_no < 1000 AS ok FROM per_page),
        flagged AS (SELECT *, bool_or(NOT ok) OVER (PARTITION BY doc_id) AS truncated FROM read)
        SELECT t.doc_id, t.pos, t.word, t.page_no, f.truncated FROM tokens t JOIN flagged f USING (doc_id, page_no) WHERE ok""",
    ),
    "text_layer_status": (
        text_layer_status,
        f"""WITH {sql.PAGES}, sized AS (SELECT doc_id, length(regexp_replace(page_text, '^[[:space:]]+|[[:space:]]+$', '', 'g')) >= 20 AS has FROM page_texts)
        SELECT doc_id, count(*) FILTER (has) AS skip_pages, count(*) FILTER (NOT has) AS ocr_pages, bool_or(has) AS has_text FROM sized GROUP BY doc_id""",
    ),
    "assemble_text": (
        assemble_text,
        f"""WITH {sql.PAGES} SELECT doc_id, string_agg('=== page ' || (page_no + 1) || ' ===' || chr(10) || page_text, chr(10) || chr(10) ORDER BY page_no) AS full_text,
        CASE WHEN NOT bool_or(regexp_matches(page_text, '[^[:space:]]')) THEN 'no text' END AS error FROM page_texts GROUP BY doc_id""",
    ),
    "find_occurrences": (find_occurrences, f"WITH {sql.LINES}, {sql.occurrences('o', NEEDLE)} SELECT doc_id, page_no, line_no, hit_no, start, stop FROM o"),
    "find_occurrences_whole_word": (
        find_occurrences_whole_word,
        f"""WITH {sql.LINES}, {sql.occurrences('o', WORD)} SELECT doc_id, page_no, line_no, start, stop FROM o
        WHERE NOT regexp_matches(substr(line_text, CAST(start AS BIGINT), CASE WHEN start = 0 THEN 0 ELSE 1 END), '[\\p{{L}}\\p{{N}}_]')
          AND NOT regexp_matches(substr(line_text, CAST(stop + 1 AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]')""",
    ),
    "find_hits": (find_hits, f"WITH {sql.SPANS}, {sql.hits('h', NEEDLE)} SELECT * FROM h"),
    "reading_order": (
        reading_order,
        f"""WITH {sql.SPANS}, {sql.hits('h', 'ing')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, round(y0, 1), round(x0, 1), start, line_no, hit_no) - 1 AS id,
        page_no, line_no, start FROM h""",
    ),
    "find_capped": (
        find_capped,
        f"""WITH {sql.SPANS}, {sql.hits('h', WORD)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no, hit_no) AS k FROM h)
        SELECT doc_id, page_no, line_no, start, truncated_page FROM
        (SELECT *, coalesce(max(CASE WHEN k = 21 THEN page_no + 1 END) OVER (PARTITION BY doc_id), 0) AS truncated_page FROM ranked) WHERE k <= 20""",
    ),
    "find_summary": (
        find_summary,
        f"""WITH {sql.SPANS}, {sql.hits('h', 'in, ')}, n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (NOT replaceable) AS crossing,
        count(*) FILTER (replaceable) AS replaceable, count(DISTINCT page_no) AS pages FROM h GROUP BY doc_id),
        p AS (SELECT doc_id, count(DISTINCT page_no) AS pages_scanned, bool_or(regexp_matches(line_text, '[^[:space:]]')) AS has_text FROM lines GROUP BY doc_id)
        SELECT doc_id, pages_scanned, has_text, coalesce(total, 0) AS total, coalesce(crossing, 0) AS crossing, coalesce(replaceable, 0) AS replaceable, coalesce(pages, 0) AS pages FROM p LEFT JOIN n USING (doc_id)""",
    ),
    "replace_all": (
        replace_all,
        f"""WITH {sql.SPANS}, {sql.hits('h', 'an')}, per_line AS (SELECT doc_id, line_no, count(*) FILTER (replaceable) AS edited, count(*) FILTER (NOT replaceable) AS locked FROM h GROUP BY ALL)
        SELECT doc_id, line_no, string_agg(regexp_replace(span_text, 'an', '[AN]', 'gi'), '' ORDER BY span_no) AS new_text, any_value(edited) AS edited, any_value(locked) AS locked
        FROM spans JOIN per_line USING (doc_id, line_no) GROUP BY doc_id, line_no""",
    ),
    "replace_scanned": (
        replace_scanned,
        f"""WITH {sql.SPANS}, {sql.hits('h', 'an')}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, hit_no) AS k FROM h),
        t AS (SELECT doc_id, coalesce(max(CASE WHEN k = 51 THEN page_no + 1 END), 0) AS truncated_page FROM k GROUP BY doc_id),
        c AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id, line_no ORDER BY hit_no), 0) AS a, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY hit_no DESC) AS r FROM k WHERE k <= 50),
        l AS (SELECT doc_id, line_no, line_text FROM lines)
        SELECT doc_id, line_no, string_agg(substr(line_text, CAST(a + 1 AS BIGINT), CAST(start - a AS BIGINT)) || CASE WHEN replaceable THEN '[AN]' ELSE substr(line_text, CAST(start + 1 AS BIGINT), 2) END, '' ORDER BY hit_no)
          || any_value(substr(line_text, CAST(stop + 1 AS BIGINT))) FILTER (r = 1) AS new_text, count(*) FILTER (replaceable) AS edited, count(*) FILTER (NOT replaceable) AS locked, any_value(truncated_page) AS truncated_page
        FROM c JOIN l USING (doc_id, line_no) JOIN t USING (doc_id) GROUP BY doc_id, line_no""",
    ),
    "redact_matches": (
        redact_matches,
        f"WITH {sql.LINES} SELECT doc_id, line_no, regexp_replace(line_text, '{NEEDLE}', '{'#' * len(NEEDLE)}', 'gi') AS new_text FROM lines WHERE contains(lower(line_text), '{NEEDLE}')",
    ),
    "folded_search": (
        folded_search,
        """WITH f AS (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)
        SELECT doc_id, len(string_split(t, 'etre')) - 1 AS n_hits, instr(t, 'etre') - 1 AS first_at, (instr(t, 'etre') - 1) / length(t) AS first_fraction FROM f WHERE contains(t, 'etre')""",
    ),
    "find_audit": (
        find_audit,
        f"""WITH {sql.SPANS}, {sql.hits('h', 'ing the')},
        raw AS (SELECT doc_id, page_no, sum(len(string_split(lower(line_text), 'ing the')) - 1) AS raw,
                len(string_split(regexp_replace(lower(string_agg(line_text, '' ORDER BY line_no)), '[[:space:]]+', '', 'g'), 'ingthe')) - 1 AS no_space FROM lines GROUP BY ALL),
        n AS (SELECT doc_id, page_no, count(*) FILTER (replaceable) AS in_span, count(*) FILTER (NOT replaceable) AS crossing FROM h GROUP BY ALL)
        SELECT doc_id, page_no, raw, no_space, coalesce(in_span, 0) AS in_span, coalesce(crossing, 0) AS crossing,
        raw > coalesce(in_span, 0) + coalesce(crossing, 0) OR no_space > coalesce(in_span, 0) + coalesce(crossing, 0) AS flagged
        FROM raw LEFT JOIN n USING (doc_id, page_no)""",
    ),
}
