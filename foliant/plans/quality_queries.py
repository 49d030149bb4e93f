"""Queries on encodings, terms, charsets and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources import corpus
from . import common_sql as sql

FROM, TO = "éèêàçùôîâûäöüßáíóúñ", "ÐÌªµçïôî©ûÐåüßáíóúñ"


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Spans with encoding damage put in by rule: legacy bytes, Cyrillic letters and marks."""
    docs = corpus.table(spark, d, "documents")
    spans = corpus.explode_spans(corpus.explode_lines(docs)).join(docs.select("doc_id", "source"), "doc_id")
    k = F.col("doc_id") % 7
    text = F.when(k == 0, F.translate("span_text", FROM, TO)).when(k == 1, F.translate("span_text", "ae", "ае")).otherwise(F.col("span_text"))
    return spans.select("doc_id", "line_no", "span_no", "source", text.alias("span_text"), F.when(k == 0, F.when(F.col("doc_id") % 2 == 0, "ABCDEF+.VnTime").otherwise(".VnTime")).when(k == 2, "VNI-Times").when(k == 3, "VNTIME+Arial").otherwise("Arial").alias("font"))


def encoding_triage(spark, d):
    return q.encoding_triage(_damaged(spark, d))


def legacy_repair(spark, d):
    return q.legacy_repair(_damaged(spark, d)).groupBy("source", "accepted").agg(F.count("*").alias("n"), F.sum(F.length("repaired")).alias("n_chars"), F.min("repaired").alias("least"))


def error_ladder(spark, d):
    told = F.element_at(F.array(*map(F.lit, ("API key not valid", "quota used up", "model not found", "blocked: SAFETY", "body too large", "Unexpected token <", "fetch failed", "odd"))), (F.col("event_id") % 8 + 1).cast("int"))
    status = F.when(F.col("value") > 90, 429).when(F.col("value") > 80, 404).when(F.col("value") > 70, 413).otherwise(500)
    rows = corpus.table(spark, d, "events").select("event_type", status.alias("status"), told.alias("message"))
    return q.error_ladder(rows).groupBy("event_type", "code", "retryable").agg(F.count("*").alias("n"))


def term_inventory(spark, d):
    return q.term_inventory(corpus.table(spark, d, "documents"))


def mask_corpus(spark, d):
    masked = q.mask_corpus(corpus.table(spark, d, "documents"))
    return masked.select("doc_id", "masked", F.size("terms").alias("n_terms"))


def unmask_corpus(spark, d):
    """Masking and unmasking give every text back."""
    docs = corpus.table(spark, d, "documents")
    back = q.unmask_corpus(q.mask_corpus(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", F.md5("text").alias("m")).join(back, "doc_id").select("doc_id", (F.col("m") == F.md5("back")).alias("same"))


def phrasebook_apply(spark, d):
    lines = corpus.explode_lines(corpus.table(spark, d, "documents"))
    blocks = lines.where(F.col("line_text").rlike(r"\S")).select("doc_id", "page_no", F.col("line_no").alias("block_no"), F.col("line_text").alias("text"))
    # Entries stand for all lines that differ in their terms alone.
    book = blocks.where("doc_id % 3 = 0").groupBy("text").agg(F.count("*").alias("n")).select(F.col("text").alias("source"), F.concat(F.lit("T:"), "text").alias("target"))
    done = q.phrasebook_apply(blocks, book)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "translated"))), lambda x: x["translated"]), "\n")
    return q.phrasebook_pages(done, F.md5(text).alias("page_md5"))


def charset_coverage(spark, d):
    chars = spark.range(33, 127).select(F.chr(F.col("id")).alias("ch"))
    return q.charset_coverage(corpus.table(spark, d, "documents"), chars)


def catalog_resolve(spark, d):
    part = corpus.table(spark, d, "part")
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("ABCDEF+"), F.initcap("p_name"))).when(k == 1, F.concat(F.regexp_replace("p_name", " ", ""), F.lit("BoldItalic"))).when(k == 2, F.concat(F.col("p_name"), F.lit("-BoldMT"))).when(k == 3, F.concat(F.upper("p_name"), F.lit(",Italic"))).otherwise(F.concat(F.lit("no "), F.col("p_name")))
    return q.catalog_resolve(part.select(name.alias("name")), part.select(F.col("p_name").alias("family")).distinct())


def modal_with_support(spark, d):
    docs = corpus.table(spark, d, "documents")
    return q.modal_with_support(docs.select("source", F.when(~F.endswith("source", F.lit("3")), F.col("lang")).alias("lang")), "source", "lang", 0.6)


_DAMAGED = sql.SPANS + f""", damaged AS (SELECT d.source, CASE WHEN s.doc_id % 7 = 0 THEN translate(span_text, '{FROM}', '{TO}') WHEN s.doc_id % 7 = 1 THEN translate(span_text, 'ae', 'ае') ELSE span_text END AS span_text,
 s.doc_id % 7 AS k FROM spans s JOIN documents d USING (doc_id)),
judged AS (SELECT *, k IN (0, 2) AS legacy, CASE WHEN NOT regexp_matches(span_text, '[^[:space:]]') THEN NULL WHEN regexp_matches(span_text, '[\\x{{80}}-\\x{{9f}}\\x{{400}}-\\x{{4ff}}\\x{{370}}-\\x{{3ff}}\\x{{e000}}-\\x{{f8ff}}\\x{{fffd}}]') THEN 'mojibake'
 WHEN k IN (0, 2) AND regexp_matches(span_text, '[^\\x00-\\x7f]') THEN 'legacy_font' END AS reason FROM damaged)"""
_RULES = " ".join(f"WHEN {'status = ' + str(s) + ' OR ' if s else ''}{' OR '.join(f'contains(message, {t!r})' for t in ts)} THEN '{c}'" for c, _, s, ts in q.ERROR_RULES)
_RETRY = ", ".join(f"'{c}'" for c, r, *_ in q.ERROR_RULES if not r)
_TERM = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+|\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d[\d.,]*"
QUERIES = {
    "encoding_triage": (encoding_triage, f"WITH {_DAMAGED} SELECT source, reason, count(*) AS spans FROM judged WHERE reason IS NOT NULL GROUP BY ALL"),
    "legacy_repair": (
        legacy_repair,
        f"""WITH {_DAMAGED}, n AS (SELECT *, translate(span_text, '{q.TCVN3_FROM}', '{q.TCVN3_TO}') AS new FROM judged WHERE reason IS NOT NULL AND legacy),
        a AS (SELECT *, new <> span_text AND NOT regexp_matches(new, '[\\x{{80}}-\\x{{9f}}\\x{{400}}-\\x{{4ff}}\\x{{370}}-\\x{{3ff}}\\x{{e000}}-\\x{{f8ff}}\\x{{fffd}}]') AND regexp_matches(new, '[\\x{{c0}}-\\x{{1ef9}}]') AS accepted FROM n)
        SELECT source, accepted, count(*) AS n, sum(length(CASE WHEN accepted THEN new ELSE span_text END)) AS n_chars, min(CASE WHEN accepted THEN new ELSE span_text END) AS least FROM a GROUP BY ALL""",
    ),
    "error_ladder": (
        error_ladder,
        f"""WITH r AS (SELECT event_type, CASE WHEN value > 90 THEN 429 WHEN value > 80 THEN 404 WHEN value > 70 THEN 413 ELSE 500 END AS status,
          ['API key not valid', 'quota used up', 'model not found', 'blocked: SAFETY', 'body too large', 'Unexpected token <', 'fetch failed', 'odd'][event_id % 8 + 1] AS message FROM events),
        c AS (SELECT event_type, CASE {_RULES} ELSE '{q.OTHER_ERROR[0]}' END AS code FROM r)
        SELECT event_type, code, code NOT IN ({_RETRY}) AS retryable, count(*) AS n FROM c GROUP BY ALL""",
    ),
    "term_inventory": (
        term_inventory,
        f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM documents)
        SELECT CASE WHEN contains(term, '@') THEN 'email' WHEN regexp_full_match(term, '\\d{{1,4}}[/.-]\\d{{1,2}}[/.-]\\d{{1,4}}') THEN 'date' ELSE 'number' END AS kind, count(*) AS n, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""",
    ),
    "mask_corpus": (
        mask_corpus,
        f"""WITH t AS (SELECT doc_id, string_split_regex(text, '{_TERM}') AS g, len(regexp_extract_all(text, '{_TERM}')) AS n_terms FROM documents)
        SELECT doc_id, g[1] || coalesce(array_to_string([CASE WHEN true THEN '{q.OPEN}' || (i - 2) || '{q.CLOSE}' || g[i] END FOR i IN range(2, len(g) + 1)], ''), '') AS masked, n_terms FROM t""",
    ),
    "unmask_corpus": (unmask_corpus, "SELECT doc_id, true AS same FROM documents"),
    "phrasebook_apply": (
        phrasebook_apply,
        f"""WITH {sql.LINES}, b AS (SELECT * FROM lines WHERE regexp_matches(line_text, '[^[:space:]]')),
        m AS (SELECT *, regexp_replace(line_text, '{_TERM}', '#', 'g') AS masked FROM b), book AS (SELECT DISTINCT masked, true AS hit FROM m WHERE doc_id % 3 = 0),
        j AS (SELECT m.*, coalesce(hit, false) AS hit FROM m LEFT JOIN book USING (masked))
        SELECT doc_id, page_no, count(*) FILTER (hit) AS translated, bool_or(hit) AS changed, NOT bool_or(hit) AS failed,
        md5(string_agg(CASE WHEN hit THEN 'T:' || line_text ELSE line_text END, chr(10) ORDER BY line_no)) AS page_md5 FROM j GROUP BY ALL""",
    ),
    "charset_coverage": (
        charset_coverage,
        """WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
        SELECT doc_id, count(*) AS n_missing, string_agg(ch, '' ORDER BY ch) AS missing FROM c WHERE regexp_matches(ch, '^[^[:space:]]$') AND (unicode(ch) < 33 OR unicode(ch) > 126) GROUP BY doc_id""",
    ),
    "catalog_resolve": (
        catalog_resolve,
        """WITH n AS (SELECT DISTINCT p_name, p_partkey % 5 AS k FROM part),
        f AS (SELECT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm FROM (SELECT DISTINCT p_name FROM part))
        SELECT CASE k WHEN 0 THEN 'ABCDEF+' || array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(n.p_name, ' ')], ' ') WHEN 1 THEN replace(n.p_name, ' ', '') || 'BoldItalic'
          WHEN 2 THEN n.p_name || '-BoldMT' WHEN 3 THEN upper(n.p_name) || ',Italic' ELSE 'no ' || n.p_name END AS name,
          CASE WHEN k < 4 THEN n.p_name END AS family, CASE k WHEN 1 THEN 1 WHEN 4 THEN NULL ELSE 0 END AS candidate FROM n""",
    ),
    "modal_with_support": (
        modal_with_support,
        """WITH v AS (SELECT source, CASE WHEN source NOT LIKE '%3' THEN lang END AS lang FROM documents), c AS (SELECT source, lang, count(lang) AS n FROM v GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang NULLS LAST) AS k, CASE WHEN sum(n) OVER (PARTITION BY source) > 0 THEN n / sum(n) OVER (PARTITION BY source) END AS share FROM c)
        SELECT source, CASE WHEN share >= 0.6 THEN lang END AS modal, share FROM r WHERE k = 1""",
    ),
}
