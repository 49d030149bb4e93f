"""Queries on extraction: rules, records, responses, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import shared_folder
from ..operators import extract as x
from ..sources import corpus, sinks
from . import common_sql as sql

RULES = (("license", "license", r"(?:under|of) the ([A-Z][A-Za-z]+) License"), ("license", "version", r"[Vv]ersion (\d+(?:\.\d+)?)"), ("contact", "email", r"([a-z0-9.]+@[a-z0-9.]+)"), ("contact", "first", r"^([^ \n]+)"))
KINDS = (("the", "english"), ("and", "english"), ("of", "english"), ("der", "german"), ("und", "german"), ("de", "romance"), ("la", "romance"), ("que", "romance"))
TEMPLATES = (("license", 0, "license"), ("license", 1, "version"), ("license", 2, "holder"), ("contact", 0, "email"), ("default", 0, "title"), ("default", 1, "date"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_by_rules(_docs(spark, d), RULES)


def extract_by_rules(spark, d):
    return _records(spark, d)


def classify_by_rules(spark, d):
    return x.classify_by_rules(_docs(spark, d), spark.createDataFrame(KINDS, "word string, kind string"))


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "template string, ord int, key string")


def resolve_fields(spark, d):
    k = F.col("c_custkey") % 5
    requests = corpus.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"), F.when(k == 0, "license").when(k == 1, "contact").when(k == 2, "nothing").alias("template"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("own"), F.col("c_mktsegment"))).alias("custom")
    )
    return x.resolve_fields(requests, _templates(spark))


def slug_fields(spark, d):
    labels = corpus.explode_lines(_docs(spark, d)).where(F.col("line_text").rlike(r"\S")).select(F.col("doc_id").alias("group_id"), F.col("line_no").alias("ord"), F.regexp_extract("line_text", r"^(\S+(?:\s+\S+)?)", 1).alias("label"))
    return x.slug_fields(labels)


def records_enriched(spark, d):
    records = corpus.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("_source_file"))
    return x.records_enriched(records, F.concat(F.lit("file-"), F.col("event_id").cast("string")), F.lit("20240101_000000"))


def field_fill_rate(spark, d):
    return x.field_fill_rate(_records(spark, d), _templates(spark))


def recon_select(spark, d):
    lines = corpus.explode_lines(_docs(spark, d))
    pages = lines.groupBy("doc_id", "page_no").agg(F.sum(F.length("line_text")).alias("n"))
    relevance = F.when(F.col("n") > 4000, "high").when(F.col("n") > 3000, "medium").otherwise("low")
    return x.recon_select(pages.select("doc_id", "page_no", (F.col("doc_id") % 9 == 0).alias("failed"), relevance.alias("relevance"), F.when(F.col("n") % 11 == 0, F.array(F.lit("party_info"))).otherwise(F.array(F.lit("other"))).alias("contains")), close=2)


def _answers(spark, d):
    k = F.col("event_id") % 4
    e = corpus.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("  "), F.col("props"))).when(k == 2, F.col("props")).otherwise(F.lit("no json")).alias("answer"))


def parse_responses(spark, d):
    return x.parse_responses(_answers(spark, d), "k string").select("id", F.col("result.k").cast("string").alias("k"), "failed")


def parse_lists(spark, d):
    """Answers of four forms: an array, an object around one, the same in a fence, and an object without a list."""
    k = F.col("event_id") % 4
    one = lambda i, t: F.concat(F.lit('{"i": '), i.cast("string"), F.lit(', "t": "'), t, F.lit('"}'))
    entries = F.concat(F.lit("["), one(F.lit(0), F.col("event_type")), F.lit(', {"t": "no index"}, '), one(F.lit(1), F.col("user_id").cast("string")), F.lit(', 7, {"i": 2}]'))
    wrapped = F.concat(F.lit('{"note": "x", "items": '), entries, F.lit(', "more": []}'))
    answer = F.when(k == 0, entries).when(k == 1, wrapped).when(k == 2, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).otherwise(F.lit('{"note": "nothing"}'))
    return x.parse_lists(corpus.table(spark, d, "events").select(F.col("event_id").alias("id"), answer.alias("answer")))


def payments_explode(spark, d):
    items = corpus.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("name"), F.col("l_discount").alias("share"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_extendedprice")).alias("amount")))).alias("payments"))
    results = corpus.table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "payments")
    return x.payments_explode(results)


def normalise_values(spark, d):
    o = corpus.table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    day = F.when(k == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    money = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    raw = F.when(k < 2, day).when(k == 2, money).otherwise(F.col("o_orderpriority"))
    return x.normalise_values(o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))).withColumn("number", F.col("number").cast("double"))


def content_fingerprint(spark, d):
    docs = _docs(spark, d)
    return x.content_fingerprint(docs, corpus.page_texts(docs))


def exact_duplicates(spark, d):
    return x.exact_duplicates(_docs(spark, d))


def _written(spark, d, fmt):
    folder = f"{shared_folder(spark)}/records-{fmt}-{spark.sparkContext.applicationId}"
    wide = _records(spark, d).groupBy("doc_id").pivot("key", ["email", "first", "license", "version"]).agg(F.first("value"))
    wide = wide.withColumn("_page", F.lit(1))
    sinks.write_records(wide, folder, fmt, {"doc_id": "Document", "email": "E-mail", "first": "First word", "license": "License", "version": "Version"})
    return folder


def write_records_csv(spark, d):
    return spark.read.option("header", True).csv(_written(spark, d, "csv"))


def write_records_json(spark, d):
    return spark.read.json(_written(spark, d, "json")).select("doc_id", "email", "first", "license", "version", "_page")


def write_records_markdown(spark, d):
    return spark.read.text(_written(spark, d, "markdown"), lineSep="\n\n").where("value <> ''")


_RULE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS template, '{k}' AS key, CASE WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1) END AS value FROM documents" for t, k, p in RULES)
_TPL = "tpl(template, ord, key) AS (VALUES " + ", ".join(map(str, TEMPLATES)) + ")"
_WIDE = f"wide AS (SELECT doc_id, max(value) FILTER (key = 'email') AS email, max(value) FILTER (key = 'first') AS first, max(value) FILTER (key = 'license') AS license, max(value) FILTER (key = 'version') AS version FROM ({_RULE_ROWS}) GROUP BY doc_id)"
QUERIES = {
    "extract_by_rules": (extract_by_rules, _RULE_ROWS),
    "classify_by_rules": (
        classify_by_rules,
        f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(substr(text, 1, 2000)), '[^\\p{{L}}]+')) AS word FROM documents),
        s AS (SELECT doc_id, kind, count(*) AS n FROM w JOIN (VALUES {', '.join(map(str, KINDS))}) k(word, kind) USING (word) GROUP BY ALL), b AS (SELECT doc_id, arg_max(kind, (n, kind)) AS kind, max(n) AS n FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(kind, 'unknown') AS kind, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence FROM documents LEFT JOIN b USING (doc_id)""",
    ),
    "resolve_fields": (
        resolve_fields,
        f"""WITH {_TPL}, r AS (SELECT c_custkey AS request_id, c_mktsegment, c_custkey % 7 = 0 AS own, CASE c_custkey % 5 WHEN 0 THEN 'license' WHEN 1 THEN 'contact' ELSE 'default' END AS template FROM customer)
        SELECT request_id, ord, key FROM r JOIN tpl USING (template) WHERE NOT own UNION ALL SELECT request_id, 0, 'own' FROM r WHERE own UNION ALL SELECT request_id, 1, c_mktsegment FROM r WHERE own""",
    ),
    "slug_fields": (
        slug_fields,
        f"""WITH {sql.LINES}, l AS (SELECT doc_id AS group_id, line_no AS ord, regexp_extract(line_text, '^([^[:space:]]+(?:[[:space:]]+[^[:space:]]+)?)', 1) AS label FROM lines WHERE regexp_matches(line_text, '[^[:space:]]')),
        s AS (SELECT *, regexp_replace(regexp_replace(strip_accents(lower(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM l), t AS (SELECT *, CASE WHEN s = '' THEN 'truong' ELSE s END AS t FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY group_id, t ORDER BY ord) AS k FROM t) SELECT group_id, ord, label, CASE WHEN k > 1 THEN t || '_' || k ELSE t END AS key FROM k""",
    ),
    "records_enriched": (records_enriched, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'file-' || event_id END AS _source_file, '20240101_000000' AS _timestamp FROM events"),
    "field_fill_rate": (
        field_fill_rate,
        f"""WITH {_TPL}, r AS ({_RULE_ROWS}), k AS (SELECT template, key FROM tpl UNION SELECT template, key FROM r)
        SELECT template, key, (SELECT count(DISTINCT doc_id) FROM r WHERE r.template = k.template AND r.key = k.key AND value IS NOT NULL) / nullif((SELECT count(DISTINCT doc_id) FROM r WHERE r.template = k.template), 0) AS fill_rate FROM k""",
    ),
    "recon_select": (
        recon_select,
        f"""WITH {sql.LINES}, p AS (SELECT doc_id, page_no, sum(length(line_text)) AS n FROM lines GROUP BY ALL), w AS (SELECT *, n > 3000 OR n % 11 = 0 AS w FROM p),
        m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c, bool_or(w) OVER (PARTITION BY doc_id) AS a, min(page_no) OVER (PARTITION BY doc_id) AS f FROM w) SELECT doc_id, page_no FROM m WHERE c <= 2 OR w OR doc_id % 9 = 0 OR (NOT a AND page_no = f)""",
    ),
    "parse_responses": (parse_responses, "SELECT event_id AS id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k, event_id % 4 = 3 AS failed FROM events"),
    "parse_lists": (
        parse_lists,
        """SELECT event_id AS id, 0 AS i, event_type AS t, false AS failed FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, 1, CAST(user_id AS VARCHAR), false FROM events WHERE event_id % 4 < 3
        UNION ALL SELECT event_id, 2, '', false FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE event_id % 4 = 3""",
    ),
    "payments_explode": (
        payments_explode,
        """WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END NULLS FIRST, l_discount, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END NULLS FIRST) - 1 AS ord FROM lineitem)
        SELECT o_orderkey AS id, ord, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS name, l_discount AS share, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice ELSE 0 END AS amount FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
    ),
    "normalise_values": (
        normalise_values,
        """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_orderdate AS d, o_totalprice AS t, o_orderpriority AS p FROM orders)
        SELECT id, CASE k WHEN 0 THEN day(d) || '/' || month(d) || '/' || year(d) WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN translate(format('{:,.2f}', t), ',.', '.,') ELSE p END AS raw,
        CASE WHEN k < 2 THEN strftime(d, '%d/%m/%Y') END AS date_text, CASE WHEN k = 2 THEN CAST(replace(format('{:,.2f}', t), ',', '') AS DOUBLE) END AS number FROM r""",
    ),
    "content_fingerprint": (
        content_fingerprint,
        f"""WITH {sql.PAGES}, n AS (SELECT doc_id, count(*) AS n FROM page_texts GROUP BY doc_id)
        SELECT doc_id, sha256(source || '|' || length(text) || '|' || n || '|' || substr(text, 1, 8192)) AS cache_key, sha256(text) AS content_hash FROM documents JOIN n USING (doc_id)""",
    ),
    "exact_duplicates": (exact_duplicates, "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "write_records_csv": (write_records_csv, f"""WITH {_WIDE} SELECT CAST(doc_id AS VARCHAR) AS "Document", email AS "E-mail", first AS "First word", license AS "License", version AS "Version", '1' AS "Page" FROM wide"""),
    "write_records_json": (write_records_json, f"WITH {_WIDE} SELECT *, 1 AS _page FROM wide"),
    "write_records_markdown": (
        write_records_markdown,
        f"""WITH {_WIDE} SELECT '**Document**: ' || doc_id || chr(10) || '**E-mail**: ' || coalesce(email, '{sinks.NO_VALUE}') || chr(10) || '**First word**: ' || coalesce(first, '{sinks.NO_VALUE}') || chr(10)
        || '**License**: ' || coalesce(license, '{sinks.NO_VALUE}') || chr(10) || '**Version**: ' || coalesce(version, '{sinks.NO_VALUE}') || chr(10) || '**Page**: 1' AS value FROM wide""",
    ),
}
