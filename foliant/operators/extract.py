"""Fields out of documents: rules, templates, responses, records, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from .find import MARKED, PLAIN

UNKNOWN, LOW = "unknown", "low"
#: What of a page makes it worth a close look. Fixed values.
WANTED = ("party_info", "contract_value", "payment_schedule", "contract_number")


def extract_by_rules(docs: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Long records ``(doc_id, template, key, value)``: the first match of each rule's pattern, null if there is none.

    ``rules`` are settings, ``(template, key, pattern)`` with one group per
    pattern, each an expression of its own; the value keeps its form.
    """

    def record(template: str, key: str, pattern: str) -> Column:
        value = F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))
        return F.struct(F.lit(template).alias("template"), F.lit(key).alias("key"), value.alias("value"))

    return docs.select("doc_id", F.inline(F.array(*(record(*r) for r in rules))))


def classify_by_rules(docs: DataFrame, words: DataFrame, first_chars: int = 2000) -> DataFrame:
    """Type and confidence of each document by the keywords in its first characters, as the feature has it.

    ``words (word, kind)``; three hits or more are high confidence, two medium.
    """
    head = F.split(F.lower(F.substring("text", 1, first_chars)), r"[^\p{L}]+")
    tokens = docs.select("doc_id", F.explode(head).alias("word"))
    score = tokens.join(words, "word").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    best = score.groupBy("doc_id").agg(F.max(F.struct("n", "kind")).alias("b"))
    level = F.when(F.col("b.n") >= 3, "high").when(F.col("b.n") == 2, "medium").otherwise(LOW)
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("b.kind", F.lit(UNKNOWN)).alias("kind"), level.alias("confidence"))


def resolve_fields(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """The fields of each request: its own if it has any, else its template's, else the default's.

    ``requests (request_id, template, custom)`` with ``custom`` an array of
    labels or null; ``templates (template, ord, key)``.
    """
    own = F.size(F.coalesce("custom", F.array().cast("array<string>"))) > 0
    names = templates.select("template").distinct().withColumnRenamed("template", "known")
    chosen = requests.join(names, F.col("template") == F.col("known"), "left").withColumn("used", F.when(own, None).otherwise(F.coalesce("known", F.lit("default"))))
    custom = chosen.where(own).select("request_id", F.posexplode("custom").alias("ord", "key"))
    listed = chosen.where(~own).join(templates.withColumnRenamed("template", "used"), "used").select("request_id", "ord", "key")
    return custom.unionByName(listed)


def slug_fields(labels: DataFrame) -> DataFrame:
    """Keys for labels ``(group_id, ord, label)``: folded words joined by underscores; the k-th repeat gets ``_k``."""
    folded = F.translate(F.lower("label"), MARKED, PLAIN)
    slug = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.when(slug == "", "truong").otherwise(slug)
    k = F.row_number().over(Window.partitionBy("group_id", "_s").orderBy("ord"))
    return labels.withColumn("_s", slug).withColumn("_k", k).select("group_id", "ord", "label", F.when(F.col("_k") > 1, F.concat("_s", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("_s")).alias("key"))


def records_enriched(records: DataFrame, source: Column, stamp: Column) -> DataFrame:
    """Fill ``_source_file`` and ``_timestamp`` where they are missing."""
    have = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.withColumn("_source_file", F.coalesce(have("_source_file"), source)).withColumn("_timestamp", F.coalesce(have("_timestamp"), stamp))


def field_fill_rate(records: DataFrame, templates: DataFrame) -> DataFrame:
    """Share of each template's records that have a key, null for a template without records; keys beyond the template count too."""
    docs = records.groupBy("template").agg(F.countDistinct("doc_id").alias("docs"))
    filled = records.where("value is not null").groupBy("template", "key").agg(F.countDistinct("doc_id").alias("n"))
    keys = templates.select("template", "key").union(records.select("template", "key")).distinct()
    rate = F.when(F.col("docs").isNotNull(), F.coalesce("n", F.lit(0)) / F.col("docs"))
    return keys.join(docs, "template", "left").join(filled, ["template", "key"], "left").select("template", "key", rate.alias("fill_rate"))


def recon_select(pages: DataFrame, close: int = 5) -> DataFrame:
    """Pages to read closely: all of a short document; else relevant ones or such as hold something wanted; else the first.

    Where a page has ``failed`` set, if there is such a column, its document was
    not looked through, and all its pages are read.
    """
    doc = Window.partitionBy("doc_id")
    wanted = F.col("relevance").isin("high", "medium") | F.arrays_overlap("contains", F.array(*map(F.lit, WANTED)))
    failed = F.coalesce("failed", F.lit(False)) if "failed" in pages.columns else F.lit(False)
    marked = pages.withColumn("_w", F.coalesce(wanted, F.lit(False))).withColumn("_n", F.count("*").over(doc)).withColumn("_any", F.bool_or("_w").over(doc)).withColumn("_first", F.min("page_no").over(doc)).withColumn("_lost", F.bool_or(failed).over(doc))
    chosen = (F.col("_n") <= close) | F.col("_w") | F.col("_lost") | (~F.col("_any") & (F.col("page_no") == F.col("_first")))
    return marked.where(chosen).select("doc_id", "page_no")


def _variant(answer: str) -> Column:
    """The JSON of an answer that may stand in a code fence; null if it is none."""
    return F.try_parse_json(_unfenced(answer))


def _is(value: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def parse_responses(raw: DataFrame, schema: str) -> DataFrame:
    """Parse JSON answers ``(id, answer)`` that may stand in code fences; ``failed`` where they are no JSON object.

    Each answer is parsed once, into a variant, from which the fields of
    ``schema`` are taken; one that is missing or of another kind is null. JSON
    that names a key twice is none.
    """
    v = F.col("_v")
    ok = F.coalesce(_is(v, "OBJECT"), F.lit(False))
    return raw.select("id", _variant("answer").alias("_v")).select("id", F.when(ok, F.try_variant_get(v, "$", f"struct<{schema}>")).alias("result"), (~ok).alias("failed"))


def _unfenced(answer: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parse_lists(raw: DataFrame) -> DataFrame:
    """Entries ``(id, i, t)`` of JSON answers that list texts by index, and ``failed`` rows for answers without any.

    An answer is an array or an object whose first array counts; entries
    without an index are ignored, and of entries with one index the last
    counts. An answer is parsed once, into a variant, which is bound where it is
    used; the order of an object's keys, which a variant does not keep, comes
    from its text. Answers without an entry come out of the same pass.
    """
    own = raw.select("id", _variant("answer").alias("_v"), _unfenced("answer").alias("_a"))

    def first_array(members: Column) -> Column:
        found = F.transform(F.json_object_keys("_a"), lambda k: F.try_element_at(members, k))
        return F.try_element_at(F.filter(found, lambda x: _is(x, "ARRAY")), F.lit(1))

    def entries(v: Column) -> Column:
        keyed = bound(F.try_variant_get(v, "$", "map<string,variant>"), first_array)
        return F.try_variant_get(F.when(_is(v, "ARRAY"), v).when(_is(v, "OBJECT"), keyed), "$", "array<variant>")

    pairs = F.transform(bound(F.col("_v"), entries), lambda e: F.struct(F.try_variant_get(e, "$.i", "int").alias("i"), F.coalesce(F.try_variant_get(e, "$.t", "string"), F.lit("")).alias("t")))
    kept = own.select("id", F.filter(pairs, lambda p: p["i"].isNotNull()).alias("p"))
    rows = kept.select("id", F.posexplode_outer("p").alias("place", "e")).groupBy("id", F.col("e.i").alias("i")).agg(F.max_by("e.t", "place").alias("t"), F.count("*").alias("_n"))
    failed = F.col("i").isNull()
    each = F.explode(F.sequence(F.lit(1), F.when(failed, F.col("_n")).otherwise(F.lit(1).cast("long")))).alias("_k")
    return rows.select("id", "i", "t", failed.alias("failed"), each).drop("_k")


def payments_explode(results: DataFrame) -> DataFrame:
    """One row per payment of ``(id, payments)``; none gives one row of nulls; missing parts take defaults."""
    one = results.select("id", F.posexplode_outer("payments").alias("ord", "p"))
    return one.select("id", "ord", F.coalesce("p.name", F.lit("")).alias("name"), "p.share", F.coalesce("p.amount", F.lit(0.0)).alias("amount"))


def normalise_values(values: DataFrame) -> DataFrame:
    """Typed readings of ``(id, raw)``: dates as ``DD/MM/YYYY``, numbers with points for thousands and a comma for decimals."""
    day = F.coalesce(*(F.try_to_date("raw", f) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")))
    number = F.when(F.col("raw").rlike(r"^\d{1,3}(\.\d{3})*(,\d+)?$|^\d+(,\d+)?$"), F.replace(F.replace("raw", F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))
    return values.withColumn("date_text", F.date_format(day, "dd/MM/yyyy")).withColumn("number", number)


def content_fingerprint(docs: DataFrame, pages: DataFrame, head: int = 8192) -> DataFrame:
    """A cache key from name, size, pages and the first characters, and the hash of the whole text, which is the identity."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = F.concat_ws("|", "source", F.length("text").cast("string"), F.col("n").cast("string"), F.substring("text", 1, head))
    return docs.join(n, "doc_id").select("doc_id", F.sha2(parts, 256).alias("cache_key"), F.sha2("text", 256).alias("content_hash"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Texts that several documents share: hash, first document, copies."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
