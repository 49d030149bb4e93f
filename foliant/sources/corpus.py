"""The document model: documents, lines, spans, words and page manifests as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound, offsets

LINES_PER_PAGE = 4
#: A span ends behind its punctuation; the spans of a line cover it exactly.
SPAN = r"[^.,]+[.,]*|[.,]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of every document; ``page_label`` is the page number for people."""
    pages = explode_lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.sum(F.length("line_text")).alias("n_chars"))
    return pages.withColumn("page_label", F.col("page_no") + 1)


def explode_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line_text, page_no, line_in_page)``; blank lines keep their numbers."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line_text"))
    return lines.withColumn("page_no", F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int")).withColumn("line_in_page", F.col("line_no") % LINES_PER_PAGE)


def explode_spans(lines: DataFrame) -> DataFrame:
    """Spans with half-open offsets, boxes and style.

    Lines without a span that shows anything are dropped, as are boxes thinner
    than half a point; white spans stay, with ``host`` false.
    """
    parts = F.regexp_extract_all("line_text", F.lit(SPAN), F.lit(0))
    seen = lines.where(F.col("line_text").rlike(r"\S")).select("doc_id", "page_no", "line_no", "line_in_page", parts.alias("_parts"))
    # Offsets come from the line itself, so nothing is shuffled.
    placed = F.arrays_zip(F.col("_parts").alias("span_text"), offsets(F.col("_parts")).alias("off"))
    spans = seen.select("doc_id", "page_no", "line_no", "line_in_page", F.posexplode_outer(placed).alias("span_no", "s")).select("*", "s.span_text", F.col("s.off").cast("long").alias("off"))
    size = F.length("span_text")
    x0 = F.col("off") * 5.0
    y0 = F.col("line_in_page") * 12.0
    upper = (F.upper("span_text") == F.col("span_text")) & (F.lower("span_text") != F.col("span_text"))
    return spans.select(
        "doc_id",
        "page_no",
        "line_no",
        "span_no",
        "span_text",
        F.col("span_text").rlike(r"\S").alias("host"),
        "off",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.greatest(F.lit(1.0), size * 5.0)).alias("x1"),
        (y0 + 12.0).alias("y1"),
        F.lit(11.0).alias("size"),
        F.when(upper, 16).otherwise(0).alias("flags"),
    )


def line_spans(lines: DataFrame) -> DataFrame:
    """The lines that show something, each with its spans in an array ``spans`` of ``(span_no, span_text, host, off, x0, y0, x1, y1)``; nothing is shuffled."""
    return lines.where(F.col("line_text").rlike(r"\S")).withColumn("spans", span_array())


def span_array() -> Column:
    """The spans of ``line_text``, as an array in their order."""

    def span(x: Column, n: Column) -> Column:
        text, off = x["text"], x["off"]
        x0, y0 = off * 5.0, F.col("line_in_page") * 12.0
        fields = {"span_no": n, "span_text": text, "host": text.rlike(r"\S"), "off": off, "x0": x0, "y0": y0, "x1": x0 + F.greatest(F.lit(1.0), F.length(text) * 5.0), "y1": y0 + 12.0}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    parts = F.regexp_extract_all("line_text", F.lit(SPAN), F.lit(0))
    return bound(parts, lambda t: F.transform(F.arrays_zip(t.alias("text"), offsets(t).alias("off")), span))


def nest_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The same for spans that come as a table of their own: one exchange brings each line's together."""
    s = F.struct("span_no", "span_text", "host", F.col("off").cast("long").alias("off"), "x0", "y0", "x1", "y1")
    whole = spans.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    return lines.join(whole, ["doc_id", "line_no"])


def page_spans(docs: DataFrame, told: Callable[[dict[str, Column]], dict[str, Column]] = dict) -> DataFrame:
    """``(doc_id, page_no, spans)``: the spans of ``explode_spans`` as an array a page, each document's from its own row; nothing is shuffled.

    ``told`` makes the fields of a span from those it has; it may leave some out, which are not worked out then.
    """

    def of_line(line: Column) -> Column:
        def span(x: Column, n: Column) -> Column:
            text, off = x["text"], x["off"]
            x0, y0 = off * 5.0, line["k"] * 12.0
            upper = (F.upper(text) == text) & (F.lower(text) != text)
            fields = {"line_no": line["line_no"], "span_no": n, "span_text": text, "host": text.rlike(r"\S"), "off": off, "x0": x0, "y0": y0, "x1": x0 + F.greatest(F.lit(1.0), F.length(text) * 5.0), "y1": y0 + 12.0, "size": F.lit(11.0), "flags": F.when(upper, 16).otherwise(0)}
            return F.struct(*(c.alias(name) for name, c in told(fields).items()))

        parts = F.regexp_extract_all(line["text"], F.lit(SPAN), F.lit(0))
        return bound(parts, lambda t: F.transform(F.arrays_zip(t.alias("text"), offsets(t).alias("off")), span))

    def of_page(lines: Column, p: Column) -> Column:
        numbered = F.transform(F.slice(lines, p * LINES_PER_PAGE + 1, LINES_PER_PAGE), lambda t, k: F.struct((p * LINES_PER_PAGE + k).alias("line_no"), k.alias("k"), t.alias("text")))
        return F.flatten(F.transform(F.filter(numbered, lambda line: line["text"].rlike(r"\S")), of_line))

    pages = bound(F.split("text", "\n", -1), lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int")), lambda p: of_page(lines, p)))
    return docs.where("text is not null").select("doc_id", F.posexplode(pages).alias("page_no", "spans"))


def _every_word() -> Column:
    """Of a document: all words with their pages."""

    def of_line(line: Column, n: Column) -> Column:
        return F.transform(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.floor(n / LINES_PER_PAGE).cast("int").alias("page_no")))

    return F.flatten(F.transform(F.split("text", "\n", -1), of_line))


def _words(max_words: int, max_pages: int) -> tuple[Column, Column, Column]:
    """Of a document: all words with their pages, the last page that is read, and whether there are words behind it."""
    words = _every_word()
    crossing = F.try_element_at("_words", F.lit(max_words))["page_no"]
    last = F.least(F.lit(max_pages - 1), F.coalesce(crossing, F.lit(max_pages)))
    return words, last, F.coalesce(F.try_element_at("_words", F.lit(-1))["page_no"] > F.col("_last"), F.lit(False))


def word_stream(docs: DataFrame, max_words: int = 300_000, max_pages: int = 1000, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words in reading order with ``pos``, ``page_no`` and ``truncated``.

    A page is read if fewer than ``max_words`` words stand before it, so the
    page that crosses the limit is whole. This is the operator's own limit on a
    comparison, and what it cut is flagged. ``keys`` name the columns that stay;
    a document's words come from its row alone, so nothing is shuffled.
    """
    words, last, truncated = _words(max_words, max_pages)
    own = docs.select(*keys, words.alias("_words")).withColumn("_last", last).withColumn("truncated", truncated)
    told = own.select(*keys, "truncated", "_last", F.posexplode("_words").alias("pos", "w"))
    return told.where(F.col("w.page_no") <= F.col("_last")).select(*keys, "pos", "w.word", "w.page_no", "truncated")


def word_texts(docs: DataFrame, max_words: int | None = None, max_pages: int = 1000, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All words of a document in a row: ``words`` with a blank between them, which no word holds, and their ``pages``.

    With ``max_words``, those that ``word_stream`` reads under both limits.
    """
    if max_words is None:
        read = docs.select(*keys, _every_word().alias("_r"))
    else:
        words, last, _ = _words(max_words, max_pages)
        own = docs.select(*keys, words.alias("_words")).withColumn("_last", last)
        read = own.select(*keys, F.filter("_words", lambda w: w["page_no"] <= F.col("_last")).alias("_r"))
    return read.select(*keys, F.array_join(F.col("_r.word"), " ").alias("words"), F.col("_r.page_no").alias("pages"))


def document_extent(docs: DataFrame, max_words: int = 300_000, max_pages: int = 1000, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of pages of each document, and whether ``word_stream`` cuts it."""
    words, last, truncated = _words(max_words, max_pages)
    own = docs.select(*keys, F.ceil(F.size(F.split("text", "\n", -1)) / LINES_PER_PAGE).cast("int").alias("n_pages"), words.alias("_words"))
    return own.withColumn("_last", last).select(*keys, "n_pages", truncated.alias("truncated"))


def page_texts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, page_no, page_text)``, lines joined in order, each document from its own row."""
    lines = docs.select(*keys, F.split("text", "\n", -1).alias("_lines")).where("_lines is not null")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / LINES_PER_PAGE).cast("int")), lambda p: F.array_join(F.slice("_lines", p * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n"))
    return lines.select(*keys, F.posexplode(pages).alias("page_no", "page_text"))


def text_layer_status(pages: DataFrame, least: int = 20, force: bool = False) -> DataFrame:
    """Per document: pages with enough text, pages that need recognition, and whether any text is there."""
    stripped = F.length(F.regexp_replace("page_text", r"^\s+|\s+$", ""))
    has = stripped >= least
    return pages.groupBy("doc_id").agg(F.count_if(has & F.lit(not force)).alias("skip_pages"), F.count_if(~has | F.lit(force)).alias("ocr_pages"), F.bool_or(has).alias("has_text"))


def assemble_text(pages: DataFrame, headings: bool = False) -> DataFrame:
    """Page texts joined by a blank line, with a heading per page on request; ``error`` where nothing is left."""
    told = F.col("page_text")
    if headings:
        told = F.concat(F.lit("=== page "), (F.col("page_no") + 1).cast("string"), F.lit(" ===\n"), told)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", told.alias("t")))), lambda x: x["t"]), "\n\n")
    joined = pages.groupBy("doc_id").agg(ordered.alias("full_text"), F.bool_or(F.col("page_text").rlike(r"\S")).alias("_some"))
    return joined.select("doc_id", "full_text", F.when(~F.col("_some"), F.lit("no text")).alias("error"))
