"""Algebra of page manifests: select, label, merge, insert, edit, delete, extract, split, seal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A4 = (595.0, 842.0)


def _number(text: Column) -> Column:
    """Digits as a number however many they are: beyond nine, all are past the last page."""
    digits = F.regexp_replace(F.trim(text), r"^([+-]?)0+(?=\d)", "$1")
    size = F.when(F.length(F.regexp_replace(digits, "^[+-]", "")) > 9, F.concat(F.regexp_extract(digits, "^([+-]?)", 1), F.lit("999999999"))).otherwise(digits)
    return F.when(digits.rlike(r"^[+-]?\d+$"), size.try_cast("int"))


def page_ranges(specs: DataFrame, dialect: str = "client") -> DataFrame:
    """Explode ``(doc_id, spec, n_pages)`` into 0-based inclusive ranges ``(doc_id, ord, first, last)``.

    Tokens are parted by commas, in the client's dialect also by semicolons;
    that dialect takes any dash. Reversed ends swap, both are clamped to the
    document, and what is no number or range is skipped.
    """
    text = F.regexp_replace("spec", r"\s+", "")
    if dialect == "client":
        text = F.regexp_replace(F.regexp_replace(text, "[‐‑‒–—−]", "-"), ";", ",")
    token = specs.select("doc_id", "n_pages", F.posexplode(F.split(text, ",")).alias("ord", "token"))
    a, b = (_number(F.try_element_at(F.split("token", "-"), F.lit(i))) for i in (1, 2))
    low, high = F.least(a, F.coalesce(b, a)), F.greatest(a, F.coalesce(b, a))
    ok = token.where(F.col("token").rlike(r"^\d+(-\d+)?$")).select("doc_id", "ord", "n_pages", low.alias("low"), high.alias("high"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(1)), F.col("n_pages"))
    return ok.select("doc_id", "ord", (clamp(F.col("low")) - 1).cast("int").alias("first"), (clamp(F.col("high")) - 1).cast("int").alias("last"))


def page_select(manifest: DataFrame, specs: DataFrame, dialect: str = "client") -> DataFrame:
    """Pages that a spec names, each once."""
    ranges = page_ranges(specs, dialect)
    return manifest.join(ranges, "doc_id").where(F.col("page_no").between(F.col("first"), F.col("last"))).select("doc_id", "page_no").distinct()


def page_labels(manifest: DataFrame, fmt: str = "n_of_n", start_at: int = 1, skip_first: int = 0) -> DataFrame:
    """Labels of the pages behind the first ``skip_first``; an unknown format is the bare number."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    number = (F.lit(start_at) + F.col("page_no") - skip_first).cast("string")
    total = (F.lit(start_at) + n - skip_first - 1).cast("string")
    forms = {"n_of_n": F.concat(number, F.lit(" / "), total), "dash_n": F.concat(F.lit("- "), number, F.lit(" -")), "page_n": F.concat(F.lit("Page "), number), "page_n_of_n": F.concat(F.lit("Page "), number, F.lit(" / "), total)}
    return manifest.withColumn("label", forms.get(fmt, number)).where(F.col("page_no") >= skip_first).select("doc_id", "page_no", "label")


def format_page_list(pages: DataFrame, most: int = 8) -> DataFrame:
    """Runs of pages as text, from 1, the first ``most`` runs then an ellipsis."""
    run = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    runs = pages.select("doc_id", "page_no").distinct().withColumn("_r", run).groupBy("doc_id", "_r").agg((F.min("page_no") + 1).alias("a"), (F.max("page_no") + 1).alias("b"))
    told = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    listed = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", told.alias("t")))).alias("p"))
    first = F.transform(F.slice("p", 1, most), lambda x: x["t"])
    return listed.select("doc_id", F.concat(F.array_join(first, ", "), F.when(F.size("p") > most, ", …").otherwise("")).alias("page_list"))


def renumber(pages: DataFrame, *order: str) -> DataFrame:
    """New page numbers in the given order."""
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def merge_documents(manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """Pages of the documents of each group of two or more, in list order: ``groups (target, ord, doc_id)``."""
    many = groups.withColumn("_n", F.count("*").over(Window.partitionBy("target"))).where("_n >= 2").drop("_n")
    place = F.row_number().over(Window.partitionBy("target").orderBy("ord", "page_no")) - 1
    return manifest.join(many, "doc_id").select("target", "doc_id", F.col("page_no").alias("source_page"), place.alias("page_no"))


def insert_at(manifest: DataFrame, inserts: DataFrame) -> DataFrame:
    """Insert whole documents before page ``at``: ``inserts (doc_id, at, ord, other)``."""
    sizes = manifest.groupBy("doc_id").agg(F.count("*").alias("n"))
    added = inserts.join(sizes.select(F.col("doc_id").alias("other"), "n"), "other")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = added.withColumn("_from", F.col("at") + before)
    total = added.groupBy("doc_id").agg(F.sum("n").alias("_total"), F.first("at").alias("_at"))
    own = manifest.join(total, "doc_id", "left").select(
        "doc_id", F.col("doc_id").alias("source"), F.col("page_no").alias("source_page"), (F.col("page_no") + F.when(F.col("page_no") >= F.col("_at"), F.col("_total")).otherwise(0)).alias("page_no")
    )
    new = manifest.select(F.col("doc_id").alias("other"), "page_no").join(added, "other").select("doc_id", F.col("other").alias("source"), F.col("page_no").alias("source_page"), (F.col("_from") + F.col("page_no")).alias("page_no"))
    return own.unionByName(new)


def apply_page_ops(manifest: DataFrame, ops: DataFrame) -> DataFrame:
    """One edit per document: ``ops (doc_id, op, page, to, delta, pages)``.

    ``reorder`` takes a page out and puts it in at ``to``; ``rotate`` turns the
    pages of the array ``pages`` by ``delta``; ``blank`` adds a page at ``to`` with the size of the
    page before it, A4 in an empty document. Source pages are -1 for blanks.
    """
    j = manifest.join(ops, "doc_id", "left")
    p, a, b = F.col("page_no"), F.col("page"), F.col("to")
    moved = F.when(p == a, b).when((p > a) & (p <= b), p - 1).when((p < a) & (p >= b), p + 1).otherwise(p)
    place = F.when(F.col("op") == "reorder", moved).when((F.col("op") == "blank") & (p >= b), p + 1).otherwise(p)
    turned = F.when((F.col("op") == "rotate") & F.array_contains("pages", p), F.pmod(F.col("rotation") + F.col("delta"), F.lit(360))).otherwise(F.col("rotation"))
    edited = j.select("doc_id", p.alias("source_page"), place.alias("page_no"), turned.alias("rotation"), "width", "height")
    blanks = ops.where("op = 'blank'").select("doc_id", "to")
    before = manifest.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    wanted = blanks.join(before, "doc_id", "left").withColumn("_like", F.least(F.greatest(F.col("to") - 1, F.lit(0)), F.col("_last")))
    sized = wanted.join(manifest.select("doc_id", F.col("page_no").alias("_like"), "width", "height"), ["doc_id", "_like"], "left")
    new = sized.select("doc_id", F.lit(-1).alias("source_page"), F.col("to").alias("page_no"), F.lit(0).alias("rotation"), F.coalesce("width", F.lit(A4[0])).alias("width"), F.coalesce("height", F.lit(A4[1])).alias("height"))
    return edited.unionByName(new)


def delete_range(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete pages ``from..to`` (from 1) but the excepted: ``requests (doc_id, from_page, to_page, keep)``.

    Returns the remaining pages, renumbered, with ``refused``: ``empty`` if no
    page is named, ``all`` if none would stay; refused documents are unchanged.
    A document without pages is one row of nulls with ``no-doc``. What is no
    number stands for the first or last page.
    """
    n = F.count("page_no").over(Window.partitionBy("doc_id"))
    j = requests.join(manifest, "doc_id", "left").withColumn("_n", n)
    a = F.coalesce(_number(F.col("from_page")), F.lit(1))
    b = F.coalesce(_number(F.col("to_page")), F.col("_n"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(1)), F.col("_n"))
    low, high = clamp(F.least(a, b)), clamp(F.greatest(a, b))
    goes = (F.col("page_no") + 1).between(low, high) & ~F.array_contains("keep", F.col("page_no") + 1)
    j = j.withColumn("_goes", F.coalesce(goes, F.lit(False))).withColumn("_gone", F.count_if("_goes").over(Window.partitionBy("doc_id")))
    j = j.withColumn("refused", F.when(F.col("_n") == 0, "no-doc").when(F.col("_gone") == 0, "empty").when(F.col("_gone") == F.col("_n"), "all"))
    left = j.where(~F.col("_goes") | F.col("refused").isNotNull())
    return left.select("doc_id", F.col("page_no").alias("source_page"), F.when(F.col("page_no").isNotNull(), F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1).alias("page_no"), "refused")


def extract_pages(manifest: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen pages as new documents."""
    kept = manifest.join(chosen, ["doc_id", "page_no"], "left_semi").select("doc_id", F.col("page_no").alias("source_page"))
    return renumber(kept, "source_page")


def split_every(manifest: DataFrame, n: int, most_parts: int = 1000) -> DataFrame:
    """Parts of ``n`` pages with labels; a document that would give too many parts has one row without a part, ``refused``."""
    parts = manifest.withColumn("part", F.floor(F.col("page_no") / max(1, n)).cast("int")).groupBy("doc_id", "part").agg((F.min("page_no") + 1).alias("a"), (F.max("page_no") + 1).alias("b"))
    parts = parts.withColumn("refused", F.count("*").over(Window.partitionBy("doc_id")) > most_parts).where(~F.col("refused") | (F.col("part") == 0))
    told = lambda c: F.when(~F.col("refused"), c)
    label = F.when(F.col("a") == F.col("b"), F.concat(F.lit("p"), F.col("a").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    return parts.select("doc_id", told(F.format_string("%03d", F.col("part") + 1)).alias("part_name"), told(label).alias("label"), told(F.col("b") - F.col("a") + 1).alias("pages"), "refused")


def split_ranges(manifest: DataFrame, specs: DataFrame) -> DataFrame:
    """One part per range of the spec, in its order; overlapping ranges repeat pages."""
    ranges = page_ranges(specs, "server")
    hit = manifest.join(ranges, "doc_id").where(F.col("page_no").between(F.col("first"), F.col("last")))
    part = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return hit.select("doc_id", part.alias("part"), "page_no", (F.col("page_no") - F.col("first")).alias("place"))


def asset_dedup(pages: DataFrame, least: int = 5) -> DataFrame:
    """Links of all pages, each once at the first page that has it, numbered there; very short ones are skipped."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1))).alias("k", "asset")).where(F.length("asset") >= least)
    first = links.groupBy("asset").agg(F.min(F.struct("page_id", "k")).alias("f")).select("asset", "f.page_id", "f.k")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("k"))
    return first.select("page_id", "asset", F.format_string("p%03d_a%03d", F.col("page_id") + 1, n).alias("name"))


def protect_pages(pages: DataFrame, chosen: DataFrame, key: Column) -> DataFrame:
    """Seal the chosen pages; placeholders keep page numbers, sealed pages stay, and a request for every page is refused."""
    mark = chosen.select("doc_id", "page_no", F.lit(True).alias("_c"))
    if "sealed" not in pages.columns:
        pages = pages.withColumn("sealed", F.lit(None).cast("binary"))
    j = pages.join(mark, ["doc_id", "page_no"], "left").withColumn("_all", F.bool_and(F.coalesce("_c", F.lit(False)) | F.col("sealed").isNotNull()).over(Window.partitionBy("doc_id")))
    now = F.coalesce("_c", F.lit(False)) & F.col("sealed").isNull() & ~F.col("_all")
    return j.select("doc_id", "page_no", F.when(now, F.lit(None)).otherwise(F.col("page_text")).alias("page_text"), F.when(now, F.aes_encrypt("page_text", key, F.lit("GCM"))).otherwise(F.col("sealed")).alias("sealed"), F.col("_all").alias("refused"))


def unprotect(pages: DataFrame, key: Column) -> DataFrame:
    """Unseal a document's pages, all of them or none."""
    opened = F.when(F.col("sealed").isNotNull(), F.try_aes_decrypt("sealed", key, F.lit("GCM")).cast("string"))
    j = pages.withColumn("_o", opened)
    j = j.withColumn("unsealed", F.bool_and(F.col("sealed").isNull() | F.col("_o").isNotNull()).over(Window.partitionBy("doc_id")))
    return j.select("doc_id", "page_no", F.when(F.col("unsealed"), F.coalesce("page_text", "_o")).otherwise(F.col("page_text")).alias("page_text"), F.when(~F.col("unsealed"), F.col("sealed")).alias("sealed"), "unsealed")


def drop_protected(pages: DataFrame) -> DataFrame:
    """Documents without their sealed pages, and how many were dropped."""
    return pages.groupBy("doc_id").agg(F.count_if(F.col("sealed").isNull()).alias("pages"), F.count_if(F.col("sealed").isNotNull()).alias("dropped"))
