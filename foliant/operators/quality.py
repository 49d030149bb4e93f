"""Encoding triage and repair, error classes, protected terms, charsets, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value. Characters that a Latin-script text does not hold: C1, Cyrillic, Greek, private use, the replacement character, stray controls.
MOJIBAKE = r"[\x{80}-\x{9f}\x{400}-\x{4ff}\x{370}-\x{3ff}\x{e000}-\x{f8ff}\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]"

# The TCVN3 (TCVN 5712) code page as read through WinAnsi, and the letters meant.
TCVN3_FROM = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉËÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô\u00adõøö÷ùúýûüþ®§¡¢£¤¥¦"
TCVN3_TO = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĐĂÂÊÔƠƯ"

# Code, whether a retry helps, status (0: none), and texts that tell it, in the order of trust.
ERROR_RULES = (
    ("INVALID_API_KEY", False, 0, ("API key not valid", "API_KEY_INVALID")),
    ("QUOTA_EXCEEDED", True, 429, ("quota", "RATE_LIMIT")),
    ("MODEL_NOT_FOUND", False, 404, ("not found", "NOT_FOUND")),
    ("CONTENT_FILTERED", True, 0, ("SAFETY", "blocked", "RECITATION")),
    ("PAYLOAD_TOO_LARGE", False, 413, ("too large", "payload")),
    ("PARSE_ERROR", True, 0, ("JSON", "parse", "Unexpected token")),
    ("NETWORK_ERROR", True, 0, ("fetch", "network", "ECONNREFUSED")),
)
OTHER_ERROR = ("GEMINI_ERROR", True)

# Fixed value: terms to protect (e-mail, date, number), tried in this order at each place. Letters and digits of any script count in e-mails.
TERM = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+|\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d[\d.,]*"
OPEN, CLOSE = "⟦", "⟧"

# Style words that end a font's name.
STYLES = "BoldItalic|BoldOblique|SemiBold|DemiBold|ExtraBold|UltraBold|Demi|Bold|Italic|Oblique|Regular|Normal|Book|Light|Medium|Black|Heavy|Thin|Condensed|Narrow|PSMT|PS|MT|Std|Pro"


def plain_family(font: Column) -> Column:
    """A font's name without the prefix of six characters that a subset has, style tail and technical suffix."""
    head = F.regexp_extract(F.regexp_replace(font, r"^[^+]{6}\+", ""), r"^([^,-]*)", 1)
    return F.trim(F.regexp_replace(head, "(PSMT|PS|MT)$", ""))


def _legacy(font: Column) -> Column:
    name = F.regexp_replace(F.lower(plain_family(font)), r"^\.+", "")
    return F.coalesce(name.rlike("^vn") | F.contains(name, F.lit("tcvn")), F.lit(False))


def suspect_reason(text: Column, font: Column) -> Column:
    """Why a span's text is likely wrong, null if it is not; blank text never is."""
    return F.when(~text.rlike(r"\S"), None).when(text.rlike(MOJIBAKE), "mojibake").when(_legacy(font) & text.rlike(r"[^\x00-\x7f]"), "legacy_font")


def encoding_triage(spans: DataFrame) -> DataFrame:
    """Suspect spans per source and reason; ``spans (source, span_text, font)``."""
    return spans.withColumn("reason", suspect_reason(F.col("span_text"), F.col("font"))).where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("spans"))


def legacy_repair(spans: DataFrame) -> DataFrame:
    """Transcode suspect spans of legacy fonts; ``accepted`` if the result changed, is clean and holds a marked letter."""
    wrong = spans.where(suspect_reason(F.col("span_text"), F.col("font")).isNotNull() & _legacy(F.col("font")))
    new = F.translate("span_text", TCVN3_FROM, TCVN3_TO)
    ok = (new != F.col("span_text")) & ~new.rlike(MOJIBAKE) & new.rlike(r"[\x{c0}-\x{1ef9}]")
    return wrong.withColumn("repaired", F.when(ok, new).otherwise(F.col("span_text"))).withColumn("accepted", ok)


def error_ladder(messages: DataFrame) -> DataFrame:
    """Add ``code`` and ``retryable`` to ``(status, message)`` rows: the first rule that applies."""
    code, retry = F.lit(OTHER_ERROR[0]), F.lit(OTHER_ERROR[1])
    for name, again, status, texts in reversed(ERROR_RULES):
        hit = F.col("status") == status if status else F.lit(False)
        for t in texts:
            hit = hit | F.contains("message", F.lit(t))
        code, retry = F.when(hit, name).otherwise(code), F.when(hit, again).otherwise(retry)
    return messages.withColumn("code", code).withColumn("retryable", retry)


def term_inventory(docs: DataFrame) -> DataFrame:
    """Protected terms by kind: how many, how many distinct, in how many documents."""
    terms = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    kind = F.when(F.contains("term", F.lit("@")), "email").when(F.col("term").rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}$"), "date").otherwise("number")
    return terms.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.countDistinct("doc_id").alias("docs"))


def mask_terms(text: Column) -> tuple[Column, Column]:
    """The text with its terms replaced by numbered marks, and the terms."""
    terms = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.split(text, TERM, -1)
    marked = F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), g)))
    return F.array_join(marked, ""), terms


def unmask_terms(masked: Column, terms: Column) -> Column:
    """Put the terms back; a mark with an unknown number stays."""
    parts = F.split(masked, f"(?={OPEN}[0-9]+{CLOSE})", -1)

    def restored(p: Column) -> Column:
        number = F.regexp_extract(p, f"^{OPEN}([0-9]+){CLOSE}", 1).try_cast("int")
        known = F.try_element_at(terms, number + 1)
        return F.when(number.isNotNull() & known.isNotNull(), F.concat(known, F.regexp_replace(p, f"^{OPEN}[0-9]+{CLOSE}", ""))).otherwise(p)

    return F.array_join(F.transform(parts, restored), "")


def mask_corpus(docs: DataFrame) -> DataFrame:
    masked, terms = mask_terms(F.col("text"))
    return docs.select("doc_id", masked.alias("masked"), terms.alias("terms"))


def unmask_corpus(masked: DataFrame) -> DataFrame:
    return masked.select("doc_id", unmask_terms(F.col("masked"), F.col("terms")).alias("text"))


def heavy_shares(rows: DataFrame, key: Column, least: float = 0.002, tracked: int = 4096) -> dict[int, float]:
    """Hashes of the keys that about ``least`` of the rows or more hold, with their shares.

    A sketch of ``tracked`` counters finds them in one pass without a shuffle of
    keys. It misses none whose share is above 1 / (0.75 * tracked), far below
    ``least``, so there are at most 1 / least of them, whatever the table.
    """
    most = int(1 / least)
    found = rows.select(F.xxhash64(key).alias("_h")).agg(F.expr(f"approx_top_k(_h, {most}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    return {t["item"]: t["count"] / found["n"] for t in found["top"] or [] if t["count"] >= least * found["n"]}


def phrasebook_apply(blocks: DataFrame, book: DataFrame, pieces: int = 1024) -> DataFrame:
    """Translate whole blocks by a book of ``(source, target)``, terms masked on both sides.

    ``blocks (doc_id, page_no, block_no, text)`` gain ``translated`` and
    ``done``; a missing, equal or empty entry leaves the block as it is. Of
    entries with one mask the one whose source is smallest, then whose target
    is, counts.

    Blocks meet entries by mask. A mask that very many blocks have is dealt
    into a share of ``pieces`` as large as its share of the blocks, and its
    entry is sent to each of them, so no task gets more than a few thousandths
    of the blocks.
    """
    masked, terms = mask_terms(F.col("text"))
    own = blocks.withColumn("_m", masked).withColumn("_terms", terms)
    entries = book.where("source is not null").select(mask_terms(F.col("source"))[0].alias("_m"), F.struct("source", mask_terms(F.col("target"))[0].alias("t")).alias("e")).groupBy("_m").agg(F.min("e").alias("e"))
    entries = entries.select("_m", F.col("e.t").alias("_t"))
    # How blocks are dealt does not change what comes out, so a sample of them tells which masks are frequent.
    heavy = heavy_shares(blocks.sample(0.0625, 1).select(masked.alias("_m")), F.col("_m"))
    parts = {h: max(2, round(share * pieces)) for h, share in heavy.items()}
    many = F.coalesce(F.create_map(*(F.lit(x) for h, n in parts.items() for x in (h, n)))[F.xxhash64("_m")], F.lit(1)) if parts else F.lit(1)
    own = own.withColumn("_part", F.pmod(F.xxhash64("doc_id", "block_no"), many).cast("int"))
    entries = entries.withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
    j = own.join(entries, ["_m", "_part"], "left")
    # Columns of their own, so that terms are put back once a block.
    new = j.withColumn("_new", unmask_terms(F.col("_t"), F.col("_terms")))
    ok = F.col("_t").isNotNull() & (F.col("_new") != F.col("text")) & F.col("_new").rlike(r"\S")
    told = new.withColumn("done", F.coalesce(ok, F.lit(False)))
    return told.select("doc_id", "page_no", "block_no", F.when(F.col("done"), F.col("_new")).otherwise(F.col("text")).alias("translated"), "done", F.col("_t").isNull().alias("missing"))


def phrasebook_pages(done: DataFrame, *more: Column) -> DataFrame:
    """Per page of ``phrasebook_apply``: translated blocks, whether the page changed, and whether it failed, as no block had an entry; with ``more`` aggregates of the same pass."""
    n = done.groupBy("doc_id", "page_no").agg(F.count_if("done").alias("translated"), F.bool_and("missing").alias("failed"), *more)
    told = ("doc_id", "page_no", "translated", "failed")
    return n.select(*told[:3], (F.col("translated") > 0).alias("changed"), "failed", *(c for c in n.columns if c not in told))


def charset_coverage(docs: DataFrame, charset: DataFrame) -> DataFrame:
    """Documents with characters outside ``charset (ch)``: how many distinct ones, and which."""
    chars = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where(F.col("ch").rlike(r"^\S$"))
    return chars.join(charset, "ch", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_set("ch")), "").alias("missing"))


def catalog_resolve(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue's family for each name: the first candidate that exists wins.

    Candidates are the name without prefix, tail and technical suffix, the name
    without style words, and the raw name, compared by their letters and digits.
    """
    bare = F.regexp_replace("name", r"^[^+]{6}\+", "")
    clean = plain_family(F.col("name"))
    raw = F.trim(F.regexp_extract(bare, r"^([^,]*)", 1))
    stripped = F.regexp_replace(raw, rf"(?i)(?<=.)([\s_-]*(?:{STYLES}))+$", "")
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    tried = names.select("name", F.posexplode(F.array(norm(clean), norm(stripped), norm(raw))).alias("ord", "_n")).where("_n <> ''")
    families = catalog.select("family", norm(F.col("family")).alias("_n")).groupBy("_n").agg(F.min("family").alias("family"))
    found = tried.join(families, "_n").groupBy("name").agg(F.min_by("family", "ord").alias("family"), F.min("ord").alias("candidate"))
    return names.select("name").distinct().join(found, "name", "left")


def modal_with_support(df: DataFrame, key: str, value: str, least: float = 0.6) -> DataFrame:
    """The most frequent value of each key if its share of the values reaches ``least``; of equals the smallest. A key without values has null."""
    counts = df.groupBy(key, value).agg(F.count(value).alias("_n"))
    first = F.min(F.struct((-F.col("_n")).alias("less"), F.col(value).isNull().alias("none"), F.col(value).alias("v"))).alias("_f")
    best = counts.groupBy(key).agg(first, F.sum("_n").alias("_all"))
    share = F.try_divide(-F.col("_f.less"), "_all")
    return best.select(key, F.when(share >= least, F.col("_f.v")).alias("modal"), share.alias("share"))
