"""Secret scan: find candidates natively, then judge them by who owns them.

A hash of every candidate is counted over the whole corpus by distinct
documents (its repositories) and distinct sources (its owners). A value that
several owners hold, or two in many repositories, is a widely copied example;
one that stays with its owner looks live, in however many repositories. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sums_before
from .common import cut

#: Kind, pattern, group that must be long enough, least length. Fixed values.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further runs that look like generated keys: mixed case and digits, judged by ownership alone.
GENERIC = ("generic", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}", 0, 20)


def _find(df: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Add the column ``kind``: matches as structs of start, end (code points) and value, failing ones dropped."""
    found, gaps, at = f"_{kind}_found", f"_{kind}_gaps", f"_{kind}_at"
    df = df.withColumn(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.transform(F.split("text", pattern, -1), F.length)))
    # A match starts after the gaps up to its own and the matches before it.
    steps = F.transform(found, lambda m, i: (F.element_at(F.col(gaps), i + 1) + F.when(i > 0, F.length(F.element_at(F.col(found), F.greatest(i, F.lit(1))))).otherwise(0)).cast("long"))
    df = df.withColumn(at, F.when(some, steps))
    df = df.withColumn(at, F.when(some, F.zip_with(sums_before(F.col(at)), F.col(at), lambda a, b: a + b)))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    spans = F.zip_with(F.col(found), F.col(at), lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), value(m).alias("value")))
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(kind, F.coalesce(F.filter(F.when(some, spans).otherwise(empty), lambda x: F.length(x["value"]) >= least), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))).drop(found, gaps, at)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """``(doc_id, owner, spans)``: base spans of every text, and generic ones that overlap none of them."""
    df = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in (*KINDS, GENERIC):
        df = _find(df, *kind)

    def tagged(order: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))

    base = F.array_sort(F.concat(*(tagged(i, k[0]) for i, k in enumerate(KINDS))))
    df = df.select("doc_id", "owner", base.alias("base"), tagged(len(KINDS), GENERIC[0]).alias("more"))
    apart = F.filter("more", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    return df.select("doc_id", "owner", "base", F.when(F.size("more") == 0, F.col("more")).otherwise(apart).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, repositories, owners)`` of every candidate value, counted over the whole corpus.

    A hash that many rows share is first counted within each owner and
    document, so partial sums shrink it before it is shuffled.
    """
    seen = found.select("doc_id", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda x: x["hash"]))).alias("hash"))
    per_repository = seen.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("_"))
    per_owner = per_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, owner: str = "source", copied_from: int = 3, spread_from: int = 10, few: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, owner, base, added, n_live, n_copied``.

    ``base`` and ``added`` are arrays of ``(start, ord, kind, end, hash)``, in
    order. A value that at least ``copied_from`` owners hold, or several owners
    in at least ``spread_from`` repositories, is a copied example: its base
    spans stay, but a generic span is added only while its value is rarer. Up
    to ``few`` copied values are sent to the rows that hold candidates. A null text is empty; a null owner counts as one owner; a
    null id is one repository; repeated rows count once.
    """
    found = cut(candidates(docs, owner))
    some = found.where((F.size("base") > 0) | (F.size("more") > 0))
    exploded = some.select(F.xxhash64("doc_id", "owner", "base", "more").alias("_row"), F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda x: x["hash"]))).alias("hash")).distinct()
    spread = (F.col("owners") > 1) & (F.col("repositories") >= spread_from)
    widely = cut(ownership(some).where((F.col("owners") >= copied_from) | spread).select("hash"))
    if widely.count() <= few:  # a value that very many rows hold then needs no shuffle
        widely = F.broadcast(widely)
    copied = exploded.join(widely, "hash", "left_semi").groupBy("_row").agg(F.collect_list("hash").alias("_copied"))
    keyed = some.withColumn("_row", F.xxhash64("doc_id", "owner", "base", "more")).join(copied, "_row", "left")
    copied_set = F.coalesce("_copied", F.array().cast("array<string>"))
    added = F.filter("more", lambda x: ~F.array_contains(copied_set, x["hash"]))
    judged = keyed.select(
        "doc_id",
        "owner",
        "base",
        added.alias("added"),
        F.size(F.filter(F.concat("base", added), lambda x: ~F.array_contains(copied_set, x["hash"]))).cast("long").alias("n_live"),
        F.size(F.filter("base", lambda x: F.array_contains(copied_set, x["hash"]))).cast("long").alias("n_copied"),
    )
    zero = F.lit(0).cast("long")
    none = found.where((F.size("base") == 0) & (F.size("more") == 0)).select("doc_id", "owner", "base", F.col("more").alias("added"), zero.alias("n_live"), zero.alias("n_copied"))
    return none.unionByName(judged)
