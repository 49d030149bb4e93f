"""Queries over page manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest as m
from ..sources import corpus
from . import common_sql as sql


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = corpus.explode_lines(corpus.table(spark, d, "documents")).select("doc_id", "page_no").distinct()
    return pages.select("doc_id", "page_no", (F.col("page_no") % 4 * 90).cast("int").alias("rotation"), F.lit(595.0).alias("width"), (F.lit(842.0) + F.col("page_no")).alias("height"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))


def _specs(spark: SparkSession, d: str, *texts: str) -> DataFrame:
    spec = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))
    return _counted(spark, d).withColumn("spec", spec)


def page_select(spark, d):
    return m.page_select(_manifest(spark, d), _specs(spark, d, "1-3,5,8-10", "3 - 1;2", "2–4,x,-3", "0,99999999999", "2-99999999999"))


def page_labels(spark, d):
    return m.page_labels(_manifest(spark, d), "n_of_n", start_at=5, skip_first=1)


def format_page_list(spark, d):
    return m.format_page_list(_manifest(spark, d).where("(page_no * 7 + doc_id) % 3 <> 0").select("doc_id", "page_no"), most=3)


def merge_documents(spark, d):
    groups = _counted(spark, d).select(F.floor(F.col("doc_id") / 3).alias("target"), (-F.col("doc_id")).alias("ord"), "doc_id")
    return m.merge_documents(_manifest(spark, d), groups)


def insert_at(spark, d):
    ids = _counted(spark, d).where("doc_id % 5 = 0").select("doc_id")
    both = ids.select("doc_id", F.lit(1).alias("at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).withColumn("other", F.col("doc_id") + F.col("ord"))
    return m.insert_at(_manifest(spark, d), both)


def apply_page_ops(spark, d):
    k = F.col("doc_id") % 4
    ops = _counted(spark, d).where((F.col("n_pages") >= 3) & (k < 3)).select(
        "doc_id", F.when(k == 0, "reorder").when(k == 1, "rotate").otherwise("blank").alias("op"), F.lit(0).alias("page"), F.lit(2).alias("to"), F.lit(-90).alias("delta"), F.array(F.lit(0), F.lit(2)).alias("pages")
    )
    return m.apply_page_ops(_manifest(spark, d), ops)


def delete_range(spark, d):
    k = F.col("doc_id") % 4
    req = _counted(spark, d).select(
        "doc_id", F.when(k == 0, "2").when(k == 1, "9").when(k == 2, "x").otherwise("3").alias("from_page"), F.when(k == 0, "3").when(k == 1, "1").when(k == 2, "").otherwise("99999999999").alias("to_page"), F.array(F.lit(3)).alias("keep")
    )
    req = req.unionByName(req.where("doc_id % 50 = 0").withColumn("doc_id", -1 - F.col("doc_id")))  # documents that are not there
    return m.delete_range(_manifest(spark, d), req)


def extract_pages(spark, d):
    return m.extract_pages(_manifest(spark, d), _manifest(spark, d).where("page_no % 2 = 1").select("doc_id", "page_no"))


def split_every(spark, d):
    return m.split_every(_manifest(spark, d), 2)


def split_ranges(spark, d):
    return m.split_ranges(_manifest(spark, d), _specs(spark, d, "2-3,1-2", "1,1", "3-1,;,2"))


def asset_dedup(spark, d):
    return m.asset_dedup(corpus.table(spark, d, "pages"))


def protect_pages(spark, d):
    """Seal odd pages, open them again, and count; the sealed bytes differ from run to run."""
    key = F.lit("0123456789abcdef")
    pages = corpus.page_texts(corpus.table(spark, d, "documents"))
    sealed = m.protect_pages(pages, pages.where("page_no % 2 = 1").select("doc_id", "page_no"), key)
    opened = m.unprotect(sealed.select("doc_id", "page_no", "page_text", "sealed"), key)
    told = opened.groupBy("doc_id").agg(F.bool_and("unsealed").alias("opened"), F.sum(F.length("page_text")).alias("n_chars"))
    return m.drop_protected(sealed).join(told, "doc_id")


_M = sql.LINES + """, manifest AS (SELECT DISTINCT doc_id, page_no, page_no % 4 * 90 AS rotation, 595.0 AS width, 842.0 + page_no AS height FROM lines),
counted AS (SELECT doc_id, count(*) AS n FROM manifest GROUP BY doc_id)"""


def _ranges(*specs: tuple) -> str:
    """A CTE of 0-based ranges: for each doc_id modulo, its (ord, first, last) from 1, clamped."""
    values = ", ".join(f"({k}, {o}, {a}, {b})" for k, rs in enumerate(specs) for o, a, b in rs)
    clamp = "least(greatest({}, 1), n) - 1"
    return f"ranges AS (SELECT doc_id, ord, {clamp.format('a')} AS first, {clamp.format('b')} AS last FROM counted JOIN (VALUES {values}) v(k, ord, a, b) ON doc_id % {len(specs)} = k)"


QUERIES = {
    "page_select": (
        page_select,
        f"""WITH {_M}, {_ranges([(0, 1, 3), (1, 5, 5), (2, 8, 10)], [(0, 1, 3), (1, 2, 2)], [(0, 2, 4)], [(0, 0, 0), (1, 9999, 9999)], [(0, 2, 9999)])}
        SELECT DISTINCT doc_id, page_no FROM manifest JOIN ranges USING (doc_id) WHERE page_no BETWEEN first AND last""",
    ),
    "page_labels": (page_labels, f"WITH {_M} SELECT doc_id, page_no, (page_no + 4) || ' / ' || (n + 3) AS label FROM manifest JOIN counted USING (doc_id) WHERE page_no >= 1"),
    "format_page_list": (
        format_page_list,
        f"""WITH {_M}, r AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM manifest WHERE (page_no * 7 + doc_id) % 3 <> 0),
        g AS (SELECT doc_id, min(page_no) + 1 AS a, max(page_no) + 1 AS b FROM r GROUP BY doc_id, g),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
        SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) FILTER (i <= 3) || CASE WHEN any_value(n) > 3 THEN ', …' ELSE '' END AS page_list FROM k GROUP BY doc_id""",
    ),
    "merge_documents": (
        merge_documents,
        f"""WITH {_M}, g AS (SELECT doc_id // 3 AS target, -doc_id AS ord, doc_id, count(*) OVER (PARTITION BY doc_id // 3) AS n2 FROM counted)
        SELECT target, doc_id, page_no AS source_page, row_number() OVER (PARTITION BY target ORDER BY ord, page_no) - 1 AS page_no FROM manifest JOIN g USING (doc_id) WHERE n2 >= 2""",
    ),
    "insert_at": (
        insert_at,
        f"""WITH {_M}, i AS (SELECT doc_id, o AS ord, doc_id + o AS other FROM counted, (VALUES (1), (2)) v(o) WHERE doc_id % 5 = 0),
        s AS (SELECT i.*, n, coalesce(sum(n) OVER (PARTITION BY i.doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM i JOIN counted c ON c.doc_id = other),
        t AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY doc_id)
        SELECT doc_id, doc_id AS source, page_no AS source_page, page_no + CASE WHEN page_no >= 1 THEN coalesce(total, 0) ELSE 0 END AS page_no FROM manifest LEFT JOIN t USING (doc_id)
        UNION ALL SELECT s.doc_id, other, m.page_no, 1 + b + m.page_no FROM s JOIN manifest m ON m.doc_id = other""",
    ),
    "apply_page_ops": (
        apply_page_ops,
        f"""WITH {_M}, e AS (SELECT m.*, CASE WHEN n >= 3 THEN doc_id % 4 ELSE 3 END AS k FROM manifest m JOIN counted USING (doc_id))
        SELECT doc_id, page_no AS source_page, CASE WHEN k = 0 AND page_no = 0 THEN 2 WHEN k = 0 AND page_no <= 2 THEN page_no - 1 WHEN k = 2 AND page_no >= 2 THEN page_no + 1 ELSE page_no END AS page_no,
        CASE WHEN k = 1 AND page_no IN (0, 2) THEN (rotation + 270) % 360 ELSE rotation END AS rotation, width, height FROM e
        UNION ALL SELECT doc_id, -1, 2, 0, width, height FROM e WHERE k = 2 AND page_no = 1""",
    ),
    "delete_range": (
        delete_range,
        f"""WITH {_M}, r AS (SELECT doc_id, n, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 3 END AS lo, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN n ELSE n END AS hi FROM counted),
        g AS (SELECT doc_id, page_no, n, page_no + 1 BETWEEN least(lo, n) AND least(hi, n) AND page_no + 1 <> 3 AS goes FROM manifest JOIN r USING (doc_id)),
        f AS (SELECT *, count(*) FILTER (goes) OVER (PARTITION BY doc_id) AS gone FROM g),
        z AS (SELECT *, CASE WHEN gone = 0 THEN 'empty' WHEN gone = n THEN 'all' END AS refused FROM f)
        SELECT doc_id, page_no AS source_page, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS page_no, refused FROM z WHERE NOT goes OR refused IS NOT NULL
        UNION ALL SELECT -1 - doc_id, NULL, NULL, 'no-doc' FROM counted WHERE doc_id % 50 = 0""",
    ),
    "extract_pages": (extract_pages, f"WITH {_M} SELECT doc_id, page_no AS source_page, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS page_no FROM manifest WHERE page_no % 2 = 1"),
    "split_every": (
        split_every,
        f"""WITH {_M}, p AS (SELECT doc_id, page_no // 2 AS part, min(page_no) + 1 AS a, max(page_no) + 1 AS b FROM manifest GROUP BY ALL)
        SELECT doc_id, lpad(CAST(part + 1 AS VARCHAR), 3, '0') AS part_name, CASE WHEN a = b THEN 'p' || a ELSE 'p' || a || '-' || b END AS label, b - a + 1 AS pages, false AS refused FROM p""",
    ),
    "split_ranges": (
        split_ranges,
        f"""WITH {_M}, {_ranges([(0, 2, 3), (1, 1, 2)], [(0, 1, 1), (1, 1, 1)], [(0, 1, 3), (2, 2, 2)])}
        SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS part, page_no, page_no - first AS place FROM manifest JOIN ranges USING (doc_id) WHERE page_no BETWEEN first AND last""",
    ),
    "asset_dedup": (
        asset_dedup,
        """WITH l AS (SELECT page_id, a[i] AS asset, i FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) AS a FROM pages))),
        f AS (SELECT asset, min((page_id, i)) AS f FROM l WHERE length(asset) >= 5 GROUP BY asset), g AS (SELECT asset, f[1] AS page_id, f[2] AS i FROM f)
        SELECT page_id, asset, printf('p%03d_a%03d', page_id + 1, row_number() OVER (PARTITION BY page_id ORDER BY i)) AS name FROM g""",
    ),
    "protect_pages": (
        protect_pages,
        f"""WITH {sql.PAGES} SELECT doc_id, count(*) FILTER (page_no % 2 = 0) AS pages, count(*) FILTER (page_no % 2 = 1) AS dropped, true AS opened, sum(length(page_text)) AS n_chars FROM page_texts GROUP BY doc_id""",
    ),
}
