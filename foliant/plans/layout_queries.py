"""Queries on boxes, cells, blocks and tables, over the derived geometry of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as lay
from ..sources import corpus
from . import common_sql as sql


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return corpus.explode_spans(corpus.explode_lines(corpus.table(spark, d, "documents")))


def _pages(spark: SparkSession, d: str, told: Callable[[dict[str, Column]], dict[str, Column]] = dict) -> DataFrame:
    return corpus.page_spans(corpus.table(spark, d, "documents"), told)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Three columns of cells on every page, the first two overlapping, none beyond x = 900."""
    pages = corpus.explode_lines(corpus.table(spark, d, "documents")).select("doc_id", "page_no").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cell_no")
    return pages.select("doc_id", "page_no", k).select("doc_id", "page_no", "cell_no", (F.col("cell_no") * 300.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("cell_no") * 300.0 + 350.0).alias("x1"), F.lit(60.0).alias("y1"))


def _cell(k: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(k.alias("cell_no"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _celled(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the three columns of ``_cells`` beside their spans."""
    cell = lambda k: _cell(k, k * 300.0, F.lit(0.0), k * 300.0 + 350.0, F.lit(60.0))
    return _pages(spark, d).withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(2)), cell))


def normalise_boxes(spark, d):
    k = (F.col("span_no") + F.col("line_no")) % 3
    s = _spans(spark, d).withColumn("origin_y", F.when(k == 0, F.col("y0") + 1).otherwise(F.col("y0") + 9)).withColumn("asc", F.lit(0.8) + 0.05 * k).withColumn("desc", F.lit(-0.2))
    # Some lines run downwards, some from right to left, and some tell no direction.
    turn = F.col("line_no") % 5
    s = s.withColumn("dir_x", F.when(turn == 1, 0.0).when(turn == 2, -1.0).when(turn != 3, 1.0)).withColumn("dir_y", F.when(turn == 1, 1.0).when(turn != 3, 0.0005))
    fixed = lay.normalise_boxes(s)
    return lay.touched_bounds(fixed, ["doc_id", "line_no"])


def union_bounds(spark, d):
    return lay.union_bounds(_spans(spark, d), ["doc_id", "page_no"])


def cell_assign(spark, d):
    return lay.cell_assign(_celled(spark, d)).select("doc_id", "line_no", "span_no", "cell_no")


def block_split_by_cells(spark, d):
    return lay.block_split_by_cells(lay.cell_assign(_celled(spark, d)))


def _boxes(spark, d):
    return lay.union_bounds(_spans(spark, d), ["doc_id", "page_no", "line_no"])


def prose_outside_tables(spark, d):
    tables = _cells(spark, d).where("cell_no = 1 and page_no % 2 = 0")
    return lay.prose_outside_tables(_boxes(spark, d), tables).select("doc_id", "page_no", "line_no", "x1")


def _gappy(spark, d):
    """Spans with columns moved apart at every third one."""
    shift = F.floor(F.col("span_no") / 3) * 40.0
    return _spans(spark, d).withColumn("x0", F.col("x0") + shift).withColumn("x1", F.col("x1") + shift)


def split_runs(spark, d):
    return lay.split_runs(_gappy(spark, d)).select("doc_id", "line_no", "span_no", "run_no")


def run_boxes(spark, d):
    return lay.run_boxes(lay.split_runs(_gappy(spark, d)), -10.0, 100000.0)


def cell_align(spark, d):
    s = lay.cell_assign(_celled(spark, d)).where("cell_no >= 0 and host")
    b = s.groupBy("doc_id", "line_no", "cell_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    b = b.withColumn("cx0", F.col("cell_no") * 300.0).withColumn("cx1", F.when(F.col("cell_no") == 2, F.col("cx0") + 5).otherwise(F.col("cx0") + 350.0))
    return lay.cell_align(b).select("doc_id", "line_no", "cell_no", "align", "tx0", "tx1")


def _style(s: dict[str, Column]) -> dict[str, Column]:
    """A span with font and colour, and on pages of even documents with gaps of 30 points between them."""
    gap = F.when(F.col("doc_id") % 2 == 0, s["span_no"] * 30.0).otherwise(0.0)
    font = F.when(s["flags"] == 16, "Sans-Bold").otherwise(F.concat(F.lit("Sans"), (s["span_no"] % 3).cast("string")))
    return s | {"font": font, "color": (s["off"] % 7 * 1000).cast("int"), "x0": s["x0"] + gap, "x1": s["x1"] + gap}


def text_blocks(spark, d):
    s = _spans(spark, d)
    return lay.text_blocks(s.select([v.alias(c) for c, v in _style({c: F.col(c) for c in s.columns}).items()]))


def cell_blocks(spark, d):
    """Two columns of cells on every page, above for its first line, below for the others."""

    def cell(k: Column) -> Column:
        x0, below = k % 2 * 400.0, k >= 2
        return _cell(k, x0, F.when(below, 12.0).otherwise(0.0), x0 + 400.0, F.when(below, 60.0).otherwise(12.0))

    return lay.cell_blocks(_pages(spark, d, _style).withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(3)), cell)))


def visual_lines(spark, d):
    """With one size the rows of a page are its lines, in order."""
    return lay.visual_lines(_spans(spark, d)).select("doc_id", "page_no", "line_no", "span_no", "row_no")


def _rows(spark, d):
    lines = corpus.explode_lines(corpus.table(spark, d, "documents"))
    return lines.select(F.concat_ws("/", "doc_id", "page_no").alias("table_id"), F.col("line_no").alias("row_no"), F.split("line_text", ",", -1).alias("cells"))


def table_rectangularise(spark, d):
    t = lay.table_rectangularise(_rows(spark, d))
    return t.select("table_id", "row_no", F.size("cells").alias("width"), F.array_join("cells", "|").alias("joined"))


def content_items(spark, d):
    return lay.content_items(_boxes(spark, d), _cells(spark, d).where("cell_no = 1").withColumn("y0", F.lit(12.0)))


def content_to_csv(spark, d):
    lines = corpus.explode_lines(corpus.table(spark, d, "documents"))
    cells = F.when(F.col("line_no") % 2 == 0, F.array("line_text")).otherwise(F.split("line_text", " "))
    return lay.content_to_csv(lines.select("doc_id", "page_no", F.col("line_no").alias("item_no"), cells.alias("cells")))


def collapse_excess_regions(spark, d):
    boxes = lambda s: {c: s[c] for c in ("x0", "y0", "x1", "y1")} | {"kind": F.lit("ins")}
    return lay.collapse_excess_regions(_pages(spark, d, boxes).withColumnRenamed("spans", "boxes"), 20)


def region_kind(spark, d):
    s = _spans(spark, d).select(F.concat_ws("/", "doc_id", "page_no").alias("region"), F.when(F.col("span_no") % 2 == 0, F.length("span_text")).otherwise(0).alias("removed"), F.when(F.col("span_no") % 3 == 1, F.length("span_text")).otherwise(0).alias("added"))
    return lay.region_kind(s, "low")


_CELLS = """, pages_ AS (SELECT DISTINCT doc_id, page_no FROM lines),
cells AS (SELECT doc_id, page_no, k AS cell_no, k * 300.0 AS x0, 0.0 AS y0, k * 300.0 + 350.0 AS x1, 60.0 AS y1 FROM pages_, (VALUES (0), (1), (2)) v(k))"""
_ASSIGNED = sql.SPANS + _CELLS + """, hit AS (SELECT s.doc_id, s.line_no, s.span_no, min(c.cell_no) AS cell_no FROM spans s JOIN cells c ON s.doc_id = c.doc_id AND s.page_no = c.page_no
  AND (s.x0 + s.x1) / 2 BETWEEN c.x0 AND c.x1 AND (s.y0 + s.y1) / 2 BETWEEN c.y0 AND c.y1 GROUP BY ALL),
assigned AS (SELECT s.*, coalesce(h.cell_no, -1) AS cell_no FROM spans s LEFT JOIN hit h USING (doc_id, line_no, span_no))"""
_BOXES = sql.SPANS + ", boxes AS (SELECT doc_id, page_no, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spans GROUP BY ALL)"
_RUNS = sql.SPANS + """, gappy AS (SELECT doc_id, line_no, span_no, size, x0 + span_no // 3 * 40.0 AS x0, x1 + span_no // 3 * 40.0 AS x1 FROM spans),
o AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0, span_no) > 2 * greatest(size, 1) THEN 1 ELSE 0 END AS o FROM gappy),
runs AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, line_no ORDER BY x0, span_no) AS run_no FROM o)"""

_STYLED = f"""{sql.SPANS}, styled AS (SELECT * EXCLUDE (x0, x1), x0 + g AS x0, x1 + g AS x1, CASE WHEN flags = 16 THEN 'Sans-Bold' ELSE 'Sans' || span_no % 3 END AS font, CAST(off % 7 * 1000 AS INTEGER) AS color
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN span_no * 30.0 ELSE 0 END AS g FROM spans))"""
QUERIES = {
    "normalise_boxes": (
        normalise_boxes,
        f"""WITH {sql.SPANS}, s AS (SELECT *, CASE WHEN (span_no + line_no) % 3 = 0 THEN y0 + 1 ELSE y0 + 9 END AS oy, CAST(0.8 AS DOUBLE) + CAST(0.05 AS DOUBLE) * ((span_no + line_no) % 3) AS a FROM spans),
        b AS (SELECT *, line_no % 5 NOT IN (1, 2) AND oy - y0 < 0.25 * size AND y1 - y0 >= 0.5 * size AS touched FROM s),
        f AS (SELECT doc_id, line_no, x0, x1, touched, CASE WHEN touched THEN oy - greatest(a, CAST(0.9 AS DOUBLE)) * size ELSE y0 END AS y0, CASE WHEN touched THEN oy - least(CAST(-0.2 AS DOUBLE), CAST(-0.25 AS DOUBLE)) * size ELSE y1 END AS y1 FROM b)
        SELECT doc_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f GROUP BY ALL HAVING bool_or(touched)""",
    ),
    "union_bounds": (union_bounds, f"WITH {sql.SPANS} SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spans GROUP BY ALL"),
    "cell_assign": (cell_assign, f"WITH {_ASSIGNED} SELECT doc_id, line_no, span_no, cell_no FROM assigned"),
    "block_split_by_cells": (
        block_split_by_cells,
        f"""WITH {_ASSIGNED}, w AS (SELECT *, bool_and(cell_no >= 0) FILTER (host) OVER (PARTITION BY doc_id, page_no) AS ok FROM assigned)
        SELECT doc_id, page_no, CASE WHEN ok THEN cell_no ELSE -1 END AS part, count(*) AS n_spans, min(x0) AS x0, max(x1) AS x1 FROM w GROUP BY doc_id, page_no, CASE WHEN ok THEN cell_no ELSE -1 END""",
    ),
    "prose_outside_tables": (
        prose_outside_tables,
        f"""WITH {_BOXES}{_CELLS} SELECT doc_id, page_no, line_no, x1 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc_id = b.doc_id AND c.page_no = b.page_no AND cell_no = 1 AND c.page_no % 2 = 0
        AND (b.x0 + b.x1) / 2 BETWEEN c.x0 AND c.x1 AND (b.y0 + b.y1) / 2 BETWEEN c.y0 AND c.y1)""",
    ),
    "split_runs": (split_runs, f"WITH {_RUNS} SELECT doc_id, line_no, span_no, run_no FROM runs"),
    "run_boxes": (
        run_boxes,
        f"""WITH {_RUNS}, b AS (SELECT doc_id, line_no, run_no, min(x0) AS x0, max(x1) AS x1 FROM runs GROUP BY ALL)
        SELECT doc_id, line_no, run_no, coalesce((lag(x1) OVER w + x0) / 2, -10.0) AS "left", coalesce((x1 + lead(x0) OVER w) / 2, 100000.0) AS "right" FROM b WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY run_no)""",
    ),
    "cell_align": (
        cell_align,
        f"""WITH {_ASSIGNED}, b AS (SELECT doc_id, line_no, cell_no, min(x0) AS x0, max(x1) AS x1, cell_no * 300.0 + 2 AS a, CASE WHEN cell_no = 2 THEN 603.0 ELSE cell_no * 300.0 + 348 END AS b FROM assigned WHERE cell_no >= 0 AND host GROUP BY doc_id, line_no, cell_no),
        t AS (SELECT *, b - a < 4 AS narrow, greatest(2.0, 0.05 * (b - a)) AS tol FROM b),
        g AS (SELECT *, CASE WHEN narrow THEN 'left' WHEN abs((x0 - a) - (b - x1)) <= tol THEN 'center' WHEN (b - x1) + tol < x0 - a THEN 'right' ELSE 'left' END AS align FROM t)
        SELECT doc_id, line_no, cell_no, align, CASE WHEN narrow OR align = 'left' THEN x0 ELSE least(a, x0) END AS tx0, CASE WHEN narrow OR align = 'right' THEN x1 ELSE greatest(b, x1) END AS tx1 FROM g""",
    ),
    "text_blocks": (
        text_blocks,
        f"""WITH {_STYLED}, l AS (SELECT doc_id, page_no, line_no, regexp_replace(string_agg(span_text, '' ORDER BY span_no), '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM styled GROUP BY ALL),
        s AS (SELECT doc_id, page_no, arg_min({{'size': size, 'flags': flags, 'font': font, 'color': color}}, (line_no, span_no)) AS s FROM styled WHERE host GROUP BY ALL)
        SELECT doc_id, page_no, string_agg(t, ' ' ORDER BY line_no) FILTER (t <> '') AS block_text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(s.font) AS font, any_value(s.size) AS size, any_value(s.color) AS color,
        any_value(s.flags) & 16 <> 0 AS bold, any_value(s.flags) & 2 <> 0 AS italic FROM l JOIN s USING (doc_id, page_no) GROUP BY doc_id, page_no HAVING string_agg(t, ' ') FILTER (t <> '') IS NOT NULL""",
    ),
    "cell_blocks": (
        cell_blocks,
        f"""WITH {_STYLED}, k AS (SELECT *, CASE WHEN (x0 + x1) / 2 > 800 THEN -1 WHEN (x0 + x1) / 2 > 400 THEN 1 ELSE 0 END AS c, CASE WHEN (y0 + y1) / 2 <= 12 THEN 0 ELSE 2 END AS r FROM styled WHERE host),
        ok AS (SELECT *, c + r AS cell_no FROM (SELECT *, bool_and(c >= 0) OVER (PARTITION BY doc_id, page_no) AS fits FROM k) WHERE fits),
        n AS (SELECT *, max(y0) OVER w > min(y0) OVER w AS wrapped, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, cell_no ORDER BY x0, span_no) > 2 * greatest(size, 1) THEN 1 ELSE 0 END AS o FROM ok WINDOW w AS (PARTITION BY doc_id, page_no, cell_no)),
        u AS (SELECT *, CASE WHEN wrapped THEN 0 ELSE sum(o) OVER (PARTITION BY doc_id, page_no, cell_no ORDER BY x0, span_no ROWS UNBOUNDED PRECEDING) END AS run_no, regexp_replace(span_text, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t FROM n),
        b AS (SELECT doc_id, page_no, cell_no, run_no, string_agg(t, ' ' ORDER BY CASE WHEN wrapped THEN 0 ELSE x0 END, line_no, span_no) AS block_text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
          arg_min({{'size': size, 'flags': flags, 'font': font, 'color': color}}, (CASE WHEN wrapped THEN 0 ELSE x0 END, line_no, span_no)) AS s FROM u GROUP BY ALL),
        e AS (SELECT *, coalesce((lag(x1) OVER w + x0) / 2, cell_no % 2 * 400) + 2 AS a, coalesce((x1 + lead(x0) OVER w) / 2, cell_no % 2 * 400 + 400) - 2 AS z FROM b WINDOW w AS (PARTITION BY doc_id, page_no, cell_no ORDER BY run_no)),
        f AS (SELECT *, CASE WHEN z - a < 4 THEN 'left' WHEN abs((x0 - a) - (z - x1)) <= greatest(2, 0.05 * (z - a)) THEN 'center' WHEN (z - x1) + greatest(2, 0.05 * (z - a)) < x0 - a THEN 'right' ELSE 'left' END AS align FROM e)
        SELECT doc_id, page_no, cell_no, run_no, block_text, x0, y0, x1, y1, align, CASE WHEN z - a < 4 OR align = 'left' THEN x0 ELSE least(a, x0) END AS tx0, CASE WHEN z - a < 4 OR align = 'right' THEN x1 ELSE greatest(z, x1) END AS tx1,
        s.font AS font, s.size AS size, s.color AS color, s.flags & 16 <> 0 AS bold, s.flags & 2 <> 0 AS italic FROM f""",
    ),
    "visual_lines": (
        visual_lines,
        f"WITH {sql.SPANS} SELECT doc_id, page_no, line_no, span_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY y0) - 1 AS row_no FROM spans",
    ),
    "table_rectangularise": (
        table_rectangularise,
        f"""WITH {sql.LINES}, r AS (SELECT doc_id || '/' || page_no AS table_id, line_no AS row_no, [regexp_replace(c, '^[[:space:]]+|[[:space:]]+$', '', 'g') FOR c IN string_split(line_text, ',')] AS cells FROM lines),
        w AS (SELECT *, max(len(cells)) OVER (PARTITION BY table_id) AS width, bool_or(len([c FOR c IN cells IF c <> '']) > 0) OVER (PARTITION BY table_id) AS filled FROM r)
        SELECT table_id, row_no, width, array_to_string(cells, '|') || repeat('|', CAST(width - len(cells) AS BIGINT)) AS joined FROM w WHERE filled""",
    ),
    "content_items": (
        content_items,
        f"""WITH {_BOXES}{_CELLS}, u AS (SELECT doc_id, page_no, 'text' AS kind, x0, y0 FROM boxes UNION ALL SELECT doc_id, page_no, 'table', x0, 12.0 FROM cells WHERE cell_no = 1)
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(y0, 1), x0, kind) - 1 AS item_no FROM u""",
    ),
    "content_to_csv": (
        content_to_csv,
        f"""WITH {sql.LINES}, i AS (SELECT doc_id, page_no, line_no AS item_no, CASE WHEN line_no % 2 = 0 THEN [line_text] ELSE string_split(line_text, ' ') END AS cells FROM lines),
        b AS (SELECT doc_id, page_no, item_no, array_to_string([CASE WHEN regexp_matches(c, '[",\\n\\r]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END FOR c IN cells], ',') AS csv_line FROM i
          UNION ALL SELECT DISTINCT doc_id, page_no, -1, '--- page ' || (page_no + 1) || ' ---' FROM i WHERE page_no > 0)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, item_no) - 1 AS row_no, csv_line FROM b""",
    ),
    "collapse_excess_regions": (
        collapse_excess_regions,
        f"""WITH {sql.SPANS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM spans),
        u AS (SELECT doc_id, page_no, x0, y0, x1, y1, 'ins' AS kind FROM n WHERE n <= 20 UNION ALL SELECT doc_id, page_no, min(x0), min(y0), max(x1), max(y1), 'rep' FROM n WHERE n > 20 GROUP BY doc_id, page_no)
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, x1, y1) - 1 AS box_no FROM u""",
    ),
    "region_kind": (
        region_kind,
        f"""WITH {sql.SPANS}, s AS (SELECT doc_id || '/' || page_no AS region, sum(CASE WHEN span_no % 2 = 0 THEN length(span_text) ELSE 0 END) AS removed, sum(CASE WHEN span_no % 3 = 1 THEN length(span_text) ELSE 0 END) AS added FROM spans GROUP BY 1)
        SELECT region, removed, added, CASE WHEN removed >= 60 AND added >= 60 THEN 'rep' WHEN added > removed THEN 'ins' ELSE 'del' END AS kind FROM s WHERE removed + added >= 60""",
    ),
}
