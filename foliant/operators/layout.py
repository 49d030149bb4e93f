"""Boxes, runs, cells, blocks and tables. Coordinates are points, y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound

PAD = 2.0
#: Least changed ink for a region to count, by sensitivity. Fixed values.
SENSITIVITY = {"low": 60, "normal": 25, "high": 8}


def normalise_boxes(spans: DataFrame) -> DataFrame:
    """Repair spans whose top edge sits on the baseline; ``spans`` has ``origin_y``, ``asc`` and ``desc`` too.

    Only spans of lines that run from left to right are repaired: ``dir_x`` and
    ``dir_y`` tell the direction; without them, or where they are null, it is that one.
    """
    oy, size = F.col("origin_y"), F.col("size")
    way = lambda c, usual: F.coalesce(c, F.lit(usual)) if c in spans.columns else F.lit(usual)
    level = (F.abs(way("dir_y", 0.0)) <= 1e-3) & (way("dir_x", 1.0) > 0)
    broken = level & (oy - F.col("y0") < 0.25 * size) & (F.col("y1") - F.col("y0") >= 0.5 * size)
    top, bottom = oy - F.greatest("asc", F.lit(0.9)) * size, oy - F.least("desc", F.lit(-0.25)) * size
    marked = spans.withColumn("touched", broken)
    return marked.withColumn("y0", F.when(F.col("touched"), top).otherwise(F.col("y0"))).withColumn("y1", F.when(F.col("touched"), bottom).otherwise(F.col("y1")))


def touched_bounds(spans: DataFrame, keys: list[str]) -> DataFrame:
    """New boxes of the groups that hold a repaired span; the others keep theirs and are left out."""
    return union_bounds(spans, keys, F.bool_or("touched").alias("_t")).where("_t").drop("_t")


def union_bounds(boxes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The enclosing box of each group."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *more)


def _cell_of(span: Column, cells: Column) -> Column:
    """The first cell that holds a span's centre, edges included, -1 if none does."""
    cx, cy = (span["x0"] + span["x1"]) / 2, (span["y0"] + span["y1"]) / 2
    inside = F.filter(cells, lambda c: cx.between(c["x0"], c["x1"]) & cy.between(c["y0"], c["y1"]))
    return F.coalesce(F.array_min(F.transform(inside, lambda c: c["cell_no"])), F.lit(-1))


def cell_assign(pages: DataFrame) -> DataFrame:
    """The spans of ``pages (doc_id, page_no, spans, cells)``, a row each, with ``cell_no``: the first cell that holds the span's centre, -1 if none does.

    A cell is ``(cell_no, x0, y0, x1, y1)``. A page has its cells beside it, so nothing is joined.
    """
    return pages.select("doc_id", "page_no", "cells", F.explode("spans").alias("s")).select("doc_id", "page_no", "s.*", _cell_of(F.col("s"), F.col("cells")).alias("cell_no"))


def block_split_by_cells(assigned: DataFrame) -> DataFrame:
    """Parts of blocks: a block falls into its cells only if all its visible spans lie in one; otherwise it is one part (-1)."""
    whole = Window.partitionBy("doc_id", "page_no")
    split = F.bool_and(F.when(F.col("host"), F.col("cell_no") >= 0)).over(whole)
    part = F.when(split, F.col("cell_no")).otherwise(-1)
    return assigned.withColumn("part", part).groupBy("doc_id", "page_no", "part").agg(F.count("*").alias("n_spans"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def prose_outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no table of their page."""
    cx, cy = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_no") == F.col("t.page_no")) & cx.between(F.col("t.x0"), F.col("t.x1")) & cy.between(F.col("t.y0"), F.col("t.y1"))
    return blocks.alias("b").join(tables.alias("t"), inside, "left_anti")


def split_runs(spans: DataFrame, gap: float = 2.0, keys: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """Add ``run_no`` within a line: a new run begins where the gap to the span before exceeds ``gap`` sizes."""
    line = Window.partitionBy(*keys).orderBy("x0", "span_no")
    opens = F.coalesce(F.col("x0") - F.lag("x1").over(line) > gap * F.greatest("size", F.lit(1.0)), F.lit(False))
    return spans.withColumn("_o", opens.cast("int")).withColumn("run_no", F.sum("_o").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def run_boxes(runs: DataFrame, left: float, right: float) -> DataFrame:
    """A cell cut at the middle of the gaps between its runs; the outer edges are the cell's."""
    boxes = runs.groupBy("doc_id", "line_no", "run_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("run_no")
    a = F.coalesce((F.lag("x1").over(line) + F.col("x0")) / 2, F.lit(left))
    b = F.coalesce((F.col("x1") + F.lead("x0").over(line)) / 2, F.lit(right))
    return boxes.select("doc_id", "line_no", "run_no", a.alias("left"), b.alias("right"))


def cell_align(blocks: DataFrame) -> DataFrame:
    """Alignment of a block ``(x0, x1)`` in its cell ``(cx0, cx1)`` and the box it may grow into."""
    a, b = F.col("cx0") + PAD, F.col("cx1") - PAD
    left, right = F.col("x0") - a, b - F.col("x1")
    tolerance = F.greatest(F.lit(2.0), 0.05 * (b - a))
    align = F.when(F.abs(left - right) <= tolerance, "center").when(right + tolerance < left, "right").otherwise("left")
    narrow = b - a < 4
    blocks = blocks.withColumn("align", F.when(narrow, "left").otherwise(align))
    x0 = F.when(narrow, F.col("x0")).when(F.col("align") == "left", F.col("x0")).otherwise(F.least(a, F.col("x0")))
    x1 = F.when(narrow, F.col("x1")).when(F.col("align") == "right", F.col("x1")).otherwise(F.greatest(b, F.col("x1")))
    return blocks.withColumn("tx0", x0).withColumn("tx1", x1)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _style(order: Column) -> list[Column]:
    """The style of the first visible span in an order."""
    first = F.min_by(F.struct("font", "size", "color", "flags"), F.when(F.col("host"), order))
    return [first.alias("_s")]


def _told(blocks: DataFrame, *columns: str) -> DataFrame:
    flag = lambda n, name: (F.col("_s.flags").bitwiseAND(n) != 0).alias(name)
    return blocks.select(*columns, *(F.col(f"_s.{c}").alias(c) for c in ("font", "size", "color")), flag(16, "bold"), flag(2, "italic"))


def text_blocks(spans: DataFrame) -> DataFrame:
    """One row per block (page): its lines stripped and joined, its box, and the style of the first visible span."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "span_text"))), lambda x: x["span_text"]), "")
    box = lambda: [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    # A line's first style goes along, so that spans are read and shuffled once.
    per_line = spans.groupBy("doc_id", "page_no", "line_no").agg(_stripped(text).alias("t"), F.bool_or("host").alias("host"), *_style(F.col("span_no")), *box())
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("line_no", "t")))), lambda x: x["t"]), " ")
    first = F.min_by("_s", F.when(F.col("host"), F.col("line_no"))).alias("_s")
    blocks = per_line.groupBy("doc_id", "page_no").agg(lines.alias("block_text"), first, *box()).where("block_text <> ''")
    return _told(blocks, "doc_id", "page_no", "block_text", "x0", "y0", "x1", "y1")


def _runs(items: Column, gap: float = 2.0) -> Column:
    """Items of one row in the order of ``x0``, cut where the gap to the one before exceeds ``gap`` sizes."""

    def cut(it: Column) -> Column:
        opens = lambda k: (k == 1) | (F.get(it, k - 1)["x0"] - F.get(it, k - 2)["x1"] > gap * F.greatest(F.get(it, k - 1)["size"], F.lit(1.0)))
        begins = F.filter(F.sequence(F.lit(1), F.size(it)), opens)
        return bound(begins, lambda at: F.transform(at, lambda k, r: F.slice(it, k, F.coalesce(F.get(at, r + 1), F.size(it) + 1) - k)))

    return bound(F.array_sort(items), cut)


def cell_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of the pages that fall into cells: one a cell, or one a run where a cell has a single row.

    ``pages`` as ``cell_assign`` takes them. A page is split only if every
    visible span lies in a cell. In a cell of several rows the gaps are line
    breaks, so it is one block; a single row falls into runs, and the cell is
    cut at the middle of the gaps between them. A block has its spans' texts,
    stripped, with blanks between, a box that is tight around them, the first
    span's style, and where it may be set: its part of the cell, by alignment.

    A page is done in its row, and what a lambda uses is a column of it or bound.
    """
    page, cell = ["doc_id", "page_no"], ["doc_id", "page_no", "cell_no"]
    fields = ("x0", "span_no", "line_no", "y0", "x1", "y1", "size", "span_text", "font", "color", "flags")
    seen = F.transform(F.filter("spans", lambda s: s["host"]), lambda s: F.struct(*(s[c].alias(c) for c in fields), _cell_of(s, F.col("cells")).alias("cell_no")))

    def of_cells(items: Column) -> Column:
        parts = F.transform("cells", lambda c: F.struct(c["cell_no"].alias("cell_no"), c["x0"].alias("x0"), c["x1"].alias("x1"), F.filter(items, lambda s: s["cell_no"] == c["cell_no"]).alias("items")))
        return F.when(F.forall(items, lambda s: s["cell_no"] >= 0), F.filter(parts, lambda p: F.size(p["items"]) > 0))

    cells = pages.select(*page, F.explode(bound(seen, of_cells)).alias("c")).select(*page, "c.*")
    # A single row: all spans join the one that the topmost opens, as in ``visual_lines``.
    single = bound(F.array_min("items.y0"), lambda top: F.forall("items", lambda s: F.abs(top - s["y0"]) <= 0.6 * F.greatest(s["size"], F.lit(1.0))))

    def block(run: Column) -> Column:
        order = lambda s: F.when(F.col("single"), s["x0"]).otherwise(F.lit(0.0)).alias("o")
        ordered = F.array_sort(F.transform(run, lambda s: F.struct(order(s), *(s[c].alias(c) for c in ("line_no", "span_no", "span_text", "font", "size", "color", "flags")))))
        text = lambda it: F.array_join(F.transform(it, lambda s: _stripped(s["span_text"])), " ")
        style = lambda it: F.struct(*(F.get(it, F.lit(0))[c].alias(c) for c in ("font", "size", "color", "flags")))
        box = [f(run[c]).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
        return bound(ordered, lambda it: F.struct(text(it).alias("block_text"), style(it).alias("_s"), *box))

    # Blocks come out of an explode, and so are worked out once; then each sees its neighbours.
    runs = F.when(F.col("single"), _runs(F.col("items"))).otherwise(F.array("items"))
    lined = lambda b: F.transform(b, lambda x, n: F.struct(n.cast("long").alias("run_no"), x.alias("b"), F.get(b, n - 1)["x1"].alias("before"), F.get(b, n + 1)["x0"].alias("behind")))
    told = cells.withColumn("single", single).select(*cell, F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.explode(bound(F.transform(runs, block), lined)).alias("r"))
    blocks = told.select(*cell, "r.run_no", "r.b.*", F.coalesce((F.col("r.before") + F.col("r.b.x0")) / 2, "_x0").alias("cx0"), F.coalesce((F.col("r.b.x1") + F.col("r.behind")) / 2, "_x1").alias("cx1"))
    return _told(cell_align(blocks), *cell, "run_no", "block_text", "x0", "y0", "x1", "y1", "align", "tx0", "tx1")


def visual_lines(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Rows of spans per page: a span joins the first row whose first span is within 0.6 of its size, else opens one.

    A fold over the spans of one page (or of the given keys), which are few; returns ``row_no`` per span.
    """
    item = F.struct("y0", "x0", "line_no", "span_no", "size")
    pages = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<double>").alias("anchors"), F.array().cast("array<struct<line_no:int,span_no:int,row_no:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        near = F.transform(acc["anchors"], lambda a: F.abs(a - s["y0"]) <= 0.6 * F.greatest(s["size"], F.lit(1.0)))
        at = F.array_position(near, True).cast("int")
        row = F.when(at > 0, at - 1).otherwise(F.size(acc["anchors"]))
        anchors = F.when(at > 0, acc["anchors"]).otherwise(F.concat(acc["anchors"], F.array(s["y0"])))
        placed = F.struct(s["line_no"].cast("int").alias("line_no"), s["span_no"].cast("int").alias("span_no"), row.cast("int").alias("row_no"))
        return F.struct(anchors.alias("anchors"), F.concat(acc["out"], F.array(placed)).alias("out"))

    folded = pages.select(*keys, F.aggregate("items", start, step)["out"].alias("out"))
    return folded.select(*keys, F.inline("out"))


def table_rectangularise(rows: DataFrame) -> DataFrame:
    """Rows ``(table_id, row_no, cells)`` padded to their table's width, cells stripped, empty tables dropped."""
    clean = F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    table = Window.partitionBy("table_id")
    wide = rows.withColumn("cells", clean).withColumn("_w", F.max(F.size("cells")).over(table)).withColumn("_some", F.bool_or(F.exists("cells", lambda c: c != "")).over(table))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells")))
    return wide.where("_some").select("table_id", "row_no", padded.alias("cells"))


def content_items(prose: DataFrame, tables: DataFrame) -> DataFrame:
    """Prose and tables of a page in reading order."""
    both = prose.select("doc_id", "page_no", F.lit("text").alias("kind"), "x0", "y0").unionByName(tables.select("doc_id", "page_no", F.lit("table").alias("kind"), "x0", "y0"))
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.bround("y0", 1), "x0", "kind")
    return both.withColumn("item_no", F.row_number().over(order) - 1)


def content_to_csv(items: DataFrame) -> DataFrame:
    """Lines of a CSV: a text item is a one-column row, a table row stays one, pages from the second on have a header.

    ``items (doc_id, page_no, item_no, cells)``; the result has the global order in ``row_no``.
    """
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    body = items.select("doc_id", "page_no", "item_no", F.array_join(quoted, ",").alias("csv_line"))
    heads = items.where("page_no > 0").select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(-1).alias("item_no"), F.concat(F.lit("--- page "), (F.col("page_no") + 1).cast("string"), F.lit(" ---")).alias("csv_line"))
    order = Window.partitionBy("doc_id").orderBy("page_no", "item_no")
    return body.unionByName(heads).select("doc_id", (F.row_number().over(order) - 1).alias("row_no"), "csv_line")


def collapse_excess_regions(pages: DataFrame, most: int = 200) -> DataFrame:
    """Pages with too many boxes get one enclosing ``rep`` box; the rest keep theirs, numbered by (y, x).

    ``pages (doc_id, page_no, boxes)``, a box being ``(x0, y0, x1, y1, kind)``; a page is done in its row.
    """
    order = ("y0", "x0", "x1", "y1")
    side = lambda f, c: f(F.transform("boxes", lambda b: b[c])).alias(c)
    one = F.struct(side(F.array_min, "y0"), side(F.array_min, "x0"), side(F.array_max, "x1"), side(F.array_max, "y1"), F.lit("rep").alias("kind"))
    few = F.array_sort(F.transform("boxes", lambda b: F.struct(*(b[c].alias(c) for c in (*order, "kind")))))
    told = pages.select("doc_id", "page_no", F.posexplode(F.when(F.size("boxes") > most, F.array(one)).otherwise(few)).alias("box_no", "b"))
    return told.select("doc_id", "page_no", *(F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "kind")), "box_no")


def region_kind(regions: DataFrame, sensitivity: str = "normal") -> DataFrame:
    """Kinds of changed regions ``(region, removed, added)``: replaced, inserted, deleted; small ones are dropped."""
    least = SENSITIVITY[sensitivity]
    sums = regions.groupBy("region").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added")).where(F.col("removed") + F.col("added") >= least)
    kind = F.when((F.col("removed") >= least) & (F.col("added") >= least), "rep").when(F.col("added") > F.col("removed"), "ins").otherwise("del")
    return sums.withColumn("kind", kind)
