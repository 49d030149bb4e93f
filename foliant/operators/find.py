"""Find and replace across a corpus, judged on lines and carried out on spans."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, offsets, places, sums_before
from ..sources.corpus import LINES_PER_PAGE, span_array


def _folding() -> tuple[str, str]:
    """Letters that decompose into one base and marks, with their bases, and đ; behind them the marks alone, which go."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x2000))}
    pairs = {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))} | {"đ": "d", "Đ": "D"}
    marks = [chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i))]
    return "".join([*pairs, *marks]), "".join(pairs.values())


#: Letters with marks, and what they fold to.
MARKED, PLAIN = _folding()


def fold_text(text: Column) -> Column:
    """Lower case without accents: one character for one, but marks that stand alone go."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def folded(text: str) -> str:
    """The same for a text at hand."""
    return text.lower().translate(str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :]))


def _pattern(query: str, whole_word: bool) -> str:
    quoted = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    return rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if whole_word else quoted


class Search:
    """A query against lines: which lines hold it, and where.

    Matches are leftmost, do not overlap and are half-open. Without
    ``match_case`` both sides are lowered where that keeps the length of both;
    otherwise the match is exact. A whole word has no letter, digit or
    underscore beside it.
    """

    def __init__(self, query: str, match_case: bool = False, whole_word: bool = False):
        if not query:
            raise ValueError("the query is empty")
        low = query.lower() if len(query.lower()) == len(query) else query
        self.length, self.query, self.low = len(query), query, low
        self.folds = not match_case and len(query.lower()) == len(query)
        self.exact, self.loose = _pattern(query, whole_word), _pattern(low, whole_word)

    def _fold(self, line: Column) -> Column:
        return F.lit(self.folds) & (F.length(F.lower(line)) == F.length(line))

    def holds(self, line: Column) -> Column:
        """Whether the line may hold a match; a cheap test that scans can do first."""
        return F.when(self._fold(line), F.contains(F.lower(line), F.lit(self.low))).otherwise(F.contains(line, F.lit(self.query)))

    def cuts(self, line: Column) -> Column:
        """What stands between the matches: one text more than there are matches."""
        return F.when(self._fold(line), F.split(F.lower(line), self.loose, -1)).otherwise(F.split(line, self.exact, -1))

    def starts(self, line: Column) -> Column:
        """Where the matches begin, from 0: where the rest behind each does, less the matches before it."""
        return bound(self.cuts(line), lambda c: F.transform(F.slice(offsets(c), F.lit(2), F.size(c) - 1), lambda gap, k: gap + k * self.length))


def find_occurrences(lines: DataFrame, query: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """``(doc_id, page_no, line_no, line_text, hit_no, start, stop)``: the matches of ``Search`` on each line."""
    search = Search(query, match_case, whole_word)
    found = lines.where(search.holds(F.col("line_text"))).select("doc_id", "page_no", "line_no", "line_text", F.posexplode_outer(search.starts(F.col("line_text"))).alias("hit_no", "start"))
    return found.where("start is not null").withColumn("stop", F.col("start") + search.length)


def scanned_lines(docs: DataFrame, query: str, max_hits: int, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Lines as ``corpus.explode_lines`` gives them, up to where a scan for ``max_hits`` matches a document stops.

    ``left`` tells how many matches of a line the scan still takes, and
    ``truncated_page`` the page, from 1, on which it stopped (0: nowhere). The
    running count is made in the document's own row, so lines behind the stop
    are never put out and nothing is shuffled. A line that shows nothing is not
    scanned.
    """
    search = Search(query, match_case, whole_word)
    number = lambda line: F.when(search.holds(line) & line.rlike(r"\S"), F.size(search.cuts(line)) - 1).otherwise(F.lit(0)).cast("long")
    counted = bound(F.split("text", "\n", -1), lambda t: bound(F.transform(t, number), lambda n: F.arrays_zip(t.alias("line_text"), n.alias("n"), sums_before(n).alias("before"))))
    over = F.filter("_lines", lambda x: x["before"] + x["n"] > max_hits)
    own = docs.where("text is not null").select("doc_id", counted.alias("_lines")).withColumn("_n", F.size("_lines") - F.size(over))
    # The line that goes over the limit is the last one scanned.
    stop = F.when(F.size("_lines") > F.col("_n"), F.floor(F.col("_n") / LINES_PER_PAGE).cast("int") + 1).otherwise(F.lit(0))
    lines = own.select("doc_id", stop.alias("truncated_page"), F.posexplode_outer(F.slice("_lines", F.lit(1), F.col("_n") + 1)).alias("line_no", "x"))
    return lines.select(
        "doc_id",
        "line_no",
        "x.line_text",
        F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no"),
        (F.col("line_no") % LINES_PER_PAGE).alias("line_in_page"),
        (max_hits - F.col("x.before")).alias("left"),
        "truncated_page",
    )


def _placed(lines: DataFrame, search: Search) -> DataFrame:
    """The lines of ``corpus.line_spans`` that may hold a match, with its matches placed on spans in an array ``hits``.

    Nothing filters by ``hits`` before it is exploded: such a filter would be
    pushed down to the lines and work all of it out a second time.
    """
    return _with_hits(lines.where(search.holds(F.col("line_text"))), search)


def _with_hits(lines: DataFrame, search: Search) -> DataFrame:
    """The lines with ``hits``, null where ``spans`` are.

    Both starts and span edges ascend, so each match finds its first and last
    span by their places among the edges, within the row. With a column
    ``left``, so many matches of a line are taken.
    """
    text = F.col("line_text")
    starts = search.starts(text)
    if "left" in lines.columns:
        starts = F.slice(starts, F.lit(1), F.greatest("left", F.lit(0)).cast("int"))
    seen = lines.withColumn("_starts", F.when(F.col("spans").isNotNull(), starts))
    ends = F.transform("spans", lambda s: s["off"] + F.length(s["span_text"]))
    begins = F.transform("spans", lambda s: s["off"])
    stops = F.transform("_starts", lambda x: x + search.length)
    edges = F.arrays_zip(F.col("_starts").alias("start"), stops.alias("stop"), places(ends, F.col("_starts"), True).alias("i"), places(begins, stops, False).alias("j"))

    def hit(e: Column, touched: Column) -> Column:
        first = F.get(touched, F.lit(0))
        alone = (F.size(touched) == 1) & first["host"]
        edge = lambda pick, c: F.when(F.size(touched) == 1, first[c]).otherwise(pick(F.transform(touched, lambda s: s[c])))
        return F.struct(
            e["start"].alias("start"),
            e["stop"].alias("stop"),
            first["span_no"].alias("span_no"),
            alone.alias("replaceable"),
            F.when(alone, e["start"] - first["off"]).otherwise(F.lit(0)).alias("span_start"),
            F.when(alone, e["stop"] - first["off"]).otherwise(F.length(text)).alias("span_stop"),
            F.when(alone, first["span_text"]).otherwise(text).alias("span_text"),
            edge(F.array_min, "x0").alias("x0"),
            edge(F.array_min, "y0").alias("y0"),
            edge(F.array_max, "x1").alias("x1"),
            edge(F.array_max, "y1").alias("y1"),
        )

    placed = F.transform(edges, lambda e: F.when(e["j"] > e["i"], bound(F.slice("spans", e["i"] + 1, e["j"] - e["i"]), lambda t: hit(e, t))))
    return seen.withColumn("hits", placed).drop("_starts")


def find_hits(lines: DataFrame, query: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Occurrences on the joined lines of ``corpus.line_spans``, placed on spans: one row a hit, nothing shuffled.

    A hit that touches one span that shows something is replaceable, with
    offsets in that span. Any other crosses: its offsets are those of the whole
    line, its box the union of what it touches. One that touches no span is none.
    """
    placed = _placed(lines, Search(query, match_case, whole_word))
    return placed.select("doc_id", "page_no", "line_no", F.posexplode_outer("hits").alias("hit_no", "h")).where("h is not null").select("doc_id", "page_no", "line_no", "hit_no", "h.*")


def reading_order(hits: DataFrame) -> DataFrame:
    """Add ``id``: the hit's place in its document by page, line position and start."""
    order = Window.partitionBy("doc_id").orderBy("page_no", F.bround("y0", 1), F.bround("x0", 1), "start", "line_no", "hit_no")
    return hits.withColumn("id", F.row_number().over(order) - 1)


def find_capped(hits: DataFrame, max_hits: int) -> DataFrame:
    """The first ``max_hits`` of each document in scan order; ``truncated_page`` tells, from 1, where the rest began (0: nowhere)."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no", "hit_no")
    ranked = hits.withColumn("_k", F.row_number().over(order))
    over = F.max(F.when(F.col("_k") == max_hits + 1, F.col("page_no") + 1)).over(Window.partitionBy("doc_id"))
    return ranked.withColumn("truncated_page", F.coalesce(over, F.lit(0))).where(F.col("_k") <= max_hits).drop("_k")


def find_summary(hits: DataFrame, scanned: DataFrame) -> DataFrame:
    """Per document: hits, crossing and replaceable ones, pages with hits, pages scanned, and whether there is any text.

    ``scanned (doc_id, pages_scanned, has_text)`` has every document, also those without hits.
    """
    found = hits.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("replaceable")).alias("crossing"), F.count_if("replaceable").alias("replaceable"), F.countDistinct("page_no").alias("pages")
    )
    return scanned.select("doc_id", "pages_scanned", "has_text").join(found, "doc_id", "left").fillna(0, ["total", "crossing", "replaceable", "pages"])


def _splice(text: Column, edits: Column, replacement: str) -> Column:
    """All edits of a span at once, from its right end, each against the original offsets."""
    backwards = F.reverse(edits)
    cut = lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["a"]), F.lit(replacement), F.substring(acc, e["b"] + 1, F.length(acc)))
    return F.aggregate(backwards, text, cut)


def replace_all(lines: DataFrame, query: str, replacement: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """``(doc_id, line_no, new_text, edited, locked)`` of the lines with hits: replaceable hits replaced, crossing ones counted.

    ``lines`` as ``corpus.line_spans`` gives them; over ``scanned_lines`` only
    the scanned part is replaced, and ``truncated_page`` tells where the scan
    stopped. All edits of a line are made at once, against the offsets that the
    hits had: what stands before each hit, then the hit or its replacement, and
    the rest of the line.
    """
    more = [c for c in ("truncated_page",) if c in lines.columns]
    placed = _placed(lines, Search(query, match_case, whole_word))
    line, size = F.col("line_text"), F.length("line_text")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_hits", lambda h: h["stop"]))
    piece = lambda a, b: F.substring(line, a.cast("int") + 1, (b - a).cast("int"))
    told = F.zip_with("_hits", F.slice(begins, F.lit(1), F.size("_hits")), lambda h, a: F.concat(piece(a, h["start"]), F.when(h["replaceable"], F.lit(replacement)).otherwise(piece(h["start"], h["stop"]))))
    rest = piece(F.try_element_at("_hits", F.lit(-1))["stop"], size)
    found = placed.withColumn("_hits", F.filter("hits", lambda h: h.isNotNull()))
    edited = F.size(F.filter("_hits", lambda h: h["replaceable"])).cast("long")
    done = F.when(F.size("_hits") > 0, F.struct(F.concat(F.array_join(told, ""), rest).alias("new_text"), edited.alias("edited"), (F.size("_hits") - edited).alias("locked")))
    # Behind the explode the filter stays where it is.
    return found.select("doc_id", "line_no", F.explode_outer(F.array(done)).alias("x"), *more).where("x is not null").select("doc_id", "line_no", "x.*", *more)


def redact_matches(lines: DataFrame, query: str, mask: str = "█", match_case: bool = False) -> DataFrame:
    """``(doc_id, line_no, new_text)`` of the lines with hits, each hit covered by a mask of its length."""
    edit = F.struct(F.col("start").cast("int").alias("a"), F.col("stop").cast("int").alias("b"))
    found = find_occurrences(lines, query, match_case).groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(edit)).alias("edits"), F.first("line_text").alias("line_text"))
    return found.select("doc_id", "line_no", _splice(F.col("line_text"), F.col("edits"), mask * len(query)).alias("new_text"))


def folded_search(docs: DataFrame, query: str) -> DataFrame:
    """``(doc_id, n_hits, first_at, first_fraction)`` of the documents that hold the query, accents and case aside; places are those in the folded text."""
    needle = folded(query)
    hay = docs.select("doc_id", fold_text(F.col("text")).alias("_t")).where(F.contains("_t", F.lit(needle)))
    first = F.instr("_t", needle) - 1
    count = F.size(F.split("_t", r"\Q" + needle + r"\E", -1)) - 1
    return hay.select("doc_id", count.alias("n_hits"), first.alias("first_at"), (first / F.length("_t")).alias("first_fraction"))


def find_audit(lines: DataFrame, query: str) -> DataFrame:
    """Per page: matches in its raw text, in spans, across spans, and with all white space taken out.

    ``lines`` as ``corpus.explode_lines`` gives them; they are read once, and
    one exchange brings a page's together.
    """
    search, low = Search(query), query.lower()
    squeezed = re.sub(r"\s+", "", low)
    count = lambda c, text: F.size(F.split(c, r"\Q" + text + r"\E", -1)) - 1
    text = F.col("line_text")
    marked = _with_hits(lines.withColumn("spans", F.when(search.holds(text) & text.rlike(r"\S"), span_array())), search)
    n, alone = (F.greatest(F.size(F.filter("hits", which)), F.lit(0)) for which in (lambda h: h.isNotNull(), lambda h: h["replaceable"]))
    told = marked.select("doc_id", "page_no", F.struct("line_no", text.alias("t")).alias("line"), count(F.lower("line_text"), low).alias("raw"), alone.alias("in_span"), (n - alone).alias("crossing"))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["t"]), "")
    pages = told.groupBy("doc_id", "page_no").agg(*(F.sum(c).alias(c) for c in ("raw", "in_span", "crossing")), packed.alias("_p"))
    pages = pages.select("doc_id", "page_no", "raw", count(F.regexp_replace(F.lower("_p"), r"\s+", ""), squeezed).alias("no_space"), "in_span", "crossing")
    found = F.col("in_span") + F.col("crossing")
    return pages.withColumn("flagged", (F.col("raw") > found) | (F.col("no_space") > found))
