"""Literal cases of the find, layout, manifest, compare and masking rules, and their invariants."""

import bisect
import csv
import difflib
import random

import duckdb
import numpy as np
import pytest
from oracle_compare import same
from pyspark.sql import functions as F

from foliant.functions.arrays import places
from foliant.operators import compare, extract, find, licence, manifest, quality
from foliant.operators import layout as lay
from foliant.plans import compare_queries, layout_queries
from foliant.sources import corpus, sinks
from foliant.streaming import streams


def line_of(spark, *lines):
    """Lines given as lists of span texts, one page per four lines."""
    spans, joined = [], []
    for n, parts in enumerate(lines):
        off = 0
        for k, t in enumerate(parts):
            spans.append((1, n // 4, n, k, t, bool(t.strip()), off, 5.0 * off, 100.0, 5.0 * off + max(1, 5 * len(t)), 112.0))
            off += len(t)
        joined.append((1, n, "".join(parts), n // 4, n % 4))
    return (
        spark.createDataFrame(joined, "doc_id long, line_no int, line_text string, page_no int, line_in_page int"),
        spark.createDataFrame(spans, "doc_id long, page_no int, line_no int, span_no int, span_text string, host boolean, off int, x0 double, y0 double, x1 double, y1 double"),
    )


@pytest.mark.parametrize(
    ("lines", "query", "flags", "expected"),
    [
        ([["Hop", " ", "dong so 5"]], "Hop dong", {}, [(False, 0, 13)]),
        ([["Hop", " ", "dong so 5"]], "dong", {}, [(True, 0, 4)]),
        ([["Ngay 202", "6"]], "2026", {}, [(False, 0, 9)]),
        ([["Bên ", "A"]], "Bên A", {}, [(False, 0, 5)]),
        ([["12"], ["34"]], "1234", {}, []),
        ([["AB", "2026"]], "2026", {"whole_word": True}, []),
        ([["AB", "2026"]], "2026", {}, [(True, 0, 4)]),
        ([["Hợp đồng ", "số 5"]], "đồng", {"whole_word": True}, [(True, 4, 8)]),
        ([["2026 va 2026 va 2026"]], "2026", {}, [(True, 0, 4), (True, 8, 12), (True, 16, 20)]),
        ([["Hop DONG hop dong"]], "hop", {"match_case": True}, [(True, 9, 12)]),
        ([["Hop DONG hop dong"]], "hop", {}, [(True, 0, 3), (True, 9, 12)]),
        ([["a", "   ", "b"]], " ", {}, [(False, 0, 5)] * 3),
        ([["İstanbul hop"]], "hop", {}, [(True, 9, 12)]),
        ([["Ben ben BENH ben."]], "ben", {}, [(True, 0, 3), (True, 4, 7), (True, 8, 11), (True, 13, 16)]),
        ([["Ben ben BENH ben."]], "ben", {"match_case": True}, [(True, 4, 7), (True, 13, 16)]),
        ([["Ben ben BENH ben."]], "ben", {"whole_word": True}, [(True, 0, 3), (True, 4, 7), (True, 13, 16)]),
        ([["a.*b a.*b"]], "a.*b", {}, [(True, 0, 4), (True, 5, 9)]),
    ],
)
def test_find(spark, lines, query, flags, expected):
    hits = find.find_hits(corpus.nest_spans(*line_of(spark, *lines)), query, **flags).orderBy("line_no", "hit_no").collect()
    assert [(h.replaceable, h.span_start, h.span_stop) for h in hits] == expected


def test_find_cap(spark):
    lines, spans = line_of(spark, ["2026 2026 2026"], [""], [""], [""], ["2026 2026"])
    hits = find.find_hits(corpus.nest_spans(lines, spans), "2026")
    assert [r.truncated_page for r in find.find_capped(hits, 2).collect()] == [1, 1]
    assert [r.truncated_page for r in find.find_capped(hits, 99).collect()] == [0] * 5


@pytest.mark.parametrize(("new", "want"), [("year", "year va year va year"), ("", " va  va "), ("2", "2 va 2 va 2")])
def test_replace(spark, new, want):
    done = find.replace_all(corpus.nest_spans(*line_of(spark, ["2026 va 2026 va 2026"])), "2026", new).collect()
    assert [(r.new_text, r.edited, r.locked) for r in done] == [(want, 3, 0)]


def test_empty_query(spark):
    with pytest.raises(ValueError):
        find.find_occurrences(line_of(spark, ["x"])[0], "")


def test_spans_cover_lines(spark, sf):
    lines = corpus.explode_lines(corpus.table(spark, sf, "documents"))
    joined = corpus.explode_spans(lines).groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "span_text"))), lambda x: x["span_text"]), "").alias("t"))
    assert joined.join(lines, ["doc_id", "line_no"]).where("t <> line_text").isEmpty()


@pytest.mark.parametrize(
    ("spec", "n", "dialect", "want"),
    [
        ("1-3,5,8-10", 10, "server", [(0, 2), (4, 4), (7, 9)]),
        ("3-1", 10, "server", [(0, 2)]),
        ("8-20", 10, "server", [(7, 9)]),
        ("0", 10, "server", [(0, 0)]),
        ("a,,2", 10, "server", [(1, 1)]),
        ("", 10, "server", []),
        ("1;3", 10, "client", [(0, 0), (2, 2)]),
        ("2–4", 10, "client", [(1, 3)]),
        ("1;3", 10, "server", []),
        ("-3,3-", 10, "client", []),
    ],
)
def test_page_ranges(spark, spec, n, dialect, want):
    df = spark.createDataFrame([(1, spec, n)], "doc_id long, spec string, n_pages int")
    assert [(r.first, r.last) for r in manifest.page_ranges(df, dialect).orderBy("ord").collect()] == want


def test_page_labels(spark):
    pages = spark.createDataFrame([(1, i) for i in range(5)], "doc_id long, page_no int")
    label = lambda f: [r.label for r in manifest.page_labels(pages, f).orderBy("page_no").collect()][1]
    assert (label("n_of_n"), label("dash_n"), label("odd")) == ("2 / 5", "- 2 -", "2")


def test_masking(spark):
    text = "Total 1.234,56 on 10/03/2026 to a@b.com end"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "⟦9⟧ stays"), (4, "1⟦0⟧2")], "doc_id long, text string")
    masked = quality.mask_corpus(df)
    assert [len(r.terms) for r in masked.orderBy("doc_id").collect()] == [3, 0, 1, 3]
    back = dict(quality.unmask_corpus(masked.where("doc_id <= 2")).collect())
    assert back == {1: text, 2: ""}


@pytest.mark.parametrize(("text", "font", "suspect"), [("", ".VnArial", False), ("Hello", ".VnArial", False), ("привет", "Arial", True), ("µ®", ".VnArial", True), ("a\x03", "Arial", True), ("a\tb", "Arial", False), ("é", "Arial", False)])
def test_triage(spark, text, font, suspect):
    df = spark.createDataFrame([("s", text, font)], "source string, span_text string, font string")
    assert (quality.encoding_triage(df).count() == 1) is suspect


def test_repair(spark):
    df = spark.createDataFrame([("s", "µ®", ".VnArial")], "source string, span_text string, font string")
    assert [(r.repaired, r.accepted) for r in quality.legacy_repair(df).collect()] == [("àđ", True)]
    assert len(quality.TCVN3_FROM) == len(quality.TCVN3_TO) and len(find.MARKED) > len(find.PLAIN)


@pytest.mark.parametrize(("font", "legacy"), [("ABCDEF+.VnTime", True), ("ABCDEF+VNI-Times", True), ("ABCDEFG+.VnTime", False), ("VNTIME+Arial", False), (".TCVN3Font-Bold", True), (None, False), ("Arial", False)])
def test_triage_of_subset_fonts(spark, font, legacy):
    df = spark.createDataFrame([("s", "µ®", font)], "source string, span_text string, font string")
    assert (quality.encoding_triage(df).count() == 1) is legacy


def test_folding(spark):
    """As NFD does it: letters with marks lose them, marks that stand alone go, others stay."""
    text = "Čaşa Ő ł đường e\u0301tait"
    assert find.folded(text) == "casa o ł duong etait"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for query, at in (("caşa", 0), ("Duong", 9), ("était", 15), ("ł", 7)):
        (r,) = find.folded_search(df, query).collect()
        assert (r.n_hits, r.first_at, r.first_fraction) == (1, at, at / 20)


def plain_alignment(sim):
    n, m = len(sim), len(sim[0])
    best = [[0.25 * (i + j) for j in range(m + 1)] for i in range(n + 1)]
    path = [[[] for _ in range(m + 1)] for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [(best[i - 1][j - 1] + sim[i - 1][j - 1], 0), (best[i - 1][j] + 0.25, 1), (best[i][j - 1] + 0.25, 2)]
            top = max(s for s, _ in options)
            way = next(k for s, k in options if s == top)
            best[i][j] = top
            path[i][j] = [path[i - 1][j - 1] + [(i - 1, j - 1)], path[i - 1][j], path[i][j - 1]][way]
    return path[n][m]


def test_page_align(spark):
    rng = random.Random(3)
    grids = {0: [[0.9, 0.1, 0.1], [0.1, 0.2, 0.8]]} | {k: [[rng.choice([0.1, 0.4, 0.5, 0.6, 0.9]) for _ in range(rng.randint(1, 5))]] for k in range(1, 4)}
    for k in range(4, 30):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        grids[k] = [[rng.choice([0.1, 0.4, 0.5, 0.75, 1.0]) for _ in range(m)] for _ in range(n)]
    rows = [(k, i, j, s) for k, g in grids.items() for i, r in enumerate(g) for j, s in enumerate(r)]
    got = {}
    sides = [spark.createDataFrame([(k, i) for k, g in grids.items() for i in range(len(side(g)))], "pair_id long, page_no int") for side in (lambda g: g, lambda g: g[0])]
    for r in compare.page_align(*sides, spark.createDataFrame(rows, "pair_id long, a_page int, b_page int, similarity double")).collect():
        got.setdefault(r.pair_id, []).append((r.a_page, r.b_page))
    assert got[0] == [(0, 0), (1, 2)]
    assert got == {k: p for k, g in grids.items() if (p := plain_alignment(g))}


def test_word_diff_is_a_common_subsequence(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    pairs = compare.version_pairs(docs).limit(40)
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    kept, best = 0, 0
    diff = {}
    words = corpus.word_stream(compare.paired_documents(docs, pairs), keys=("pair_id", "side"))
    for r in compare.word_diff(compare.match_words(words)).orderBy("pair_id", "a").collect():
        diff.setdefault(r.pair_id, []).append((r.a, r.b))
    for p in pairs.collect():
        a, b, d = texts[p.a_doc], texts[p.b_doc], diff.get(p.pair_id, [])
        assert all(a[i] == b[j] for i, j in d)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(d, d[1:], strict=False))
        if a == b:
            assert len(d) == len(a)
        kept += len(d)
        best += sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert kept >= 0.97 * best


def test_box_repair(spark):
    schema = "doc_id long, y0 double, y1 double, origin_y double, size double, asc double, desc double"
    rows = [(1, 0.0, 12.0, 9.0, 11.0, 0.9, -0.2), (2, 9.0, 21.0, 9.0, 11.0, 0.8, -0.2), (3, 9.0, 11.0, 9.0, 11.0, 0.8, -0.2)]
    got = {r.doc_id: (r.touched, r.y0, r.y1) for r in lay.normalise_boxes(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (False, 0.0, 12.0) and got[3] == (False, 9.0, 11.0)
    assert got[2] == (True, pytest.approx(9 - 0.9 * 11), pytest.approx(9 + 0.25 * 11))


def test_visual_lines_use_the_first_span(spark):
    rows = [(1, 0, 0, 0, 10.0, 0.0, 10.0), (1, 0, 0, 1, 15.0, 5.0, 10.0), (1, 0, 0, 2, 20.0, 9.0, 10.0)]
    got = lay.visual_lines(spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, span_no int, y0 double, x0 double, size double")).orderBy("span_no").collect()
    assert [r.row_no for r in got] == [0, 0, 1]


def test_regions_of_a_page_in_its_row(spark):
    """Few boxes are numbered, many give one; nothing is shuffled, and of the boxes no task holds more than a page; F13."""
    box = "x0 double, y0 double, x1 double, y1 double, kind string"
    rows = [(1, 0, [(5.0, 1.0, 6.0, 2.0, "ins"), (0.0, 1.0, 9.0, 2.0, "del"), (7.0, 0.0, 8.0, 1.0, "ins")]), (1, 1, [(float(i), 3.0 - i, 10.0 - i, 20.0 + i, "ins") for i in range(4)]), (2, 0, [])]
    got = lay.collapse_excess_regions(spark.createDataFrame(rows, f"doc_id long, page_no int, boxes array<struct<{box.replace(' ', ':').replace(',:', ',')}>>"), 3)
    assert sorted((r.page_no, r.box_no, r.x0, r.y0, r.x1, r.y1, r.kind) for r in got.collect()) == [(0, 0, 7.0, 0.0, 8.0, 1.0, "ins"), (0, 1, 0.0, 1.0, 9.0, 2.0, "del"), (0, 2, 5.0, 1.0, 6.0, 2.0, "ins"), (1, 0, 0.0, 0.0, 10.0, 23.0, "rep")]
    plan = layout_queries.collapse_excess_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_spans_of_pages(spark):
    """The same spans as one by one, with blank lines, lines that show nothing and many spans a line."""
    texts = ["a, b.c\n\n  \nD.E,,f\n., x\n", "", None, "\n\n\n\n", ",".join(map(str, range(600))) + "\n" + "é.Ü. \u2003."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = corpus.explode_spans(corpus.explode_lines(docs))
    nested = corpus.page_spans(docs).select("doc_id", "page_no", F.inline("spans")).select(*rows.columns)
    assert sorted(nested.collect()) == sorted(rows.collect()) and nested.count() > 600


def test_cells_of_a_page_in_its_row(spark):
    """A single row falls into runs, a cell of several rows is one block, a page with a span outside stays whole; nothing is shuffled; F14."""
    span = lambda line, n, text, x0, x1, y0, host=True: (line, n, text, host, x0, x1, y0, y0 + 10.0, 10.0, f"F{n}", n, 16 * (n % 2))
    cells = [(0, 0.0, 0.0, 200.0, 12.0), (1, 0.0, 12.0, 200.0, 60.0), (2, 100.0, 0.0, 200.0, 60.0)]
    rows = [
        (1, 0, [span(0, 2, " c ", 150.0, 160.0, 0.0), span(0, 0, "a", 10.0, 20.0, 1.0), span(0, 1, "b", 40.0, 60.0, 0.0), span(1, 0, "d", 10.0, 20.0, 20.0), span(2, 0, "e ", 5.0, 9.0, 40.0), span(9, 9, " ", 900.0, 901.0, 0.0, False)], cells),
        (1, 1, [span(4, 0, "a", 10.0, 20.0, 1.0), span(4, 1, "b", 400.0, 460.0, 0.0)], cells),
        (2, 0, [], cells),
    ]
    spans = "line_no:int,span_no:int,span_text:string,host:boolean,x0:double,x1:double,y0:double,y1:double,size:double,font:string,color:int,flags:int"
    pages = spark.createDataFrame(rows, f"doc_id long, page_no int, spans array<struct<{spans}>>, cells array<struct<cell_no:int,x0:double,y0:double,x1:double,y1:double>>")
    got = lay.cell_blocks(pages).orderBy("doc_id", "page_no", "cell_no", "run_no").collect()
    assert [(r.cell_no, r.run_no, r.block_text, r.x0, r.y0, r.x1, r.y1, r.font, r.bold) for r in got] == [(0, 0, "a b", 10.0, 0.0, 60.0, 11.0, "F0", False), (0, 1, "c", 150.0, 0.0, 160.0, 10.0, "F2", False), (1, 0, "d e", 5.0, 20.0, 20.0, 50.0, "F0", False)]
    assert [(r.align, r.tx0, r.tx1) for r in got] == [("left", 10.0, 103.0), ("right", 107.0, 160.0), ("left", 5.0, 198.0)]
    assert sorted((r.page_no, r.line_no, r.span_no, r.cell_no) for r in lay.cell_assign(pages).collect()) == [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 2, 0), (0, 1, 0, 1), (0, 2, 0, 1), (0, 9, 9, -1), (1, 4, 0, 0), (1, 4, 1, -1)]
    for query in (layout_queries.cell_blocks, layout_queries.cell_assign):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_sealing(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, page_no int, page_text string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = manifest.protect_pages(pages, pages.where("page_no = 1 or doc_id = 2").select("doc_id", "page_no"), key)
    assert {(r.doc_id, r.page_no): r.page_text for r in sealed.collect()} == {(1, 0): "a", (1, 1): None, (2, 0): "c"}
    kept = sealed.select("doc_id", "page_no", "page_text", "sealed")
    assert {r.page_text for r in manifest.unprotect(kept, key).collect()} == {"a", "b", "c"}
    assert {(r.doc_id, r.page_text) for r in manifest.unprotect(kept, other).collect()} == {(1, "a"), (1, None), (2, "c")}


def test_history(spark):
    rows = [(1, i, 300) for i in range(5)] + [(2, 0, 9999)]
    got = licence.history_trim(spark.createDataFrame(rows, "doc_id long, seq int, n_bytes long"), 3, 700).collect()
    assert {(r.doc_id, r.seq) for r in got} == {(1, 4), (1, 3), (2, 0)}


def test_slugs(spark):
    rows = [(1, 0, "Số hợp đồng"), (1, 1, "so hop dong!"), (1, 2, "***"), (2, 0, "Số hợp đồng")]
    got = [r.key for r in extract.slug_fields(spark.createDataFrame(rows, "group_id long, ord int, label string")).orderBy("group_id", "ord").collect()]
    assert got == ["so_hop_dong", "so_hop_dong_2", "truong", "so_hop_dong"]


def test_state_goes_after_the_watermark(spark, tmp_path):
    """Two runs of a stream: what the watermark has passed comes out once, and entries that have run out leave the store."""
    schema = "event_id long, ts timestamp, user_id long, n_bytes long"
    hour = 3600
    day = lambda rows: spark.createDataFrame(rows, "event_id long, s long, user_id long, n_bytes long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "n_bytes")
    parts = [[(1, 0, 1, 5), (2, 30, 1, 6), (3, 10 * hour, 2, 1)], [(4, 11 * hour, 1, 6), (5, 200 * hour, 3, 1)], [(6, 400 * hour, 3, 2), (7, 900 * hour, 4, 1)]]
    saved, stored = [], []
    for n, rows in enumerate(parts):
        day(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        for name, df, out in (("save", streams.autosave_snapshots(stream), saved), ("ttl", streams.ttl_cache(stream), None)):
            write = lambda b, _, out=out: out.extend(map(tuple, b.collect())) if out is not None else b.count()
            with streams.with_state_store(spark):
                q = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
                q.awaitTermination()
        stored.append(spark.read.format("statestore").option("stateVarName", "stored").load(f"{tmp_path}/ttl").count())
    assert sorted(saved) == [(1, 0, 6), (2, 10 * hour * 10**6, 1), (3, 200 * hour * 10**6, 1), (3, 400 * hour * 10**6, 2)]
    assert stored == [2, 1, 1]


def test_licence_order(spark):
    """Without a value last if ascending, first if descending; equal values go by id."""
    rows = [(1, None), (2, "b"), (3, "a"), (4, "b"), (5, None)]
    df = spark.createDataFrame([(i, v, "active", None, "p", 1) for i, v in rows], "id long, name string, status string, expires timestamp, plan string, max_seats int")
    order = lambda up: [r.id for r in licence.license_search(df, columns=("name",), sort="name", ascending=up).orderBy("position").collect()]
    assert order(True) == [3, 2, 4, 1, 5] and order(False) == [1, 5, 2, 4, 3]


@pytest.mark.parametrize(("spec", "want"), [("99999999999", [(9, 9)]), ("3-99999999999", [(2, 9)]), ("007", [(6, 6)])])
def test_large_page_numbers(spark, spec, want):
    df = spark.createDataFrame([(1, spec, 10)], "doc_id long, spec string, n_pages int")
    assert [(r.first, r.last) for r in manifest.page_ranges(df).collect()] == want


def test_split_refuses_many_parts(spark):
    pages = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(2 + 3 * d)], "doc_id long, page_no int")
    got = [(r.doc_id, r.part_name, r.pages, r.refused) for r in manifest.split_every(pages, 2, most_parts=3).orderBy("doc_id", "part_name").collect()]
    assert got == [(1, "001", 2, False), (1, "002", 2, False), (1, "003", 1, False), (2, None, None, True)]


def test_versions_in_ranges_of_ids(spark):
    """Documents of one first line pair up across the ranges of ids."""
    far = 1 << compare.RANGE_BITS
    docs = spark.createDataFrame([(i, "t\n" + str(i)) for i in (1, 5, far + 2, 5 * far, 5 * far + 1)] + [(7, "other")], "doc_id long, text string")
    assert {(r.a_doc, r.b_doc) for r in compare.version_pairs(docs).collect()} == {(1, 5), (5, far + 2), (far + 2, 5 * far), (5 * far, 5 * far + 1)}


def test_unmatched_pages_of_an_alignment(spark):
    """Two pages against three: the pairs of the best alignment leave the second page of B, as an insertion."""
    sims = [(1, 0, 0, 0.9), (1, 0, 1, 0.1), (1, 0, 2, 0.1), (1, 1, 0, 0.1), (1, 1, 1, 0.2), (1, 1, 2, 0.8)]
    pages = lambda n: spark.createDataFrame([(1, i) for i in range(n)], "pair_id long, page_no int")
    aligned = compare.page_align(pages(2), pages(3), spark.createDataFrame(sims, "pair_id long, a_page int, b_page int, similarity double"))
    assert [(r.kind, r.page_no) for r in compare.unmatched_pages(pages(2), pages(3), aligned).collect()] == [("ins", 1)]


def test_alignment_by_rounded_totals(spark):
    """A similarity below a match by rounding alone is one where the rounded sums are equal; F1, F2, F3."""
    least = 0.5 - 2**-54
    pages = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").cast("int").alias("page_no"))
    sims = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, least)], "pair_id long, a_page int, b_page int, similarity double")
    assert 1.0 + least == 1.5 and least < 0.5
    got = compare.page_align(pages(2), pages(2), sims).collect()
    assert sorted((r.a_page, r.b_page, r.similarity) for r in got) == [(0, 0, 1.0), (1, 1, least)]


def test_alignment_at_its_cap(spark):
    """Pages behind the cap are not read, and the summary tells it."""
    n, m = 420, 410
    a, b = (spark.createDataFrame([(1, i) for i in range(k)] + [(2, 0)], "pair_id long, page_no int") for k in (n, m))
    sims = [(1, i, j, 1.0 if i == j + 3 else 0.6 if i % 7 == j % 5 == 0 else 0.2) for i in range(n) for j in range(max(0, i - 8), min(m, i + 9))]
    aligned = compare.page_align(a, b, spark.createDataFrame(sims, "pair_id long, a_page int, b_page int, similarity double"))
    got = {(r.a_page, r.b_page) for r in aligned.collect()}
    assert {(j + 3, j) for j in range(397)} <= got and max(i for i, _ in got) < 400
    told = {r.pair_id: r for r in compare.align_summary(a, b, aligned).collect()}
    assert (told[1].pages_a, told[1].pages_b, told[1].matched, told[1].only_a, told[1].truncated) == (n, m, len(got), 400 - len(got), True)
    assert (told[2].matched, told[2].only_a, told[2].only_b, told[2].truncated) == (0, 1, 1, False)
    assert {r.page_no for r in compare.unmatched_pages(a, b, aligned).where("pair_id = 1 and kind = 'del'").collect()} == set(range(400)) - {i for i, _ in got}


def test_pruned_similarities(spark, sf):
    """The bounds drop no pair of pages that can match, and half of all before their words are compared."""
    docs = corpus.table(spark, sf, "documents")
    prints = compare.page_fingerprint(corpus.page_texts(compare.paired_documents(docs, compare.version_pairs(docs)), keys=("pair_id", "side"))).cache()
    a, b = (prints.where(F.col("side") == s).drop("side") for s in "ab")
    every = {tuple(r)[:3]: r.similarity for r in compare.page_similarity(a, b).collect()}
    assert {tuple(r)[:3]: r.similarity for r in compare.page_similarity(a, b, least=0.5).collect()} == {k: s for k, s in every.items() if s >= 0.5}
    assert compare.page_candidates(a, b, least=0.5).count() < 0.55 * len(every)


def test_phrasebook_winner(spark):
    """Of entries with one mask the one with the smallest source counts, in whatever order they stand."""
    blocks = spark.createDataFrame([(1, 0, 0, "total 5 items"), (1, 0, 1, "no entry"), (2, 0, 0, None)], "doc_id long, page_no int, block_no int, text string")
    for rows in ([("total 7 items", "A 7"), ("total 9 items", "B 9")], [("total 9 items", "B 9"), ("total 7 items", "A 7")]):
        done = quality.phrasebook_apply(blocks, spark.createDataFrame(rows, "source string, target string"))
        assert sorted((r.doc_id, r.translated, r.missing) for r in done.where("doc_id = 1").collect()) == [(1, "A 5", False), (1, "no entry", True)]
        assert done.count() == 3


def test_phrasebook_on_a_frequent_line(spark):
    """A line that half of all blocks have is dealt into many parts, and every block is translated."""
    blocks = spark.range(20_000).select((F.col("id") % 100).alias("doc_id"), F.lit(0).alias("page_no"), F.col("id").cast("int").alias("block_no"), F.when(F.col("id") % 2 == 0, "the same line").otherwise(F.concat(F.lit("line "), F.chr(F.col("id") % 26 + 97), F.hex("id"))).alias("text"))
    shares = quality.heavy_shares(blocks, F.col("text"))
    assert len(shares) == 1 and max(shares.values()) == pytest.approx(0.5)
    book = spark.createDataFrame([("the same line", "another line")], "source string, target string")
    done = quality.phrasebook_apply(blocks, book)
    assert done.where("translated = 'another line'").count() == 10_000 == done.where("missing").count()
    assert quality.phrasebook_apply(blocks.limit(0), book).count() == 0


def test_answers_parsed_once(spark):
    """Objects give results, other JSON and none fail; an object's first array in its own order counts."""
    raw = spark.createDataFrame([(1, '{"k": 5, "x": [1]}'), (2, "[1]"), (3, "{bad"), (4, None), (5, '```json\n{"k": "a", "z": null}\n```'), (6, "7"), (7, '{"k": 1, "k": 2}')], "id long, answer string")
    got = {r.id: (r.result and (r.result.k, r.result.z), r.failed) for r in extract.parse_responses(raw, "k string, z string").collect()}
    assert got == {1: (("5", None), False), 2: (None, True), 3: (None, True), 4: (None, True), 5: (("a", None), False), 6: (None, True), 7: (None, True)}
    lists = spark.createDataFrame([(1, '{"z": [{"i": 0, "t": "first"}], "a": [{"i": 9, "t": "other"}]}'), (2, '[{"i": 1, "t": "x"}, {"i": 1, "t": "y"}, {"t": "none"}, 3]'), (3, '{"a": {"i": 1}}'), (4, "nothing")], "id long, answer string")
    assert sorted(map(tuple, extract.parse_lists(lists).collect()), key=str) == [(1, 0, "first", False), (2, 1, "y", False), (3, None, None, True), (4, None, None, True)]


def test_one_csv_file(spark, tmp_path):
    """One file with a byte-order mark and one header, read back as it was, also after records were added."""
    rows = [(i, f'a "quoted", word {i}' if i % 3 else None, "line\nbreak" if i % 5 == 0 else "đ", "src") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, note string, text string, _source_file string").repartition(3)
    path = f"{tmp_path}/out.csv"
    labels = {"doc_id": "Document", "note": "Note, all", "text": "Text"}
    sinks.write_csv_file(df, path, labels)
    sinks.write_csv_file(df.limit(5), path, labels)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out.csv"]
    with open(path, encoding="utf-8-sig", newline="") as f:
        header, *got = csv.reader(f)
    assert header == ["Document", "Note, all", "Text", "Source File"] and len(got) == 45
    assert sorted(got[:40], key=lambda r: int(r[0])) == [[str(i), n or "", t, s] for i, n, t, s in rows]
    with pytest.raises(ValueError):
        sinks.write_csv_file(df, path)


def test_failed_reconnaissance(spark):
    pages = spark.createDataFrame([(d, i, "low", ["x"], d == 2) for d in (1, 2) for i in range(8)], "doc_id long, page_no int, relevance string, contains array<string>, failed boolean")
    assert [(r.doc_id, r.n) for r in extract.recon_select(pages).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect()] == [(1, 1), (2, 8)]


def test_places_in_long_arrays(spark):
    """Blocks of an array give the same places as going through it."""
    rng = random.Random(1)
    rows = [(k, sorted(rng.randrange(500) for _ in range(n)), [rng.randrange(-5, 505) for _ in range(40)]) for k, n in enumerate((1, 2, 31, 32, 33, 40, 300, 1025))]
    df = spark.createDataFrame(rows, "k int, held array<bigint>, sought array<bigint>")
    for inclusive, place in ((True, bisect.bisect_right), (False, bisect.bisect_left)):
        got = {r.k: r.p for r in df.select("k", places(F.col("held"), F.col("sought"), inclusive).alias("p")).collect()}
        assert got == {k: [place(held, x) for x in sought] for k, held, sought in rows}


@pytest.mark.parametrize("seed", range(6))
def test_longest_run_of_matches(seed):
    """As long as the longest one, in order on both sides, also where none or all cross."""
    rng = random.Random(seed)
    for n in (0, 1, 2, 7, 40):
        b = rng.sample(range(3 * n + 1), n) if seed else list(range(n))
        kept = compare.increasing(np.arange(n), np.array(b, np.int64)).tolist()
        longest = [1] * n
        for i in range(n):
            longest[i] += max((longest[j] for j in range(i) if b[j] < b[i]), default=0)
        assert len(kept) == max(longest, default=0) and all(i < j and b[i] < b[j] for i, j in zip(kept, kept[1:], strict=False))


def test_moved_words_keep_the_longer_part(spark):
    """A moved passage does not take the rest of the text out of the matches; one side alone has none."""
    a = "a b c d e f g h i j".split()
    b = "h i j a b c d e f g x".split()
    rows = [(1, "a", i, w, 0) for i, w in enumerate(a)] + [(1, "b", i, w, 0) for i, w in enumerate(b)] + [(2, "a", i, w, 0) for i, w in enumerate(a)]
    marked = compare.match_words(spark.createDataFrame(rows, "pair_id long, side string, pos int, word string, page_no int"))
    assert [(r.a, r.b) for r in compare.word_diff(marked).orderBy("a").collect()] == [(i, i + 3) for i in range(7)]
    assert marked.where("pair_id = 2 and partner is null and gap = 0").count() == 10


def test_seats_where_the_join_is_broadcast_late(spark):
    """A licence's rows stay in one task if the join turns into a broadcast while it runs; F4."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n, None) for n in names]
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 2).alias("licence_id"), F.col("id").alias("machine"))
    licences = rows.select("licence_id").distinct().select("licence_id", F.lit(1).alias("max_seats"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("expires"))
    try:
        for n, v in zip(names, ("-1", "10m", "false"), strict=True):
            spark.conf.set(n, v)
        got = licence.seat_admission(rows, licences, rows.limit(0)).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v) if v else spark.conf.unset(n)
    assert len(got) == 400 and {r.event_id for r in got if r.decision == "activate"} == {0, 1}


def test_versions_compared_in_a_row(spark):
    """Texts of a pair give the matches and gaps that their words as rows do, with no row a word in between; F5, F6, F7, F10, F11, F15."""
    rng = random.Random(5)
    odd = [None, "", " \n\n ", "é x   y", "a\n\n\n\n\nb  a\tc", "z" * 90]
    texts = odd + ["".join(rng.choice(["a", "bb", "c", "d", "e"]) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    sides = [(k, s, t) for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False)) for s, t in (("a", a), ("b", b))]
    docs = spark.createDataFrame(sides, "pair_id long, side string, text string")
    keys = ("pair_id", "side")
    for most in (300_000, 9):
        marked = compare.match_words(corpus.word_stream(docs, max_words=most, keys=keys)).cache()
        pairs = compare.paired_texts(corpus.word_texts(docs, max_words=most, keys=keys))
        told = lambda df: sorted(map(tuple, df.collect()))
        assert told(compare.matching_words(pairs)) == told(compare.word_diff(marked))
        runs = {}
        for r in marked.where("partner is null").orderBy("pair_id", "side", "pos").collect():
            runs.setdefault((r.pair_id, r.gap), {"a": [], "b": []})[r.side].append(r)
        changes = {(r.pair_id, r.gap): r for r in compare.diff_changes(pairs).collect()}
        assert changes.keys() == runs.keys()
        for k, r in changes.items():
            for side, text, page in (("a", r.a_text, r.a_page), ("b", r.b_text, r.b_page)):
                whole = " ".join(w.word for w in runs[k][side])
                assert text == (whole if len(whole) <= 60 else whole[:59] + "…") and page == (runs[k][side][0].page_no if whole else None)
        n = {r.pair_id: r for r in compare.version_similarity(pairs).collect()}
        words = {(r.pair_id, r.side): r.n for r in marked.groupBy("pair_id", "side").agg(F.count("*").alias("n")).collect()}
        assert n.keys() == {k for k, _ in words}
        assert all((r.equal + r.removed, r.equal + r.added) == (words.get((k, "a"), 0), words.get((k, "b"), 0)) for k, r in n.items())
        marked.unpersist()
    plan = compare.diff_changes(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_lists_parsed_once(spark):
    """Each answer is parsed at one place of the plan, also those without an entry; two failed answers of one id stay two; F8."""
    item = '{"i": %d, "t": "%s"}'
    raw = [(1, f"[{item % (0, 'a')}, {item % (0, 'b')}, 7]"), (2, '{"z": [], "a": [' + item % (4, "x") + "]}"), (3, '{"n": 1, "z": [' + item % (4, "x") + '], "a": []}'), (4, "no"), (4, "[7]"), (5, None)]
    df = extract.parse_lists(spark.createDataFrame(raw, "id long, answer string"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 0, "b", False), (2, None, None, True), (3, 4, "x", False), (4, None, None, True), (4, None, None, True), (5, None, None, True)], key=str)
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_phrasebook_pages_in_one_pass(spark):
    """Further aggregates of the pages come out of the same grouping, so blocks are translated once; F9."""
    done = spark.createDataFrame([(1, 0, 0, "x", True, False), (1, 0, 1, "y", False, True), (1, 1, 2, "z", False, True)], "doc_id long, page_no int, block_no int, translated string, done boolean, missing boolean")
    got = quality.phrasebook_pages(done, F.max("translated").alias("last")).orderBy("page_no").collect()
    assert [(r.translated, r.changed, r.failed, r["last"]) for r in got] == [(1, True, False, "y"), (0, False, True, "z")]


@pytest.fixture(scope="module")
def long_versions(spark, tmp_path_factory):
    """Two versions of 411 pages; the second has no page 2 and another last one."""
    rng = random.Random(8)
    pages = [["same title", "", "", ""]] + [[" ".join("v" * rng.randint(1, 9) + str(k) for _ in range(5)) for _ in range(4)] for k in range(411)]
    texts = ["\n".join(line for page in pages[:411][:cut] + pages[:411][cut + skip :] + more for line in page) for cut, skip, more in ((2, 0, []), (2, 1, [pages[411]]))]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_alignment_of_every_page(spark, long_versions):
    """Versions are aligned to their last page, beyond the feature's own limit; F1."""
    got = {(r.a_page, r.b_page): r.similarity for r in compare_queries.page_align(spark, long_versions).collect()}
    same = [(0, 0), (1, 1), *((i, i - 1) for i in range(3, 411))]
    assert len(same) > compare.MOST_PAGES and {p: got[p] for p in same} == dict.fromkeys(same, 1.0) and len(got) == len(same)


def test_summary_of_every_page(spark, long_versions):
    """Pages beyond the feature's own limit count as matched or alone; F2."""
    (r,) = compare_queries.page_align_summary(spark, long_versions).collect()
    assert (r.pair_id, r.pages_a, r.pages_b, r.matched, r.only_a, r.only_b, r.truncated) == (2, 411, 411, 410, 1, 1, True)


def test_unmatched_pages_of_all(spark, long_versions):
    """Pages beyond the feature's own limit are told too, of an alignment and of equal numbers; F3."""
    told = lambda df: sorted((r.kind, r.page_no) for r in df.collect())
    assert told(compare_queries.unmatched_pages_aligned(spark, long_versions)) == [("del", 2), ("ins", 410)]
    by_number = told(compare_queries.unmatched_pages(spark, long_versions))
    assert ("del", 410) in by_number and ("ins", 410) in by_number


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Versions of 1,002 pages, and versions with 300,001 words before their second page; they differ behind that."""
    pages, words = "p\n" * 4004, "w " + " ".join(f"{k % 977}x" for k in range(300_000)) + "\n" * 4
    texts = [pages + "a b c", pages + "b d", words + "a b c", words + "b d"]
    folder = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


def test_similarity_of_every_word(spark, long_texts):
    """Words beyond the feature's own limits count; F4."""
    folder, con = long_texts
    run, sql = compare_queries.QUERIES["version_similarity"]
    told = {r.pair_id: (r.equal, r.removed, r.added) for r in run(spark, folder).collect()}
    assert told == {2: (4005, 2, 1), 4: (300_002, 2, 1)}
    assert same(run(spark, folder), con, sql) is None


def test_diff_of_every_word(spark, long_texts):
    """Words beyond the feature's own limits match; F5."""
    folder, con = long_texts
    run, sql = compare_queries.QUERIES["word_diff"]
    got = {(r.pair_id, r.a, r.b) for r in run(spark, folder).collect()}
    assert got == {(2, k, k) for k in range(4004)} | {(2, 4005, 4004)} | {(4, k, k) for k in range(300_001)} | {(4, 300_002, 300_001)}
    assert same(run(spark, folder), con, sql) is None
