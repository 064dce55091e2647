"""Rules whose cases SQL texts don't reach."""

from pyspark.sql import functions as F

from platen.functions import text
from platen.operators import alignment, findings, reports


def test_relation(spark):
    pairs = [("NET WT", "NET WT", "same"), ("T W", "NET WT", "truncated"), ("N", "NET", "different"), ("NET", "Net", "different"), ("", "x", "unknown"), (None, "x", "unknown"), ("café", "cafe", "different"), ("٤٧٥ g", "475 g", "same"), ("e\u0301", "\u00e9", "same")]
    got = [r.r for r in spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text.relation(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [p[2] for p in pairs]


def test_fractions(spark):
    pairs = [("½ cup", "2 cup", True), ("½ cup", "1 cup", True), ("1/2 cup", "cup", True), ("1/2 cup", "3/4 cup", False), ("3/2 cup", "2 cup", False), ("½ cup", "½ mug", False), ("cup", "1/2 cup", True)]
    got = [r.r for r in spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text.fraction_confusion(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [p[2] for p in pairs]


def test_evidence_and_verdict(spark):
    rows = [(1, "SAME", "SAME", 1), (2, "SAME", "SAME", 1), (2, "SAME", None, 2), (3, "SAME", "DIFF", 1), (3, "SAME", None, 2), (4, None, "SAME", 1), (5, "DIFF", "SAME", 1), (6, "UNVERIFIABLE", "DIFF", 1)]
    d = spark.createDataFrame(rows, "k int, s string, t string, o int")
    assert {r.k: r.e for r in d.groupBy("k").agg(findings.evidence(F.col("s"), F.col("t"), F.col("o")).alias("e")).collect()} == {1: "SAME", 2: "UNVERIFIABLE", 3: "DIFF", 4: "UNVERIFIABLE", 5: "DIFF", 6: "UNVERIFIABLE"}
    cases = [(100.0, 0.0, [], "PASS"), (100.0, 0.0, None, "PASS"), (100.0, 0.0, [("minor", 10)], "WARN"), (100.0, 0.0, [("critical", 500)], "FAIL"), (100.0, 0.0, [("minor", 2000)], "FAIL"), (96.0, 0.0, [], "WARN"), (100.0, 37.0, [], "FAIL")]
    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, p double, q double, d array<struct<severity: string, area_px: int>>")
    assert [r.v for r in d.orderBy("i").select(findings.pixel_verdict(F.col("p"), F.col("q"), F.col("d")).alias("v")).collect()] == [c[3] for c in cases]


def test_fonts_with_poisoned_characters(spark):
    spans = spark.createDataFrame([(1, "bad", "aÄé\x01"), (1, "good", "bé"), (1, None, None), (2, "bad", "Ä")], "doc int, font string, text string")
    fonts = reports.font_evidence(spans, ["doc"], spark.createDataFrame([(2, " bad ")], "doc int, font string"))
    assert {(r.doc, r.font): (r.bad_spans, r.suspect) for r in fonts.collect()} == {(1, "bad"): (1, True), (1, "good"): (0, False), (1, "?"): (0, False), (2, "bad"): (0, True)}
    assert {(r.doc, r.ch) for r in reports.poisoned_chars(spans, ["doc"], fonts.where("suspect")).collect()} == {(1, "Ä"), (2, "Ä")}


def test_answers_clones_and_words(spark):
    raw = ['["a", " ", "b"]', '"one"', "{}", "3", None, "[1"]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(reports.as_list(F.col("x")).alias("x")).collect()]
    assert got == [["a", "b"], ["one"], [], [], [], []]
    rec = spark.createDataFrame([("r1", "ana", [("a",), (None,), ("b",)], "s", "res")], "rec_id string, owner string, zones array<struct<doc: string>>, settings string, results string")
    r = reports.cloned(rec, "r1", "r2", "bo").first()
    assert (r.rec_id, r.owner, len(r.zones), r.results, r.cloned_from, r.cloned_from_owner) == ("r2", "bo", 2, None, "r1", "ana")
    words = spark.createDataFrame([("tast",), ("pantothenote",)], "word string")
    pools = spark.createDataFrame([("taste", 1, 5), ("toast", 2, 9), ("last", 2, 3), ("test", 2, 1), ("Pantothenate", 0, 1)], "word string, pool int, frequency int")
    assert {r.word: r.suggested for r in reports.suggestions(words, pools).collect()} == {"tast": ["taste"], "pantothenote": ["Pantothenate"]}


def test_differences_of_a_pair(spark):
    cases = [
        ("Fat 20% max", "Fat 24% max", "", "", [("NUMBER", "0", "4")]),
        ("Store in a cool", "Store in a cool place", "place and dry", "", [("REFLOW", "", "place")]),
        ("Store in a cool", "Store in a cool shed", "place and dry", "", [("TEXT", "", "shed")]),
        ("Name .... x", "Name x", "", "", [("FILLER", "…", "")]),
        ("½ cup", "2 cup", "", "", [("FRACTION", "1/", "")]),
        ("Panto-", "Panto", "", "", [("REFLOW", "-", "")]),
        ("Net", "NET", "", "", [("CASE", "et", "ET")]),
        ("same", "same", "", "", []),
        ("", "", "", "", []),
        ("(866) 500-6286 AvoDerm.com", "(866) 500-6286 • AvoDerm.com", "", "", [("PUNCT", "", "·")]),
        ("Fat 1.5 g", "Fat 1 5 g", "", "", [("NUMBER", ".", "")]),
        ("Total 1,000 kg", "Total 1.000 kg", "", "", [("NUMBER", ",", ".")]),
        ("a 1 • 2", "a 1 2", "", "", [("PUNCT", "·", "")]),
        ("xaby", "zacw", "", "", [("TEXT", "xaby", "zacw")]),
        ("xabcy", "zabcw", "", "", [("TEXT", "x", "z"), ("TEXT", "y", "w")]),
        ("apple", "ample", "", "", [("TEXT", "p", "m")]),
    ]
    d = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, a string, b string, p string, q string")
    got = d.orderBy("i").select(text.pair_differences(F.col("a"), F.col("b"), F.col("p"), F.col("q")).alias("x")).collect()
    assert [[(s.kind, s.a, s.b) for s in r.x] for r in got] == [c[4] for c in cases]


def test_spans_and_moved_texts(spark):
    d = spark.createDataFrame([("keep in a dry place", "keep in a wet place", "", ""), ("and cool place today", "cool place", "", "here and there"), ("", "x", "", "")], "a string, b string, p string, q string")
    got = [r.x for r in d.select(text.diff_spans("a", "b", "p", "q").alias("x")).collect()]
    assert [(r.a, r.b) for r in got] == [([[10, 13]], [[10, 13]]), ([[15, 20]], []), ([], [])]
    rows = [(1, 0, "TEXT", "salt", ""), (1, 1, "TEXT", "", "salt"), (1, 2, "TEXT", "fish", ""), (1, 3, "TEXT", "oil", "oilfish."), (1, 4, "TEXT", "x", ""), (1, 5, "TEXT", "", "x")]
    f = spark.createDataFrame(rows, "p int, i int, kind string, a string, b string")
    assert {r.i: r.kind for r in alignment.moved_texts(f, ["p"]).collect()} == {0: "MOVED", 1: "MOVED", 2: "MOVED", 3: "TEXT", 4: "TEXT", 5: "TEXT"}
    rows = [(2, 0, "NUMBER", "oil", ""), (2, 1, "TEXT", "ab", "ab.oil"), (2, 2, "TEXT", "", "oiloil"), (2, 3, "TEXT", "--", ""), (2, 4, "TEXT", "", "--"), (3, 0, "TEXT", None, "oil"), (2, 5, "TEXT", "", "(salt)"), (2, 6, "TEXT", "salt", None)]
    f = spark.createDataFrame(rows, "p int, i int, kind string, a string, b string")
    got = {(r.p, r.i): r.kind for r in alignment.moved_texts(f, ["p"]).collect()}
    # oil is in 1 first, where ab. is left against ab; oiloil is nowhere; salt leaves only marks in 5.
    assert got == {(2, 0): "MOVED", (2, 1): "TEXT", (2, 2): "TEXT", (2, 3): "TEXT", (2, 4): "TEXT", (2, 5): "PUNCT", (2, 6): "MOVED", (3, 0): "TEXT"}
    lines = spark.createDataFrame([(1, "a", 0, "made in the north of spain"), (1, "a", 1, "nothing like it"), (1, "b", 0, "was made in the north"), (1, "b", 1, "left over")], "g int, side string, i int, line string")
    assert {(r.found, r.reference) for r in alignment.cross_extras(lines, ["g"]).collect()} == {("made in the north of spain", "was made in the north"), ("nothing like it", None), (None, "left over")}


def test_gate_mean_is_free_of_row_order(spark):
    """A mean that ends in half of the last digit kept, summed from values that doubles don't hold."""
    values = [0.9] * 3 + [0.91] * 5 + [0.97] * 13 + [1 - 0.07] * 2 + [1 - 0.01] * 9
    exact = sum(round(v * 100) for v in values) * 10**5 / len(values) / 10**7
    rows = [(k, v, 0.0, True) for k in range(8) for v in (values if k % 2 else values[::-1])[k:] + (values if k % 2 else values[::-1])[:k]]
    pairs = spark.createDataFrame(rows, "k int, iou double, conf double, same boolean")
    counts = spark.createDataFrame([(k, 1, 1) for k in range(8)], "k int, base int, test int")
    assert {r.mean_iou for r in reports.detector_gate(pairs, counts, ["k"], 0.93, 0.07, 0.6).collect()} == {exact}


def test_summary_of_blocks_keeps_every_text(spark):
    from types import SimpleNamespace

    from platen.plans import reports as plans

    lines = spark.sql("select 1L as l_orderkey, cast(id as double) as l_extendedprice, 'N' as l_returnflag, 0.1d as l_tax, timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as l_shipdate, 0d as l_discount from range(14)")
    (got,) = plans.block_match_summary(SimpleNamespace(lineitem=lines)).collect()
    assert got.missing == 14 and got.missing_texts == ",".join(f"2020-01-{d:02d}" for d in range(1, 15))


def test_gate_mean_of_placed_rows_sums_in_their_order(spark):
    values = [0.9] * 3 + [0.91] * 5 + [0.97] * 13 + [1 - 0.07] * 2 + [1 - 0.01] * 9
    rows = [(0, v, 0.0, True, i) for i, v in enumerate(values)] + [(1, v, 0.0, True, i) for i, v in enumerate(values[::-1])]
    pairs = spark.createDataFrame(rows[::-1], "k int, iou double, conf double, same boolean, at long").repartition(3)
    counts = spark.createDataFrame([(k, 1, 1) for k in range(2)], "k int, base int, test int")
    want = {0: sum_in_order(values) / len(values), 1: sum_in_order(values[::-1]) / len(values)}
    assert want[0] != want[1] and {r.k: r.mean_iou for r in reports.detector_gate(pairs, counts, ["k"], 0.93, 0.07, 0.6).collect()} == want


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_equal_blocks_keep_their_place(spark):
    rows = [(1, 2.0, "missing", t, 1.0, i) for i, t in enumerate("zbya")] + [(1, 1.0, "missing", "first", 1.0, 9)]
    blocks = spark.createDataFrame(rows[::-1], "k int, i double, kind string, text string, sim double, at long")
    (got,) = reports.match_summary(blocks, ["k"], most=None).collect()
    assert got.missing_texts == ["first", "z", "b", "y", "a"]


def test_zoom_lines_meet_a_group_once(spark):
    """Equal panel lines are one, and a group's text meets all its zoom lines in one row."""
    zooms = spark.createDataFrame([(1, "red ring"), (1, "gone bolt"), (1, "gone belt"), (2, "red ring")], "g int, line string")
    panels = spark.createDataFrame([(1, p, "gone bold") for p in range(3, 40)] + [(1, 2, "Red  Ring"), (1, 50, "gone bell")], "g int, pos long, line string")
    out = reports.zoom_lines(zooms, panels, ["g"])
    assert {(r.g, r.line, r.nearest, r.distance, r.close) for r in out.collect()} == {(1, "gone bolt", "gone bold", 1, True), (1, "gone belt", "gone bell", 1, True), (2, "red ring", None, None, False)}
    assert "collect_set" in out._jdf.queryExecution().optimizedPlan().toString()
