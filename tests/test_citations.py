"""Cited words, quotes that are off, and texts in a second reading."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from platen.operators import citations
from platen.session import ship

LINES = [("A", 0, "Net  weight 340 g net"), ("A", 1, "Salt 3% salt 3% end"), ("B", 0, "Net weight 350 g net"), ("B", 1, "(min)...... 7%")]
REF = "job int, item int, side string, ids array<string>, quote string"


def test_references(spark):
    lines = spark.createDataFrame([(1, *r) for r in LINES], "job int, side string, i long, text string")
    cases = [
        (("A", ["A0:1", "A0:3"], "weight 340 g"), (0, 5, 17, "exact", None)),  # a gap between cited words
        (("A", ["A0:3", "A0:1"], " weight  340 g "), (0, 5, 17, "exact", None)),  # in any order, blanks aside
        (("A", ["A0:0"], "weight"), (0, 5, 11, "shift", None)),
        (("A", ["A0:9"], "net"), (None, None, None, None, "no word")),  # too far to recover
        (("A", ["A0:5"], "net"), (0, 18, 21, "shift", None)),  # no such word, but near
        (("A", ["A1:1"], "3%"), (1, 5, 7, "exact", None)),
        (("A", ["A1:2"], "3%"), (None, None, None, None, "other text")),  # two places equally near
        (("A", ["A1:0", "A1:1"], "alt"), (1, 1, 4, "part", None)),
        (("A", ["A1:0", "A1:3"], "alt"), (None, None, None, None, "other text")),  # twice inside
        (("B", ["B1:0"], "......"), (1, 5, 11, "part", None)),
        (("A", ["B0:0"], "Net"), (None, None, None, None, "foreign id")),
        (("A", ["x"], "Net"), (None, None, None, None, "foreign id")),
        (("A", ["A7:0"], "Net"), (None, None, None, None, "no line")),
        (("A", ["A0:0", "A1:0"], "Net"), (None, None, None, None, "several lines")),
        (("A", ["A0:0", "A1:9"], "Net"), (None, None, None, None, "no word")),  # the first fault of the first faulty id
        (("A", ["A0:0"], "missing"), (None, None, None, None, "other text")),
        (("A", ["A0:0"], None), (None, None, None, None, "other text")),
        (("A", [], "Net"), (None, None, None, None, "nothing cited")),
        (("A", None, None), (None, None, None, None, "nothing cited")),
        (("A", [None], "Net"), (None, None, None, None, "foreign id")),
    ]
    refs = spark.createDataFrame([(1, k, *c[0]) for k, c in enumerate(cases)], REF)
    got = {r.item: (r.line, r.start, r.end, r.how, r.reason) for r in citations.resolved(refs, lines, ["job"]).collect()}
    assert got == {k: c[1] for k, c in enumerate(cases)}
    assert citations.resolved(refs.where("item < 0"), lines, ["job"]).count() == 0
    said = citations.resolved(refs.where("item in (0, 9)"), lines, ["job"]).orderBy("item").collect()
    assert [r.says for r in said] == ["weight 340 g", "......"]


def test_findings(spark):
    lines = spark.createDataFrame([(1, *r) for r in LINES], "job int, side string, i long, text string")
    rows = [
        (1, 0, "real", ["A0:2", "A0:3"], "340 g", ["B0:2", "B0:3"], "350 g"),
        (1, 1, "Real ", ["A0:0"], "Net", None, None),
        (1, 2, "noise", None, None, ["B0:0"], "Net"),
        (1, 3, "real", ["A0:0", "A0:1"], "Net weight", ["B0:0", "B0:1"], "Net weight"),
        (1, 4, "real", None, None, None, None),
        (1, 5, "maybe", ["A0:0"], "Net", None, None),
        (1, 6, "real", ["A0:0"], "Net", ["A0:0"], "Net"),
    ]
    items = spark.createDataFrame(rows, "job int, item int, verdict string, a_ids array<string>, a_quote string, b_ids array<string>, b_quote string")
    got = {r["item"]: (r.status, r.kind, r.a, r.b, r.reason) for r in citations.cited_findings(items, lines, ["job"]).collect()}
    assert got == {
        0: ("ok", "NUMBER", "4", "5", None),
        1: ("ok", "MISSING_IN_B", "Net", "", None),
        2: ("ok", "EXTRA_IN_B", "", "Net", None),
        3: ("equivalent", None, None, None, None),
        4: ("invalid", None, None, None, "nothing cited"),
        5: ("invalid", None, None, None, "unknown verdict"),
        6: ("invalid", None, None, None, "foreign id"),
    }


def test_shared_blocks_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        x, y = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(2))
        want = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        assert citations.shared_characters(x, y) == want, (x, y)
    assert citations.Automaton("xabyab").longest("zab") == (2, 1, 1)


def test_reread(spark):
    lines = spark.createDataFrame([(1, 0, "Keep in a "), (1, 1, "COOL place"), (2, 0, "")], "job int, i int, text string")
    targets = spark.createDataFrame([(1, 0, "a cool"), (1, 1, "warm place"), (1, 2, ""), (2, 0, "x"), (3, 0, "x"), (1, 3, None)], "job int, item int, text string")
    got = {(r.job, r["item"]): r.present for r in citations.reread(targets, lines, ["job"]).select("job", "item", F.round("present", 6).alias("present")).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 0.666667, (1, 2): 0.0, (2, 0): 0.0, (3, 0): 0.0, (1, 3): 0.0}


def test_words_of_a_long_line_take_one_pass(spark):
    ship(spark)
    long_ = spark.createDataFrame([(1, "word  x\u001f " * 20_000), (2, None), (3, " ")], "i long, x string")
    start = time.monotonic()
    got = {r.i: r.w for r in long_.select("i", citations.placed_words(F.col("x")).alias("w")).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 40_000
    assert tuple(got[1][0]) == ("word", 0, 4) and tuple(got[1][1]) == ("x\u001f", 6, 8)
    # An array grown by a word a step took 8 s for a quarter of these words.
    assert time.monotonic() - start < 20
