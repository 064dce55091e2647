"""Queries read whole texts, all documents and all rounds."""

import math
import random
from types import SimpleNamespace

import numpy as np

from platen.operators import alignment
from platen.plans import groups, lines, reports


def test_keys_and_diffs_of_whole_texts(spark):
    head = "word " * 60
    docs = spark.createDataFrame([(1, head + "one"), (2, head + "two"), (3, "a b\na c\nd c"), (4, "alone")], "doc_id long, text string")
    t = SimpleNamespace(spark=spark, documents=docs)
    keys = {r.doc_id: r for r in lines.text_keys_unicode(t).collect()}
    assert all(keys[1][c] != keys[2][c] for c in ("key", "pair_key", "diff_key", "ocr_key"))
    assert sorted((r.doc_id, r.pos) for r in lines.line_char_diff(t).collect() if r.doc_id > 2) == [(3, 0), (3, 1), (4, 0)]


def test_keys_of_whole_texts_take_small_batches(spark):
    """A Python worker holds a batch of whole texts and what comes of them; it had 10,000."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    lines.text_keys_unicode(SimpleNamespace(spark=spark, documents=docs))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_every_word_of_a_turn_votes(spark):
    head = "same " * 30
    rows = [(1, "user", head + "elephants"), (1, "assistant", head + "elephants"), (1, "system", head + "elephantz")]
    talk = spark.createDataFrame(rows, "conv_id long, role string, text string")
    got = [(r.panel, r.found, r.reference) for r in groups.panels_voted(SimpleNamespace(spark=spark, conversations=talk)).collect()]
    assert got == [("system", "elephantz", "elephants")]


def test_long_documents_are_paired(spark):
    word = "abcdefghij"
    long = [f"{word * 60}{k}" for k in range(10)]
    rows = [(2, "\n".join(long), 6009), (3, "\n".join(reversed(long)), 6009), (4, "one\ntwo", None), (5, "\n".join([*long, "one"]), 6013)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {(r.job, r.a, r.b): r.how for r in groups.lines_paired(SimpleNamespace(spark=spark, documents=docs)).collect()}
    assert all(got[1, k, 9 - k] == "key" for k in range(10)) and got[2, 0, 10] == "key"
    assert {b for j, _, b in got if j == 2 and b is not None} == set(range(11))


def test_supplier_fit_has_four_rounds(spark):
    rng = random.Random(5)
    rows = [(k, float(x), 3.0 * x + k + rng.uniform(-2, 2) + rng.choice([0] * 6 + [40, 900])) for k in range(4) for x in range(40)]
    got = groups.supplier_price_robust_fit(SimpleNamespace(spark=spark, lineitem=spark.createDataFrame(rows, "l_suppkey int, l_quantity double, l_extendedprice double"))).collect()
    assert len(got) == 4
    for r in got:
        x, y = np.array([(x, y) for k, x, y in rows if k == r.l_suppkey]).T
        for turn in range(4):
            m, c = np.polyfit(x, y, 1)
            if turn < 3:
                off = np.abs(y - m * x - c)
                keep = off <= max(1, 4 * np.median(off))
                x, y = x[keep], y[keep]
        assert abs(r.slope - m) < 1e-5 and abs(r.intercept - c) < 1e-3 and r.n == len(x) < 40


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_of_all_document_lines(spark):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(14))
    docs = [(d, "\n".join(line() for _ in range(3))) for d in range(12)]
    items = [(k, "x" + docs[k][1].split("\n")[1][3:] + "q") for k in range(5)] + [(9, line())]
    t = SimpleNamespace(spark=spark, documents=spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    key = lambda x: "".join(c for c in x if c.isalnum()).upper()
    want = {(i, *min((_distance(key(x), key(y)), d, p) for d, z in docs for p, y in enumerate(z.split("\n")))) for i, x in items}
    assert {(r.item_id, r.distance, r.doc_id, r.pos) for r in lines.benchmark_nearest_document_line(t).collect()} == want


def test_fit_holds_no_map_of_values(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (2, 1.0, 1.0)], "k int, x double, y double")
    fit = alignment.robust_fit(points, ["k"])
    assert [(r.k, round(r.slope, 9), r.n) for r in fit.collect()] == [(1, 2.0, 3)]
    assert not any(x in fit._jdf.queryExecution().optimizedPlan().toString() for x in ("median", "percentile"))


def test_a_line_goes_without_its_document(spark):
    docs = spark.createDataFrame([(1, "one line\nanother line\n\nlast"), (2, "alone"), (3, None)], "doc_id long, text string")
    t = SimpleNamespace(spark=spark, documents=docs)
    for query, rows in ((reports.line_pair_differences, 5), (lines.line_char_diff, 4)):
        out = query(t)
        assert out.count() == rows
        above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        # Each line's row held all lines of its document.
        assert "parts#" not in above


def test_coverage_of_texts_without_characters(spark):
    """Their share is 0 of 0: NaN as in the SQL, and no error."""
    rows = [(1, "a\n" + "b" * 40), (2, ""), (3, None), (4, "\n\n")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: (r.lines, r.coverage) for r in lines.doc_line_coverage(SimpleNamespace(spark=spark, documents=docs)).collect()}
    assert got.keys() == {1, 2, 4} and got[1] == (2, round(1 - 1 / 41, 9))
    assert all(got[k][0] == n and math.isnan(got[k][1]) for k, n in ((2, 1), (4, 3)))


def test_line_char_diff_steps_are_characters(spark):
    docs = spark.createDataFrame([(1, "a red cat\na rod cat"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.line_char_diff(SimpleNamespace(spark=spark, documents=docs)).collect()}
    assert [tuple(s) for s in got[1].steps] == [("equal", "a r", "a r", 0, 0), ("replace", "e", "o", 3, 3), ("equal", "d cat", "d cat", 4, 4)]
    assert got[1].ratio == 16 / 18 and got[1].run == 1 / 3 and (got[2].steps, got[2].ratio, got[2].run) == ([], 1.0, 0.0)
