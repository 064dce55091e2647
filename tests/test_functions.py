import math
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from platen.functions import geometry as g
from platen.functions import text
from platen.operators import rows, sessions
from platen.session import ship


def one(spark, **columns):
    ship(spark)
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_check_digits(spark):
    for code, ok in (("0123456789012", True), ("036000291452", True), ("0123456789013", False), ("4006381333931", True), ("8851234567890", False), ("12", False)):
        assert one(spark, x=text.gs1_ok(F.lit(code)))["x"] is ok


def test_number_checks(spark):
    cases = {"6 • 43 OZ 16.12 LBS 7.31 kg": (False, False, False), "6 • 43 OZ 17.50 LBS": (True, False, False), "5 OZ (142 g)": (False, False, False), "5 OZ (199 g)": (False, False, True)}
    for label, wanted in cases.items():
        assert tuple(one(spark, x=text.number_checks(F.lit(label)))["x"]) == wanted, label


def test_barcodes_rejoin(spark):
    assert one(spark, x=text.bad_barcodes(F.lit("code 036000291452 and 036000291453")))["x"] == ["036000291453"]


def test_keys(spark):
    got = one(spark, a=text.key(F.lit("½ café Ⅳ")), b=text.key(F.lit("٣٤ أحمد")), c=text.ocr_key(F.lit("Café x")), d=text.diff_key(F.lit("a ... b ____")), e=text.pair_key(F.lit("Net 12 g")))
    assert got == {"a": "12CAFÉIV", "b": "34احمد", "c": "CAFEX", "d": "a…b…", "e": "net ## g"}


def test_composable(spark):
    made = lambda t, p: one(spark, x=text.composable(F.lit(t), F.array(*[F.lit(q) for q in p])))["x"]
    assert made("ABCDEF", ["ABC", "DEF"]) and not made("ABCDEFG", ["ABC", "DEF"])
    assert made("ABCXYZXYZ1", ["ABC", "00XYZXYZ111"])  # one fragment of seven
    assert not made("ABCXYZ", ["ABC", "00XYZ"])


def test_phrases(spark):
    d = lambda t, p: one(spark, x=text.phrase_distance(F.lit(t), F.lit(p)))["x"]
    assert d("keep in a cool dry place", "cool dry place") == 0
    assert d("keep in a cool dry plaxe", "cool dry place") in (1, 2, 3)
    assert d("nothing of that sort here", "cool dry place") is None


def test_classes(spark):
    def of(a, b, ca="", cb="", alone=False):
        return one(spark, x=text.difference_class(F.lit(a), F.lit(b), F.lit(ca), F.lit(cb), F.lit(alone)))["x"]

    assert [of("'", "’"), of("Ab", "aB"), of("1", "7"), of(",", ".", "1", "2"), of(",", "."), of("x", "y")] == ["PUNCT", "CASE", "NUMBER", "NUMBER", "PUNCT", "TEXT"]


def test_diffs(spark):
    got = one(spark, a=text.char_diff(F.lit("abc"), F.lit("abd")), r=text.match_ratio(F.lit("abc"), F.lit("abd")), w=text.run_ratio(F.lit("a b c"), F.lit("x b c")))
    assert [x["op"] for x in got["a"]] == ["equal", "replace"] and got["r"] == pytest.approx(2 / 3) and got["w"] == pytest.approx(2 / 3)


def test_password_email_mask(spark):
    got = one(spark, p=text.password_problems(F.lit("abc")), e=text.email_problem(F.lit("a@b.co"), ["b.co"]), f=text.email_problem(F.lit("a@c.co"), ["b.co"]), m=text.masked(F.lit("secret99")), j=text.fenced_json(F.lit('```json\n{"a":1}\n```')))
    assert got == {"p": ["short", "upper", "digit", "special"], "e": None, "f": "domain", "m": "****et99", "j": '{"a":1}'}


@pytest.mark.parametrize(
    ("one_", "two", "wanted"),
    [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082), ((50, 0, 0), (50, -1, 2), 2.3669)],
)
def test_published_colour_pairs(spark, one_, two, wanted):
    lit = lambda c: tuple(F.lit(float(v)) for v in c)
    assert one(spark, d=g.delta_e(lit(one_), lit(two)))["d"] == pytest.approx(wanted, abs=1e-4)


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = one(spark, i=g.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), z=g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), r=g.rotated_frac(box(0.1, 0.2, 0.3, 0.4), F.lit(90)), c=g.cover(box(0, 0, 2, 2), box(0, 0, 1, 2)), g=g.gap(box(0, 0, 1, 1), box(4, 5, 6, 7)))
    assert got["i"] == pytest.approx(1 / 7) and got["z"] == 0 and got["c"] == 0.5 and got["g"] == 5
    assert got["r"] == pytest.approx([0.4, 0.1, 0.4, 0.3])


def test_bounds(spark):
    ship(spark)
    got = spark.createDataFrame([(0, 30), (5, 5), (1, 20)], "k int, n int").select(rows.upper_bound_95(F.col("k"), F.col("n")).alias("b")).collect()
    assert 0.09 < got[0].b < 0.10 and got[1].b == 1 and got[2].b == pytest.approx(0.2161, abs=1e-3)
    assert rows.images_needed(0.02) == 149 and math.isclose(1 - 0.05 ** (1 / 30), got[0].b, abs_tol=1e-9)


def test_prefix_limit(spark):
    df = spark.createDataFrame([(1, 2165, 1.0), (1, 1000, 1.0), (1, 514, 0.4), (1, 257, 1.0), (2, 9, 0.0)], "g int, e int, rate double")
    got = {r.g: r["limit"] for r in rows.prefix_limit(df, ["g"], [F.desc("e")], F.col("rate") == 1, "e").collect()}
    assert got == {1: 1000, 2: None}


def machine(kinds, reset=3):
    present, empty, session, out = False, 0, 0, []
    for i, k in enumerate(kinds, 1):
        if k is None:
            empty += 1
            present = present and empty < reset
            continue
        if not present:
            session += 1
            out.append([session, i, None])
        present, empty = True, 0
        if k == "ng" and out[-1][2] is None:
            out[-1][2] = i
    return [tuple(x) for x in out]


def test_sessions_match_the_machine(spark):
    import random

    rng = random.Random(7)
    kinds = {line: [rng.choice([None, None, None, "ok", "ng"]) for _ in range(60)] for line in range(8)}
    kinds[9] = ["ng", None, None, "ok", None, None, None, "ok", None, "ng"]
    df = spark.createDataFrame([(line, i, k) for line, ks in kinds.items() for i, k in enumerate(ks)], "line long, i long, k string")
    framed = sessions.sessions(df, ["line"], ["i"], F.col("k").isNotNull())
    log = sessions.session_log(framed, ["line"], F.col("k") == "ng").orderBy("line", "session").collect()
    got = {}
    for r in log:
        got.setdefault(r.line, []).append((r.session, r.first_frame, r.first_defect))
    assert got == {line: machine(ks) for line, ks in kinds.items()}


def test_streaming_twin(spark, tmp_path):
    from platen.streaming.sessions import counted_objects

    # A query with a timer goes on without data else.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    kinds = ["ng", None, None, "ok", None, None, None, "ok", None, "ng", None]
    src = str(tmp_path / "in")
    for k, part in enumerate((kinds[:5], kinds[5:])):
        rows_ = [(1, 5 * k + i, v) for i, v in enumerate(part)]
        spark.createDataFrame(rows_, "line long, frame_id long, verdict string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("line long, frame_id long, verdict string").parquet(src)
        q = counted_objects(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r.session, r.frame_id, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "ng"), (1, 0, "open"), (2, 7, "open"), (2, 9, "ng")]


def test_split_is_exact(spark):
    got = {r.part: r["count"] for r in rows.split_counts(spark.range(1003), "id").groupBy("part").count().collect()}
    assert got == {"train": 702, "val": 200, "test": 101}


def test_merges(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    both = lambda df: sorted(map(tuple, df.collect()))
    assert both(rows.merge_not_matched(a, b, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert both(rows.upsert(a, b, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]
    rounds = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (2, "U")], "r int, key string")
    got = {r.key: r.confirmed for r in rows.confirmed(rounds, ["key"], "r", F.col("key") == "U", 2, []).collect()}
    assert got == {"x": True, "y": False, "U": True}


def test_stretches_equal_difflib(monkeypatch):
    from platen.functions import stretches

    rng = random.Random(3)
    for cells in (1, 60, 1 << 24):
        monkeypatch.setattr(stretches, "CELLS", cells)
        for letters in ("ab", "abcdé", "abcdefghijklmnopqrstuvwxyz"):
            for _ in range(60):
                x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
                y = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) if rng.random() < 0.5 else "".join(rng.choice(["", "a", c, c, c]) for c in x)
                want, got = SequenceMatcher(None, x, y, autojunk=False), stretches.matcher(x, y)
                assert got.get_matching_blocks() == want.get_matching_blocks() and got.get_opcodes() == want.get_opcodes() and got.ratio() == want.ratio()


def test_stretches_of_long_texts_take_no_table():
    """Two lines of 20,000 characters: difflib's steps grew with their product."""
    from platen.functions import stretches

    rng = random.Random(4)
    x, y = ("".join(rng.choice("etaoin shrdlu") for _ in range(20_000)) for _ in range(2))
    before = time.process_time()
    assert sum(b.size for b in stretches.blocks(x, y)) > 1_000
    assert time.process_time() - before < 20


def test_pair_steps_of_long_lines_take_no_square():
    """Lines of 6,000 characters with a loose word at every tenth: the line was read anew for each."""
    a = "".join(f"ten letter {k:04d} " for k in range(400))
    b = "".join(f"ten letter {k:04d} {'odd ' if k % 2 else ''}" for k in range(400))
    before = time.process_time()
    steps = text._pair_steps(a, b, "", "", False)
    assert len(steps) > 150 and any(s["alone"] for s in steps) and time.process_time() - before < 5
