import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platen.operators import alignment, rows, sessions


def windows_of(frames, width):
    out, start, best, n = [], None, None, 0
    for t, s, i in sorted(frames, key=lambda f: (f[0], f[2])):
        start = t if start is None else start
        s = -1.0 if s is None else s
        n += 1
        if best is None or s > best[0]:
            best = s, i
        if t - start >= width:
            out.append((start, best[1], best[0], n))
            start, best, n = t, None, 0
    return out + ([(start, best[1], best[0], n)] if n else [])


def test_windows_and_rates_of_several_keys(spark):
    rng = np.random.default_rng(3)
    frames = [(int(k), float(t), None if s < 0.1 else float(round(s, 3)), i) for i, (k, t, s) in enumerate(zip(rng.integers(0, 5, 400), rng.integers(0, 300, 400), rng.random(400), strict=True))]
    df = spark.createDataFrame(frames, "k int, t double, s double, id long").repartition(5)
    got = sorted(tuple(r) for r in sessions.best_of_windows(df, ["k"], "t", "s", "id", 40.0).collect())
    want = sorted((k, *w) for k in range(5) for w in windows_of([f[1:] for f in frames if f[0] == k], 40.0))
    assert got == want
    assert sessions.best_of_windows(df.where("k < 0"), ["k"], "t", "s", "id", 40.0).count() == 0
    assert alignment.rate_limited(df.where("k = 1"), ["k"], 0, 10.0).where("allowed").count() == 0


def test_a_long_key_is_streamed(spark):
    """One key of 300,000 rows, in batches of 10,000; and a null key."""
    many = spark.range(300_000).select(F.lit("x").alias("ip"), "id", F.col("id").cast("double").alias("t")).union(spark.range(3).select(F.lit(None), "id", F.col("id").cast("double")))
    out = alignment.rate_limited(many, ["ip"], 10, 100.0).groupBy("ip").agg(F.count_if("allowed").alias("n"), F.count("*").alias("all"))
    assert {(r.ip, r.n, r.all) for r in out.collect()} == {("x", 30_000, 300_000), (None, 3, 3)}
    frames = many.where("ip = 'x'").withColumn("s", F.col("id") % 7)
    assert sessions.best_of_windows(frames, ["ip"], "t", "s", "id", 99.0).count() == 3_031


def test_bounds_equal_the_binomial_tail():
    def plain(k, n):
        tail = lambda p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        low, high = k / n, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if 0 < mid < 1 and tail(mid) > 0.05 else (low, mid)
        return high

    cases = [(0, 1), (0, 30), (1, 20), (5, 6), (3, 1000), (40, 100), (99, 100), (250, 900)]
    k, n = (np.array(x) for x in zip(*cases, strict=True))
    assert np.allclose(rows.upper_bounds(k, n), [plain(*c) for c in cases], atol=1e-9, rtol=0)
    assert rows.upper_bounds(np.array([5, 0, 3]), np.array([5, 0, 2])).tolist() == [1.0, 1.0, 1.0] and len(rows.upper_bounds(k[:0], n[:0])) == 0
    big = rows.upper_bounds(np.array([1_000_000]), np.array([3_000_000]))[0]
    assert big == pytest.approx(1 / 3 + 1.645 * math.sqrt(2 / 9 / 3e6), abs=1e-6)


def test_bounds_are_a_column(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [0, 5, 1], "n": [30, 5, 20]}))
    got = [r.b for r in df.select(rows.upper_bound_95(F.col("k"), F.col("n")).alias("b")).collect()]
    assert got[0] == pytest.approx(1 - 0.05 ** (1 / 30), abs=1e-12) and got[1] == 1.0
