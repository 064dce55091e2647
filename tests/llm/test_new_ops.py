"""Clustering, byte repeats and ranked search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.llm import centroids, queries, ranked, repeats

from ..parity import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op13_ranked_search"])
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, FOLDER)) == duck_rows(connect(FOLDER), queries.ORACLES[name])


def test_partial_distances_are_exact():
    rng = np.random.default_rng(5)
    points, middles = rng.integers(-3, 4, (400, 64)), rng.integers(-3, 4, (30, 64))
    middles[7], middles[20], points[:5] = middles[3], middles[3], middles[3]
    whole = np.square(points[:, None, :] - middles[None]).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64), np.argsort(-points.var(axis=0))):
        found, best = centroids.nearest(points, middles, order)
        assert (best == whole.min(axis=1)).all() and (found == whole.argmin(axis=1)).all()


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    good = [(i, [rng.uniform(-2, 2) for _ in range(64)]) for i in range(60)]
    rows = good + [(70, None), (71, [1.0] * 63), (72, [1.0] * 65), (73, [None, *[1.0] * 63]), (74, [math.nan] * 64), (75, [math.inf] + [0.0] * 63), (5, good[5][1]), (None, good[6][1]), (None, good[6][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x"))
    ints = [[math.floor(256 * x) for x in v] for _, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    got, middles = centroids.clusters(centroids.quantised(frame), 7, 3)
    out = centroids.described(got, middles).collect()
    assert len(out) == len(ints) == 63 and len(middles) == 7
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(middles))
    assert collections.Counter((r.distance, r.cluster) for r in out) == collections.Counter(map(near, ints))
    assert {r.inertia for r in out} == {sum(near(v)[0] for v in ints)}
    assert centroids.described(*centroids.clusters(centroids.quantised(frame.where("vec_id < 3")), 7, 3)).count() == 3
    assert centroids.described(*centroids.clusters(centroids.quantised(frame.where("vec_id = 71")))).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.quantised(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def repeated(texts: list[bytes], size: int) -> list[np.ndarray]:
    places = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            places[t[p : p + size]].append((d, p))
    out = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        for d, p in where if len(where) > 1 else []:
            out[d][p : p + size] = True
    return out


def repeat_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abc é") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [words(rng.randint(4, 30)) for _ in range(4)]
    texts = []
    for _ in range(100):
        parts = [words(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), words(rng.randint(0, 12))]
        texts.append(rng.choice(["", " "]).join(parts))
    for _ in range(20):
        t = rng.choice(texts[:40])
        k = rng.randrange(len(t) + 1)
        texts.append(t[:k] + "X" + t[k + rng.randint(0, 2) :])
    texts += [texts[0], texts[1], texts[1], "", "a" * 200, "ab" * 90, "a" * 95, texts[5][3:], texts[6][:-4], words(4000)]
    return [*enumerate(texts), (None, "a" * 60), (3, texts[9]), (3, texts[3]), (None, None), (None, None)]


@pytest.mark.parametrize(("size", "gram", "most", "slab"), [(40, 10, 256, 1 << 19), (40, 10, 6, 64), (24, 6, 3, 1 << 19)])
def test_repeats_equal_brute_force(spark, size, gram, most, slab, monkeypatch):
    rows = repeat_rows(size + most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "own": F.lit("x"), "at": F.lit(2)}).repartition(3)
    texts = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), t, gone in zip(rows, texts, repeated(texts, size), strict=True):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        want[(i, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g))] += 1
    got = repeats.without_repeats(docs, size, gram, most).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_groups_hold_all_occurrences(spark):
    rows = [(i, t) for i, t in repeat_rows(9) if i is not None and i != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t.encode() for i, t in rows}
    found, _ = repeats.groups(docs, 40, 10)
    length = {bytes(r.id): r.length for r in found.collect()}
    by = collections.defaultdict(list)
    for r in repeats.occurrences(found).collect():
        by[bytes(r.id)].append(r)
    count = lambda s: sum(len(re.findall(b"(?=" + re.escape(s) + b")", t)) for t in texts.values())
    assert len(by) == len(length) > 50
    for g, places in by.items():
        strings = {texts[r.doc][r.start : r.start + length[g]] for r in places}
        assert len(strings) == 1 and len({(r.doc, r.own, r.start) for r in places}) == len(places) > 1
        assert sum(r.copies for r in places) == count(strings.pop())


def test_anchors_follow_the_window():
    rng = random.Random(1)
    grams = repeats.Grams(5000)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    at, first, last, h = repeats.anchors_of(text, grams, 40, 10)
    for slab in (1, 7, 100):
        assert all((x == y).all() for x, y in zip((at, first, last, h), repeats.anchors_of(text, grams, 40, 10, slab=slab), strict=True))
    assert first[0] == 0 and last[-1] == len(text) - 40 and (first[1:] == last[:-1] + 1).all() and (at >= last).all() and (at <= first + 30).all()
    moved, *_ = repeats.anchors_of(b"zz" + text[500:900], grams, 40, 10)
    assert set(at[(at >= 530) & (at < 860)] - 498) <= set(moved)
    assert len(repeats.anchors_of(b"x" * 39, grams, 40, 10)[0]) == 0
    assert len(set(h[at == at[0]])) == 1


def test_intervals_need_different_bytes_before():
    assert repeats.intervals([5, 5], [1, 1, 1], 5, False) == []
    assert repeats.intervals([5, 5], [1, 1, 1], 5, True) == [(5, [0, 1, 2], -1)]
    assert repeats.intervals([5, 7, 5], [1, 2, 2, 2], 5, False) == [(5, [0, 1, 2, 3], -1)]
    assert repeats.intervals([7, 5, 6], [1, 2, 2, -1], 5, False) == [(7, [0, 1], 2), (6, [2, 3], 2), (5, [], -1)]
    assert repeats.intervals([9, 7, 5], [1, 2, 3, 4], 5, False) == [(9, [0, 1], 1), (7, [2], 2), (5, [3], -1)]


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(empty).count() == 0
    assert [tuple(r)[1:4] for r in repeats.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(0, 0, 0)]


def scores(docs: list[tuple], items: list[tuple], k: int) -> collections.Counter:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, collections.Counter(split(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = collections.Counter()
    for item, text in items:
        found = []
        for i, c in texts:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("most", [200_000, 7])
def test_ranking_equals_brute_force(spark, most):
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "of", "naïve", "ÀB", "x1", "日本", "zebra", "Q"]) if rng.random() < 0.7 else f"w{rng.randint(0, 60)}"
    docs = [(i, rng.choice([" ", ", ", "\n", "[", "\x7f"]).join(word() for _ in range(rng.randint(0, 80)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " .,!"), (7, docs[8][1]), (None, docs[9][1]), (None, "zebra zebra"), (503, "the " * 5000)]
    docs += [(600 + i, docs[10][1]) for i in range(15)]
    items = [(j, " ".join(word() for _ in range(rng.randint(1, 12)))) for j in range(12)] + [(20, None), (21, "?!"), (22, "nowhere"), (23, "w1 w1 zebra"), (3, "again the"), (None, "zebra")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "rid": F.lit("x"), "held": F.lit(2)}).repartition(3)
    got = ranked.search(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(0)), 10, most).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == scores(docs, items, 10)


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("item_id = 2")).count() == 0
