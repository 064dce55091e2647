import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from platen.llm import common, components, decontaminate, jaccard, lines, lm, media, packing, pii, sharding, token_counts, toxicity, wordbpe

DDL = "doc_id long, text string, lang string, source string, n_chars long, block long, u long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def base_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "ti"]) for _ in range(rng.randint(1, 3)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    texts += [texts[0], texts[0].replace("th", "th", 1), texts[1] + " " + word(), "", None, "   \n ", "one", "a b c d", "Mail ana.b@x-y.org now, +1 (415) 555-0101, 10.0.0.1 4111 1111 1111 1111"]
    texts += [" ".join(word() for _ in range(6000)), "日本語のテキスト 𝒳 naïve İ", texts[1]]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 7, 9) for i, t in enumerate(texts)]
    return [*rows, (None, "null id text", None, None, 3, 7, 9), rows[2], (2, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base_rows(), DDL).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_word_bpe_is_the_tokenizer():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(PATH), wordbpe.word_bpe(PATH)
    cases = [t or "" for _, t, *_ in base_rows()] + ["It's don't I'll", "ẞ ſ K Å ΣΑΣ", "a\x1cb", "<|endoftext|> x", "é ́x", "x***y ## 12.5%", " x y", "ÀÉ! ÿ. ß", "'s 't x's"]
    for t in cases:
        assert fast.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_token_rollup(spark, docs, empty):
    rollup = token_counts.TokenRollup(spark, f"{common.shared_root(spark)}/rollup-test")
    assert rollup.totals().count() == 0
    counts = common.kept(token_counts.counted(docs, "v1", PATH), "counts")
    assert rollup.commit("load", token_counts.inserts(counts)) and not rollup.commit("load", token_counts.inserts(counts))
    assert rollup.commit("nothing", token_counts.inserts(token_counts.counted(empty, "v1", PATH)))
    bpe, wanted = wordbpe.word_bpe(PATH), collections.defaultdict(lambda: [0, 0, 0, 0])
    for _, t, lang, source, *_ in base_rows():
        t = t or ""
        for k, v in enumerate((1, len(bpe.encode(t)) // 4, len(t), len(t.encode()))):
            wanted[(source, lang, "v1")][k] += v
    as_dict = lambda: {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars, r.n_bytes] for r in rollup.totals().collect()}
    assert as_dict() == wanted
    old = counts.where("doc_id < 5")
    new = old.withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit("revise", token_counts.revisions(old, new))
    got = as_dict()
    assert sum(v[0] for k, v in got.items() if k[2] == "v2") == old.count() and sum(v[0] for v in got.values()) == len(base_rows())
    rollup.commit("delete", token_counts.deletes(counts.where("doc_id >= 5 or doc_id is null")))
    rollup.commit("delete-rest", token_counts.deletes(new))
    assert rollup.totals().count() == 0 and rollup.batches() == ["delete", "delete-rest", "load", "nothing", "revise"]
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)


def test_sharding(spark, docs, empty):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    share = collections.Counter(table)
    assert set(table) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    got = sharding.place(docs, shards=names, slots=1009).collect()
    assert len(got) == len(base_rows())
    for r in got:
        slot = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    odd = sharding.place(docs.select("doc_id", *[F.lit(1).alias(c) for c in ("at_slot", "_at_slot", "AT_SHARD", "slot", "_slot", "_shard")]), shards=names, slots=1009)
    assert odd.columns == ["doc_id", "at_slot", "_at_slot", "AT_SHARD", "_slot", "_shard", "slot", "shard"] and odd.count() == len(base_rows())
    assert sharding.place(empty, shards=names, slots=1009).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_packing(spark, docs, empty):
    got = packing.pack(docs.where("doc_id is not null and (doc_id != 2 or n_chars is not null)").dropDuplicates(["doc_id"]), PATH).collect()
    bpe, by = wordbpe.word_bpe(PATH), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 and 1 << r.bucket == r.length for r in got)
    texts = {i: t or "" for i, t, *_ in base_rows()[: len(by)]}
    for i, rows in by.items():
        ids, at = bpe.encode(texts[i]) + (2).to_bytes(4, "little"), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert packing.pack(empty, PATH).count() == 0
    assert list(packing.pieces(11, 4)) == [(0, 4), (4, 4), (8, 2), (10, 1)]


def crc_by_bits(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg():
    rng = random.Random(1)
    for size in (0, 1, 254, 255, 256, 510, 576):
        data = rng.randbytes(size)
        assert media.checksum(data) == crc_by_bits(data)
    packets = [(rng.randbytes(n), k) for k, n in enumerate((10, 0, 255, 510, 70_000, 3, 200_000, 65_025))]
    other = [(b"x" * 300, 5)]
    stored = media.mux({1: packets, 2: other})
    got = media.demux(stored)
    assert got[1]["packets"] == [p for p, _ in packets] and got[2]["packets"] == [p for p, _ in other] and got[1]["granules"][-1] == 7
    page = media.mux({1: [(b"a" * 10, 10), (b"b" * 5, 15), (b"c" * 7, 22)]})
    assert media.demux(page)[1]["granules"] == [10, 15, 22]
    for at in (5, 40, len(stored) // 2, len(stored) - 1):
        with pytest.raises(ValueError):
            media.demux(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])
    with pytest.raises(ValueError):
        media.demux(stored[:-3])


def test_media(spark, docs, empty):
    got = media.features(docs).collect()
    assert len(got) == len(base_rows()) and media.features(empty).count() == 0
    want = collections.Counter()
    for i, t, *_ in base_rows():
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(media.decode(bytes(r.media))[0] >= 0 for r in media.media_column(docs).take(3))


def plain_index(held, labels, documents, df, smoothing=4.0):
    """Vectors of examples and a function from a text's counts to its vector, by the stated weights."""
    toxic, rows = sum(labels), len(labels)
    part = toxic / rows
    a, c = (collections.Counter(x for h, y in zip(held, labels, strict=True) if y == side for x in h) for side in (1, 0))
    rate = lambda n, side: (n + smoothing * (part if side else 1 - part)) / (toxic if side else rows - toxic)
    weight = {x: math.log((documents + 1) / df[x]) * rate(a[x], 1) / rate(c[x], 0) for x in df}

    def vector(counts):
        v = {x: (1 + math.log(k)) * weight.get(x, math.log(rows + 1)) for x, k in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items() if k in weight} if norm else {}

    return [vector(x) for x in held], vector


def test_nearest_is_exact():
    """Frequent terms (bounded by blocks) and rare ones (lists) together, ties, texts with unknown terms, without known ones, and examples left out."""
    rng = random.Random(1)
    text = lambda top: " ".join(f"w{min(top, int(rng.paretovariate(0.6)))}" for _ in range(rng.randint(0, 200)))
    held = [toxicity.terms(t) for t in [text(2999) for _ in range(500)] + ["same words"] * 30]
    labels = [int(i % 5 == 0) for i in range(530)]
    df = collections.Counter(x for h in held for x in h)
    place = {x: k for k, x in enumerate(sorted(df))}
    columns = [np.array([place[x] for x in h], np.int64) for h in held]
    index = toxicity.BlockMax(list(range(530)), labels, columns, [np.array(list(h.values()), np.int64) for h in held], place, np.array([df[x] for x in place]), 900)
    vectors, vector = plain_index(held, labels, 900, df)
    vectors = [vectors[k] for k in index.names.tolist()]
    assert index.dense.shape[1] > 5 and sorted(index.names.tolist()) == list(range(530))
    asked = [toxicity.terms(t) for t in [text(4000) for _ in range(200)] + ["", "unheard", "same words"]]
    for n, c in enumerate(asked):
        v, skip = vector(c), n if n % 3 == 0 else -1
        want = [(-s, i) for s, i in sorted((-round(sum(x * u.get(k, 0) for k, x in v.items()), 9), i) for i, u in enumerate(vectors) if i != skip) if s < 0][:15]
        got = index.nearest(*index.vector(c), without=skip)
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-9) and len(got) == len(want)
        clear = [i for k, (s, i) in enumerate(want) if all(abs(s - o) > 3e-9 for m, (o, _) in enumerate(want) if m != k)]
        assert set(clear[:-1]) <= {i for _, i in got}


def test_scores_equal_the_plain_version(spark):
    """The whole query: frequencies over all texts, votes of the exact neighbours, isotonic steps."""
    rng = random.Random(21)
    word = lambda: f"w{min(400, int(rng.paretovariate(0.7)))}"
    texts = {i: " ".join([word() for _ in range(rng.randint(1, 60))] + ["vile"] * (rng.random() < (0.8 if i % 4 == 0 else 0.05))) for i in range(300)}
    labels = {i: int(i % 4 == 0) for i in range(0, 240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    counts = {i: toxicity.terms(t) for i, t in texts.items()}
    names = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    y = [labels[i] for i in names]
    known = {x for i in names for x in counts[i]}
    df = collections.Counter(x for c in counts.values() for x in c if x in known)
    vectors, vector = plain_index([counts[i] for i in names], y, 300, df)

    def near(v, skip=None):
        rated = [(-round(sum(x * u.get(k, 0) for k, x in v.items()), 9), i) for i, u in zip(names, vectors, strict=True) if i != skip]
        return sorted(r for r in rated if r[0] < 0)[:15]

    def vote(found):
        w = [1 / (1.1 + s) for s, _ in found]
        return (sum(a * labels[i] for a, (s, i) in zip(w, found, strict=True)) + 0.05 * sum(y) / len(y)) / (sum(w) + 0.05)

    steps, levels = toxicity.isotonic([vote(near(v, i)) for i, v in zip(names, vectors, strict=True)], y)
    off = 0
    for i in texts:
        found = near(vector(counts[i]))
        want = np.interp(round(vote(found), 6), steps, levels) if found else sum(y) / len(y)
        assert [round(e.cosine, 6) for e in got[i].evidence] == [round(-s, 6) for s, _ in found[:3]]
        off += abs(want - got[i].score) > 1e-6  # neighbours of equal cosine may be others
    assert off <= 6
    seen = [r for i, r in got.items() if i in labels and r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in seen]) > 0.8 and len({r.score for r in got.values()}) > 4


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone"]) for _ in range(30))
    rows = [(i, plain() + (" vilething nastyword" if i % 4 == 0 else ""), "en", "s", 1, 1, 1) for i in range(400)]
    d = spark.createDataFrame([*rows, (1000, None, None, None, None, None, None), (None, "vilething", None, None, None, None, None), rows[0]], DDL)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1, None, None), (9999, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(d, labels).collect()
    assert len(got) == 403
    for r in got:
        toxic = r.doc_id is None or (r.doc_id < 400 and r.doc_id % 4 == 0)
        assert r.predicted == int(toxic) and 0 <= r.score <= 1 and bool(r.evidence) == (r.doc_id != 1000)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}


def test_a_copy_finds_its_example(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)]
    labels = [(i, int(i % 6 == 0)) for i in range(60)]
    train = [i for i, y in labels if y and zlib.crc32(str(i).encode()) % 5]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 0)
    docs = spark.createDataFrame([*enumerate(texts), (held, texts[train[0]])], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    best = got[held].evidence[0]
    assert len(got) == 61 and got[held].held_out and (best.doc_id, best.toxic) == (train[0], 1) and abs(best.cosine - 1) < 1e-6


def test_lm(spark, docs, empty):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm.scores(docs, train).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in base_rows() if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t, *_ in base_rows())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.scores(empty, train).count() == 0


def test_lm_score_equals_plain_interpolation(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "learn", lambda cells, uniform, rounds=200: {-1: (0.5, 0.3, 0.2)})
    got = lm.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, *_ in base_rows():
        if not held(i):
            w = tok(t)
            one.update(w)
            two.update(zip(["<", *w], w))
            before.update(["<", *w[:-1]])
    n, v = sum(one.values()), len(one)
    p = lambda h, w: 0.5 * two[h, w] / max(1, before[h]) + 0.3 * one[w] / n + 0.2 / (v + 1)
    want = sorted((str(i), round(sum(math.log10(p(h, w)) for h, w in zip(["<", *tok(t)], tok(t))), 6)) for i, t, *_ in base_rows())
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_lm_sums_beyond_32_bits():
    keys, counts = [np.array([5, 9], np.uint64)] * 3, [np.array([2**32 - 1, 1], np.uint32)] * 3
    total, main, facts = lm._summed(keys, counts, [False, False, True])
    assert total[0].tolist() == [3 * (2**32 - 1), 3] and main[2].tolist() == [2 * (2**32 - 1), 2] and facts[0] == 3 * 2**32
    back = lm._widened([total[0].tobytes(), np.array([7], np.uint32).tobytes(), b""], np.array([2, 1, 0]))
    assert back.tolist() == [3 * (2**32 - 1), 3, 7]


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    cells = [(0, float(p2), float(p1), 1) for p2, p1 in rng.random((500, 2))]
    w = lm.learn(cells, 0.1)[0]
    score = lambda x: sum(math.log(x[0] * p2 + x[1] * p1 + x[2] * 0.1) for _, p2, p1, _ in cells)
    assert abs(sum(w) - 1) < 1e-9 and all(score(w) >= score(o) - 1e-3 for o in [(1 / 3, 1 / 3, 1 / 3), (0.6, 0.3, 0.1), (0.4, 0.5, 0.1)])


def char_sets(x):
    return {x[i : i + 5] for i in range(max(1, len(x) - 4))}


def test_lines(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    long = [" ".join(word() for _ in range(25)) for _ in range(30)]
    near = [x[:60] + "X" + x[61:] for x in long[:10]]
    rows = [(i, f"{x}\ns{i:02d}ok\n{x}", "en", "s", 1, 1, 1) for i, x in enumerate(long)] + [(100 + i, x + "\ns01ok", "en", "s", 1, 1, 1) for i, x in enumerate(near)]
    rows += [(200, None, None, None, None, None, None), (201, "", None, None, None, None, None), (None, long[0] + "\nown line of the nameless text", None, None, None, None, None), (300, "日本語の行は空白を含まないので全ての位置が使われる", None, None, None, None, None), (301, "日本語の行は空白を含まないので全ての位置が使われた", None, None, None, None, None)]
    got = {r.doc_id: r for r in lines.without_repeats(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[i].text == f"{x}\ns{i:02d}ok" for i, x in enumerate(long))
    assert all(got[100 + i].text == "" for i, x in enumerate(near) if len(char_sets(x) & char_sets(long[i])) >= 0.75 * len(char_sets(x) | char_sets(long[i])))
    assert got[200].text == "" and got[201].text == "" and got[None].text == "own line of the nameless text"
    assert got[300].n_removed == 0 and got[301].text == "" and got[0].n_lines == 3 and got[0].block == 1
    assert lines.without_repeats(empty).count() == 0


def test_lines_of_rows_that_share_an_id_are_kept(spark):
    line, other = "the only line that comes again in this test of rows", "a line of the third row and of no other one"
    rows = [(1, line), (None, f"{line}\nwhat the nameless second row has"), (None, f"{other}\nwhat the nameless third row has")]
    rows += [(5, "first text of the doubled id, alone"), (5, "another text that goes by number five"), (7, "twice the same row"), (7, "twice the same row"), (9, "Cookie policy"), (10, "Cookie policy\n\nx")]
    docs = spark.createDataFrame([(i, t, 1, "p", "b", 2) for i, t in rows], "doc_id long, text string, n_lines int, places string, `own.x` string, DOC int")
    out = lines.without_repeats(docs)
    assert out.columns == ["doc_id", "text", "places", "own.x", "DOC", "n_lines", "n_removed"]
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("1", line), ("None", "what the nameless second row has"), ("None", f"{other}\nwhat the nameless third row has"), ("5", rows[3][1]), ("5", rows[4][1]), ("7", rows[5][1]), ("7", rows[5][1]), ("9", "Cookie policy"), ("10", "\nx")])


def test_lines_equal_brute_force(spark):
    """500 lines: groups of near copies, lists that differ in a number, repeated characters, two edits in 87 characters."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    edit = lambda x, n: "".join(rng.choice("XYZ") if i in at else c for at in [rng.sample(range(len(x)), n)] for i, c in enumerate(x))
    texts, pairs = [], []
    for _ in range(120):
        x = " ".join(word() for _ in range(20))[:87]
        pairs.append((x, edit(x, 2)))
        texts += pairs[-1]
    group = " ".join(word() for _ in range(40))
    texts += [edit(group, rng.randint(1, 6)) for _ in range(120)]
    texts += [f"- https://www.example.com/news/article-{rng.randrange(10**9)}" for _ in range(60)]
    texts += ["=" * n for n in (24, 60, 200, 400)] + ["ab" * n for n in (90, 150, 300)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(70)]
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(texts))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for a in range(len(rows)) for b in range(a) if _jaccard_of(rows[a][1], rows[b][1]) >= 0.75]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    stays = {i for i in root if find(i) == i}
    got = {r.doc_id for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text}
    gone = set(root) | set(range(len(rows)))
    gone -= stays
    assert stays <= got and len(got - stays) <= 0.04 * len(gone)
    close = [(x, y) for x, y in pairs if _jaccard_of(x, y) >= 0.75]
    at = {x: i for i, x in rows}
    assert len(close) > 40 and sum(at[y] not in got for _, y in close) >= 0.9 * len(close)


def _jaccard_of(a, b):
    x, y = ({s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in (a, b))
    return len(x & y) / len(x | y)


def test_lines_verified_by_shingles_alone(spark):
    pairs = [
        ("- https://www.example.com/news/article-1", "- https://www.example.com/news/article-2"),
        ("Wissenschaftsgeschichte Forschungseinrichtung", "Wissenschaftsgeschichten Forschungseinrichtungen"),
        ("=" * 24, "=" * 60),
        ("the same words in this line of text", "text of line this in words same the"),
    ]
    got = [r.s for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", lines.similar("a", "b").alias("s")).orderBy("i").collect()]
    assert got == [_jaccard_of(*p) >= 0.75 for p in pairs] == [True, True, True, False]


def test_lines_meet_at_any_length_and_on_both_sides_of_the_old_switch(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    pairs = []
    for _ in range(300):
        x = " ".join(word(rng.randint(3, 8)) for _ in range(40))
        pairs.append((x, x[: math.ceil(0.78 * len(x))]))
    pairs += [(x := " ".join(word(23) for _ in range(6)), x.replace(" ", "", 3)) for _ in range(50)]
    pairs = [p for p in pairs if _jaccard_of(*p) >= 0.75]
    rows = [(i, s, k) for i, p in enumerate(pairs) for s, k in zip("ab", p, strict=True)]
    own = spark.createDataFrame([(i, s, k) for i, s, k in rows], "i int, side string, line string").withColumn("id", F.xxhash64("line"))
    signed = collections.defaultdict(set)
    for r in common.union(lines.signatures(own.select("id", "line"))).collect():
        signed[r.id].add(r.band)
    id_of = {(r.i, r.side): r.id for r in own.collect()}
    met = sum(bool(signed[id_of[i, "a"]] & signed[id_of[i, "b"]]) for i in range(len(pairs)))
    assert len(pairs) > 300 and met >= 0.93 * len(pairs)


@pytest.mark.parametrize("large", [64, 8])
def test_lines_of_one_bucket_are_all_joined(spark, monkeypatch, large):
    """One bucket with many pairs that only their two lines link, and a chain; the rest is a template."""
    monkeypatch.setattr(lines, "LARGE", large)
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base = [f"Archived copy: https://example.org/{hexes(40)} see also identifier-{hexes(32)}" for _ in range(30)]
    texts = base + [x[:-1] + "z" for x in base] + [base[0][:-1] + "zyx"]
    own = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("id", F.xxhash64("line"))
    own = own.select("id", "line")
    members = own.select(F.lit(1).cast("long").alias("band"), "id")
    marks = lines.marks_of(common.union(lines.signatures(own)), members)
    label = {r.node: r.component for r in components.components(lines.links(members, lines.texts_of(members, own), marks)).collect()}
    ids = {r.line: r.id for r in own.collect()}
    want = {frozenset(y for y in texts if _jaccard_of(x, y) >= 0.75) for x in texts}
    groups = collections.defaultdict(set)
    for x in texts:
        groups[label.get(ids[x], x)].add(x)
    assert len(want) == 30 and {frozenset(g) for g in groups.values()} == want


def test_lines_hold_one_row_of_marks_each_and_strangers_of_a_bucket_make_no_pairs(spark):
    """Before, a row for each band of a line was kept and shuffled, and lines that shared shingles were joined before their signatures were asked."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    texts = [" ".join(["Archived copy of the article:"] + [word() for _ in range(12)]) for _ in range(120)]
    texts += [texts[0][:-1] + "Z"]
    own = spark.createDataFrame([(x,) for x in texts], "line string").select(F.xxhash64("line").alias("id"), "line")
    tables = lines.signatures(own)
    assert spark.read.parquet(tables[0]._platen_path).count() == len(texts)
    placed = own.select(F.lit(1).cast("long").alias("band"), "id", F.col("id").alias("component"), F.lit(len(texts)).cast("long").alias("size"))
    ids = {r.line: r.id for r in own.collect()}
    for large in (4096, 8):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lines, "LARGE", large)
            pairs = {frozenset(r) for r in lines._pairs_between(placed, lines.marks_of(common.union(tables), own)).collect()}
        assert pairs == {frozenset((ids[texts[0]], ids[texts[-1]]))}


def test_lines_of_a_cloud_make_few_pairs_and_sketches_lose_no_link(spark):
    """Variants of one line at a similarity of about a half: before, nearly all their pairs were verified."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(80)]
    texts = [" ".join(word() if rng.random() < 0.09 else w for w in base) for _ in range(90)]
    texts += [t[:-9] + "Z" for t in texts[:30]] + ["abab" * 60, "abab" * 90, "é😀 " * 20 + texts[0], "short", "shor"]
    own = spark.createDataFrame([(x,) for x in texts], "line string").select(F.xxhash64("line").alias("id"), "line")
    placed = own.select(F.lit(1).cast("long").alias("band"), "id", F.col("id").alias("component"), F.lit(len(texts)).cast("long").alias("size"))
    ids = {r.line: r.id for r in own.collect()}
    links = {frozenset((ids[x], ids[y])) for x, y in itertools.combinations(texts, 2) if _jaccard_of(x, y) >= 0.75}
    half = {frozenset((ids[x], ids[y])) for x, y in itertools.combinations(texts, 2) if 0.4 <= _jaccard_of(x, y) < 0.75}
    marks = lines.marks_of(common.union(lines.signatures(own)), own)
    before = {frozenset(r) for r in lines._pairs_between(placed, marks).collect()}
    drawn = lines.sketches(placed, own)
    shingles = {ids[x]: len({x[i : i + 5] for i in range(max(1, len(x) - 4))}) for x in texts if x.isascii()}
    assert {r.id: r.n for r in drawn.collect() if r.id in shingles} == shingles
    pairs = {frozenset(r) for r in lines._pairs_between(placed, drawn, lines._within).collect()}
    assert len(links) >= 30 and links <= pairs and len(half) > 2_000
    assert len(before & half) > 0.8 * len(half) and len(pairs - links) < 0.1 * len(half)


def test_jaccard_pairs_come_from_their_first_common_shingle(spark):
    """Variants of one text: before, a pair was a row for each common shingle of its prefixes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(200)]
    docs = spark.createDataFrame([(k, " ".join(word() if rng.random() < 0.02 else w for w in base[: 200 - k % 7])) for k in range(40)], "doc_id long, text string")
    common.tune(spark)
    answers = common.kept(jaccard.sent(docs.coalesce(2), 3).groupBy("part").applyInArrow(jaccard._answer, jaccard.SENT), "test-answers")
    sets = common.kept(answers.groupBy("block").applyInArrow(jaccard._assemble, jaccard.SETS_OF), "test-sets")
    probes = jaccard._placed(jaccard.prefixes(sets), None).where("probe")
    rows = jaccard._met(probes).collect()
    each = jaccard._sides(probes, probes.alias("other")).where("rid_u < rid_v")
    each = each.where((F.col("place_u") <= F.col("n_u") - jaccard._shared("n_u", "n_v")) & (F.col("place_v") <= F.col("n_v") - jaccard._shared("n_u", "n_v"))).collect()
    assert {(r.u, r.v) for r in rows} == {(r.rid_u, r.rid_v) for r in each}
    assert len({(r.u, r.v) for r in rows}) > 300 and len(rows) < 1.2 * len({(r.u, r.v) for r in rows}) and len(each) > 4 * len(rows)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(2000 + k, 2001 + k) for k in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def pii_by_re(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if p) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(kinds)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii(spark, docs, empty):
    texts = ["a@b.cd_ef@g.hi", "x@y z@w.", "a@b..c a.b@c-d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.0 99999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1 (415) 555-0101 +49 30 1234567890123456 + 1 +1x", "日本 é😀 bob@ex.org 10.1.1.1", "a" * 20000 + "@", "1" * 20000, "a@b" + ".c" * 5000, "1 " * 6000 + "x", None, "", "@@@ ... +++", "a@b.c@d.e", "+" * 3000]
    rng = random.Random(6)
    texts += ["".join(rng.choice("a1.@+- ()5") for _ in range(300)) for _ in range(150)]
    texts += ["write to ana42 [at] web3 [dot] org today", "call (415) 555-0101 now", "card 4111.1111.1111.1111 ok", "host 10[.]0[.]0[.]7 up", "order 4111.1111.1111.1112", "version 999[.]1[.]1[.]1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.found(d).select("doc_id", *[f"n_{k}" for k in pii.KINDS], pii.told("base").alias("base"), pii.told("spans").alias("spans")).collect()
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        assert got[i].base == pii_by_re(t or ""), t
        assert set(got[i].base.split(",")) - {""} <= set(got[i].spans.split(","))
    assert [bool(got[len(texts) - 6 + k].spans) for k in range(6)] == [True, True, True, True, False, False]
    assert pii.found(empty).count() == 0 and pii.found(docs).count() == len(base_rows())


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, empty):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh  ") for _ in range(n))
    items = [(k, text(rng.randint(60, 120))) for k in range(8)] + [(50, None), (None, text(80)), (51, "too short")]
    items.append((60, items[0][1]))

    def edited(x, n):
        x = list(x)
        for _ in range(n):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [x[k], "q"]])
        return "".join(x)

    rows = [(i, text(150) + edited(items[i % 8][1], i % 13) + text(150)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, items[3][1].upper().replace(" ", "\n ")), (None, items[4][1])]
    d = spark.createDataFrame([(i, t, None, None, 1, 2, 3) for i, t in rows], DDL)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, b).collect()}
    want = {}
    for i, t in rows:
        for k, x in items:
            n = decontaminate.normal(x or "")
            if k is not None and len(n) >= 32 and (e := edit_distance_in(n, decontaminate.normal(t or ""))) <= int(len(n) * 0.08):
                want[(i, k)] = e
    assert {k: r.distance for k, r in got.items()} == want
    flagged = {i for i, _ in want}
    assert collections.Counter(r.doc_id for r in decontaminate.clean(d, b).collect()) == collections.Counter(i for i, _ in rows if i not in flagged)
    assert decontaminate.matches(empty, b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for k, (_, t, *_) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    return collections.Counter((r[0], len(sets[k]), least.get(find(k))) for k, r in enumerate(rows))


def test_jaccard(spark, docs, empty):
    assert collections.Counter(map(tuple, jaccard.joined(docs).collect())) == brute_components(base_rows())
    assert jaccard.joined(empty).count() == 0
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    hot, rows = [word() for _ in range(120)], []
    for i in range(220):
        w = list(hot)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w) if i % 5 else " ".join(hot[:60] + [word() for _ in range(60)])))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows)
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in brute_components(rows)})


def test_rows_that_share_an_id_stay_for_themselves(spark):
    # Row 8 shares three of four shingles with the second row 5.
    near, own = "one two three four five six seven", "quite another text of the same id"
    rows = [(3, near), (5, near), (5, own), (None, near), (None, "a nameless text of its own here"), (7, ""), (7, None), (8, own + " x"), (3, near)]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, doc int, `own` int")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("3", near), ("5", own), ("None", "a nameless text of its own here"), ("7", "")])


def test_many_near_copies_that_hardly_link(spark):
    """A base with copies of one to nine edits: those with more don't link, though they share its passages."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(150)], []
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(150), i % 10):
            w[k] = word()
        rows.append((i + 1, " ".join(w)))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows)
