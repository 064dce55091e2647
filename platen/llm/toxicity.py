"""Toxicity from the nearest labelled examples.

1. Examples are a bounded sample of labelled training rows, with all their terms: words,
   beginnings of long words, runs of marks. Document frequencies of these terms are counted over all texts.
2. A term weighs (1 + ln tf) * idf * how much likelier toxic examples have it than others
   (smoothed), so what tells the labels apart counts most and nothing is left out. A term that no example has weighs as the
   rarest of theirs; it lengthens the vector. All texts are compared in this one space.
3. Unit vectors make an inverted index. Examples are in blocks of 64, like ones together. Lists of rare
   terms are summed whole; what frequent terms can add to a block is bounded by their greatest weights in it,
   and only blocks whose bound reaches the kth best cosine are summed further. The nearest
   examples are exact; equal cosines go by the example's place.
4. Neighbours of both labels vote by closeness; isotonic regression over the examples, each without itself, turns
   votes into probabilities. Without a neighbour a text gets the rate of the examples. The nearest three are its evidence.

Scores are made in a scan of the texts, so nothing is shuffled but term counts.

Defined cases: null or empty text has no terms and gets the rate; null labels and labels of
unknown documents are ignored; without training labels every score is 0; of several labels of a
document the highest holds; of several texts of a labelled document the one of least hash is the
example; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled training rows that are used at most, the first by a hash; it bounds what the driver holds and broadcasts.
SAMPLE = 4_000
#: Rows that are added to a term's counts, shared as the labels are.
SMOOTHING = 4.0
NEIGHBOURS = 15
BLOCK = 64
#: Terms that more than one in so many examples has are frequent.
FREQUENT = 4
#: Blocks that are summed before the others' bounds are tested again.
FIRST = 8

_words = re.compile(r"[^\W_]+|[^\w\s]{2,}").findall


def terms(text: str) -> Counter:
    """How often a text has each word, the first five letters of longer ones (with a star), and runs of marks."""
    words = Counter(_words(text.lower()))
    begun: Counter = Counter()
    for w, n in words.items():
        if len(w) > 5:
            begun[w[:5] + "*"] += n
    words.update(begun)
    return words


def is_train(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def sample_of(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, toxic: bounded."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_train()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.whole_text().alias("text"), F.xxhash64(common.whole_text()).alias("text_hash"))


def _one_text(rows: DataFrame, tells: str) -> DataFrame:
    """Of several texts of a doc_id the one of least hash, whatever the order of rows."""
    least = rows.groupBy("doc_id").agg(F.min(tells).alias(tells))
    return rows.join(least, ["doc_id", tells], "left_semi").dropDuplicates(["doc_id"])


def isotonic(x: list[float], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: both ends of each step of the best non-decreasing fit, and its level, slightly drawn to the middle so that none is 0 or 1. Between steps the fit is a line."""
    steps: list[list[float]] = []
    groups: dict[float, list[int]] = {}
    for a, b in zip(x, y, strict=True):
        g = groups.setdefault(round(a, 6), [0, 0])
        g[0] += b
        g[1] += 1
    for a in sorted(groups):
        steps.append([a, a, *groups[a]])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            _, end, s, n = steps.pop()
            steps[-1][1] = end
            steps[-1][2] += s
            steps[-1][3] += n
    return np.array([e for a, z, _, _ in steps for e in (a, z)]), np.array([(s + 0.01) / (n + 0.02) for _, _, s, n in steps for _ in (0, 1)])


class BlockMax:
    """Unit vectors of the examples as an inverted index with a bound for each block.

    names, labels: of the examples; columns, counts: of each one's terms; place: term -> column; frequencies: in how many of
    `documents` texts each column's term is.
    """

    def __init__(self, names: list[int], labels: list[int], columns: list[np.ndarray], counts: list[np.ndarray], place: dict[str, int], frequencies: np.ndarray, documents: int):
        sizes = np.fromiter(map(len, columns), np.int64, len(columns))
        y = np.array(labels, np.int64)
        self.place, self.prior = place, float(y.mean()) if len(y) else 0.0
        self.unknown = np.log(len(y) + 1)
        row = np.repeat(np.arange(len(y)), sizes)
        col = np.concatenate(columns).astype(np.int64) if len(y) else np.empty(0, np.int64)
        toxic, clean = (np.bincount(col, y[row] == side, len(place)) for side in (1, 0))
        rate = lambda held, side, part: (held + SMOOTHING * part) / max(1, (y == side).sum())
        idf = np.where(frequencies > 0, np.log((documents + 1) / np.maximum(frequencies, 1)), 0.0)
        self.weight = idf * rate(toxic, 1, self.prior) / np.maximum(rate(clean, 0, 1 - self.prior), 1e-12)
        w = (1 + np.log(np.concatenate(counts))) * self.weight[col] if len(y) else np.empty(0)
        w /= np.maximum(np.sqrt(np.bincount(row, w * w, len(y))), 1e-300)[row]
        # Examples in the order of their heaviest terms, so that like ones share a block.
        heaviest = np.zeros(len(y), np.int64)
        rising = np.argsort(w, kind="stable")
        heaviest[row[rising]] = col[rising]
        order = np.lexsort((np.array(names, np.int64), heaviest))
        self.names, self.labels = np.array(names, np.int64)[order], y[order]
        row = np.argsort(order)[row] if len(y) else row
        self.blocks = -(-len(y) // BLOCK)
        often = np.bincount(col, minlength=len(place)) * FREQUENT > max(len(y), 64 * FREQUENT)
        self.frequent = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((self.blocks, int(often.sum()), BLOCK))
        mine = often[col]
        self.dense[row[mine] // BLOCK, self.frequent[col[mine]], row[mine] % BLOCK] = w[mine]
        self.most = self.dense.max(axis=2) if self.dense.size else np.zeros(self.dense.shape[:2])
        row, col, w = row[~mine], col[~mine], w[~mine]
        by = np.argsort(col, kind="stable")
        self.rows, self.weights = row[by].astype(np.int32), w[by]
        self.starts = np.searchsorted(col[by], np.arange(len(place) + 1))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of a text's known terms; the norm is that of all its terms."""
        # One lookup a term: the table is far larger than a cache, so lookups take the time.
        place = self.place.get
        at = np.array([place(t, -1) for t in counts], np.int64)
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        here = at >= 0
        rest = np.unique(tf[~here], return_counts=True)
        at, tf = at[here], tf[here]
        order = np.argsort(at)
        at, w = at[order], (1 + np.log(tf[order])) * self.weight[at[order]]
        # Unknown terms: all those of a count at once.
        square = sum(n * ((1 + np.log(c)) * self.unknown) ** 2 for c, n in zip(*(x.tolist() for x in rest), strict=True))
        norm = np.sqrt((w * w).sum() + square)
        return at, w / norm if norm else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest positive cosine: (cosine, place), ties by place. without: a place left out."""
        if not len(at):
            return []
        often = self.frequent[at] >= 0
        rare, x = at[~often], w[~often]
        first, size = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
        entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.bincount(self.rows[entry], np.repeat(x, size) * self.weights[entry], self.blocks * BLOCK).astype(float).reshape(-1, BLOCK)
        if without >= 0:
            sums[without // BLOCK, without % BLOCK] = -np.inf
        if often.any():
            mine, q = self.frequent[at[often]], w[often]
            bound = sums.max(axis=1) + self.most[:, mine] @ q
            turn = np.argsort(-bound, kind="stable")
            for part in (turn[:FIRST], turn[FIRST:]):
                # Partial sums are lower bounds too: weights are never negative.
                part = part[bound[part] >= self._kth(sums, k) - 1e-9]
                sums[part] += q @ self.dense[np.ix_(part, mine)]
        flat = np.round(sums.ravel()[: len(self.names)], 9)
        least = np.partition(flat, len(flat) - k)[len(flat) - k] if len(flat) > k else 0.0
        found = np.flatnonzero((flat > 0) & (flat >= least))
        best = found[np.lexsort((found, -flat[found]))[:k]]
        return [(float(flat[i]), int(i)) for i in best]

    @staticmethod
    def _kth(sums: np.ndarray, k: int) -> float:
        return max(0.0, np.partition(sums.ravel(), sums.size - k)[sums.size - k]) if sums.size > k else 0.0

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Label mean weighted by 1 / (distance + 0.1), distance being 1 - cosine; a twentieth of a weight goes to the rate of the examples."""
        weights = [1 / (1.1 - s) for s, _ in near]
        return (sum(w * float(self.labels[at]) for w, (_, at) in zip(weights, near, strict=True)) + 0.05 * self.prior) / (sum(weights) + 0.05)


class Model:
    """The index and the probabilities of its votes."""

    def __init__(self, index: BlockMax, counts: Iterator[Counter]):
        """counts: of the examples' terms, in the index's order."""
        self.index = index
        votes = [index.vote(index.nearest(*index.vector(c), without=at)) for at, c in enumerate(counts)]
        self.steps, self.levels = isotonic(votes, index.labels.tolist()) if votes else (np.array([0.0]), np.array([0.0]))

    def score(self, counts: Counter) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(*self.index.vector(counts))
        if not near:
            return self.index.prior, []
        return float(np.interp(round(self.index.vote(near), 6), self.steps, self.levels)), near


def frequencies(docs: DataFrame, place: dict[str, int]) -> np.ndarray:
    """In how many texts each term of the examples (bounded by the sample) is, by column."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        times = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                there = terms(text).keys() & known.keys()
                times[np.fromiter(map(known.__getitem__, there), np.int64, len(there))] += 1
        some = np.flatnonzero(times)
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(times[part], pa.int64())], names=["t", "times"])

    out = np.zeros(len(place), np.int64)
    if len(out):
        for r in docs.select(common.whole_text().alias("text")).mapInArrow(count, "t long, times long").groupBy("t").agg(F.sum("times").alias("times")).toLocalIterator():
            out[r.t] = r.times
    return out


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model. The driver holds the terms of the sample's texts: each term once, and arrays of their columns and counts."""
    common.tune(docs.sparkSession)
    sample = sample_of(labels, size)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(text) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(c) for c in found]), pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found], pa.binary())], names=["doc_id", "toxic", "terms", "c"])

    own = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", common.whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = _one_text(own, "h").select("doc_id", "toxic", "text").mapInArrow(features, "doc_id long, toxic int, terms string, c binary")
    place: dict[str, int] = {}
    examples = []
    for r in rows.toLocalIterator():
        columns = np.fromiter((place.setdefault(t, len(place)) for t in r.terms.split()), np.int32)
        examples.append((r.doc_id, int(r.toxic > 0), columns, np.frombuffer(r.c, np.int32)))
    examples.sort(key=lambda e: e[0])
    ids, toxic, columns, counts = zip(*examples, strict=True) if examples else ((), (), (), ())
    index = BlockMax(list(ids), list(toxic), list(columns), list(counts), place, frequencies(docs, place), docs.count())
    names, at = list(place), {d: k for k, d in enumerate(ids)}
    whole = (Counter({names[t]: n for t, n in zip(columns[k].tolist(), counts[k].tolist(), strict=True)}) for k in map(at.__getitem__, index.names.tolist()))
    return Model(index, whole)


SCHEMA = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>, text_hash long"


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest three examples), text_hash (tells rows of one doc_id apart)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            score, evidence = [], []
            for text in b.column(1).to_pylist():
                if text not in seen:
                    if len(seen) >= 2_000:
                        seen.clear()
                    s, near = m.score(terms(text))
                    seen[text] = s, [{"doc_id": int(m.index.names[at]), "cosine": c, "toxic": int(m.index.labels[at])} for c, at in near[:3]]
                s, e = seen[text]
                score.append(s)
                evidence.append(e)
            predicted = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(evidence, kind), b.column(2)], names=["doc_id", "score", "predicted", "evidence", "text_hash"])

    return _texts(docs).mapInArrow(run, SCHEMA).select("doc_id", F.coalesce(~is_train(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
