"""Language-model scores by deleted interpolation.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), the weights l depending on the
bucket of c(h), floor(log2) of it. Counts come from all training texts. The weights are learned
by expectation-maximisation on a part of the training texts that is deleted from the counts meanwhile.

How it is computed: texts are packed into blocks of about two million tokens, written once.
A block sends each of its distinct words and word pairs once, with its count, to the part that
owns the key; parts add up and answer; a block with its answers scores its texts alone. So
tokens are never rows, a word of any frequency costs a block one entry, and every task holds
a block or a part of bounded size. Words are known by 64-bit hashes, pairs by 40 bits and
their part, whose number grows with the input.

Defined cases: null or empty text is the end token alone; repeated rows are counted and scored
each; without training texts N = V = 0 and both scores rest on 1 / (V + 1); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_TOKENS = 2_000_000
PART_TOKENS = 2_000_000
#: Of training texts, one in this many is deleted to learn the weights.
DELETED = 20
#: The weights' statistics are kept by steps of an eighth of a power of two.
STEP = 8
BEGIN, END = 0, 1
_BEGIN_HASH, _END_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Word -> number within a block."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z alone; bytes.split() splits at 0x20 and 0x09-0x0D alone."""
    return text.lower().split()


BLOCKS = "block long, deleted boolean, n_tokens long, doc_ids binary, held binary, stream binary, words binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, train boolean, deleted boolean, text binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task, made = TaskContext.get().partitionId(), 0
        open_ = [([], [], [], _Words(), [0]) for _ in range(2)]

        def close(deleted: int) -> pa.RecordBatch:
            nonlocal made
            ids, held, parts, words, _ = open_[deleted]
            stream = np.concatenate(parts)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes = np.concatenate([np.array([_BEGIN_HASH, _END_HASH], np.uint64), hashes])
            row = [[task << 32 | made], [bool(deleted)], [len(stream)], [np.array(ids, np.int64).tobytes()], [bytes(held)], [stream.tobytes()], [hashes.tobytes()]]
            made += 1
            open_[deleted] = ([], [], [], _Words(), [0])
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            for doc_id, train, deleted, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = int(train and deleted)
                ids, held, parts, words, size = open_[k]
                found = tokens(text)
                part = np.empty(len(found) + 1, np.int32)
                part[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                part[-1] = END
                ids.append(doc_id or 0)
                held.append((not train) + 2 * (doc_id is None))
                parts.append(part)
                size[0] += len(part)
                if size[0] >= BLOCK_TOKENS:
                    yield close(k)
        for k in range(2):
            if open_[k][0]:
                yield close(k)

    return docs.mapInArrow(run, BLOCKS)


class _Block:
    """A block's arrays. Keys are in the order of their parts, so answers line up when they are put one behind the other."""

    def __init__(self, row: dict, parts: int):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        flags = np.frombuffer(row["held"], np.uint8)
        self.held, self.nameless = flags % 2 > 0, flags >= 2
        self.stream = np.frombuffer(row["stream"], np.int32)
        hashes = np.frombuffer(row["words"], np.uint64)
        self.ends = np.flatnonzero(self.stream == END)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        before = np.empty_like(self.stream)
        before[0] = BEGIN
        before[1:] = np.where(self.stream[:-1] == END, BEGIN, self.stream[:-1])
        self.before = before
        codes = before.astype(np.int64) * len(hashes) + self.stream
        self.pairs, self.pair_at = np.unique(codes, return_inverse=True)
        first, second = hashes[self.pairs // len(hashes)], hashes[self.pairs % len(hashes)]
        mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        self.pair_keys = mixed ^ (mixed >> np.uint64(31))
        self.hashes = hashes
        self.word_part = (hashes % np.uint64(parts)).astype(np.int64)
        self.pair_part = ((self.pair_keys & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
        self.word_order, self.pair_order = np.argsort(self.word_part, kind="stable"), np.argsort(self.pair_part, kind="stable")
        self.trained = np.repeat(~self.held, self.ends - self.starts + 1)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(self.stream[self.trained], minlength=len(self.hashes))
        pairs = np.bincount(self.pair_at[self.trained], minlength=len(self.pairs))
        return words.astype(np.uint32), pairs.astype(np.uint32)


KEYS = "part int, block long, deleted boolean, words binary, word_counts binary, high binary, low binary, pair_counts binary"


def keys_of(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("deleted", pa.bool_()), *((n, pa.binary()) for n in ("words", "word_counts", "high", "low", "pair_counts"))])
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row, parts)
                wc, pc = x.counts()
                w_cut = np.searchsorted(x.word_part[x.word_order], np.arange(parts + 1))
                p_cut = np.searchsorted(x.pair_part[x.pair_order], np.arange(parts + 1))
                out = []
                for k in range(parts):
                    w, p = x.word_order[w_cut[k] : w_cut[k + 1]], x.pair_order[p_cut[k] : p_cut[k + 1]]
                    top = x.pair_keys[p] >> np.uint64(24)
                    out.append({"part": k, "block": row["block"], "deleted": row["deleted"], "words": x.hashes[w].tobytes(), "word_counts": wc[w].tobytes(), "high": (top >> np.uint64(8)).astype(np.uint32).tobytes(), "low": top.astype(np.uint8).tobytes(), "pair_counts": pc[p].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.mapInArrow(run, KEYS)


ANSWERS = "block long, part int, words binary, pairs binary, main_words binary, main_pairs binary, n long, v long, main_n long, main_v long"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], deleted: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray], tuple[int, int, int, int]]:
    """For each block's keys the sums over all blocks, and over those that aren't deleted; then totals and numbers of distinct keys of both."""
    where = np.cumsum([0, *map(len, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, main = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for k, c in enumerate(counts):
        add = np.bincount(at[where[k] : where[k + 1]], weights=c, minlength=len(distinct)).astype(np.int64)
        total += add
        if not deleted[k]:
            main += add
    cut = [at[where[k] : where[k + 1]] for k in range(len(keys))]
    return [_narrow(total[c]) for c in cut], [_narrow(main[c]) for c in cut], (int(total.sum()), int((total > 0).sum()), int(main.sum()), int((main > 0).sum()))


def _narrow(sums: np.ndarray) -> np.ndarray:
    """32 bits a sum where all fit, else 64: readers tell them apart by the number of keys."""
    return sums.astype(np.uint32) if not len(sums) or sums.max() < 1 << 32 else sums.astype(np.uint64)


def _widened(answers: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The sums of parts one behind the other. sizes: keys of each part."""
    return np.concatenate([np.empty(0, np.int64), *(np.frombuffer(a, np.uint32 if len(a) == 4 * n else np.uint64).astype(np.int64) for a, n in zip(answers, sizes, strict=True))])


def _add_part(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    pairs = [np.frombuffer(r["high"], np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(r["low"], np.uint8) for r in rows]
    deleted = [r["deleted"] for r in rows]
    w_all, w_main, totals = _summed(words, [np.frombuffer(r["word_counts"], np.uint32) for r in rows], deleted)
    p_all, p_main, _ = _summed(pairs, [np.frombuffer(r["pair_counts"], np.uint32) for r in rows], deleted)
    out = [
        {"block": r["block"], "part": r["part"], "words": w_all[k].tobytes(), "pairs": p_all[k].tobytes(), "main_words": w_main[k].tobytes() if r["deleted"] else b"", "main_pairs": p_main[k].tobytes() if r["deleted"] else b"", "n": 0, "v": 0, "main_n": 0, "main_v": 0}
        for k, r in enumerate(rows)
    ]
    out.append(dict.fromkeys(("words", "pairs", "main_words", "main_pairs"), b"") | {"block": -1, "part": rows[0]["part"]} | dict(zip(("n", "v", "main_n", "main_v"), totals, strict=True)))
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("part", pa.int32()), *((n, pa.binary()) for n in ("words", "pairs", "main_words", "main_pairs")), *((n, pa.int64()) for n in ("n", "v", "main_n", "main_v"))]))


def _answered(x: _Block, answers: list[dict], words: str, pairs: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its count, its pair's count, its context's count."""
    answers = sorted(answers, key=lambda r: r["part"])
    w, p = np.empty(len(x.hashes), np.int64), np.empty(len(x.pairs), np.int64)
    parts = [r["part"] for r in answers]
    most = max(parts, default=-1) + 1
    w[x.word_order] = _widened([r[words] for r in answers], np.bincount(x.word_part, minlength=most)[parts])
    p[x.pair_order] = _widened([r[pairs] for r in answers], np.bincount(x.pair_part, minlength=most)[parts])
    w[BEGIN] = w[END]  # a text begins as often as it ends
    return w[x.stream], p[x.pair_at], w[x.before]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learn(cells: list[tuple[int, float, float, int]], uniform: float, rounds: int = 200) -> dict[int, tuple[float, float, float]]:
    """Expectation-maximisation for each bucket. cells: (bucket, pair probability, word probability, tokens). Key -1: over all buckets."""
    found = {}
    data = np.array(cells, float).reshape(-1, 4)
    for bucket in [-1, *sorted({int(c[0]) for c in cells})]:
        mine = data if bucket < 0 else data[data[:, 0] == bucket]
        if not len(mine):
            found[bucket] = (1 / 3, 1 / 3, 1 / 3)
            continue
        p = np.column_stack([mine[:, 1], mine[:, 2], np.full(len(mine), uniform)])
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            new = (share * mine[:, 3:]).sum(axis=0) / mine[:, 3].sum()
            new = np.maximum(new, [0, 1e-4, 1e-4])
            new /= new.sum()
            done = np.abs(new - weights).max() < 1e-7
            weights = new
            if done:
                break
        found[bucket] = tuple(map(float, weights))
    return found


def scores(docs: DataFrame, train) -> DataFrame:
    """docs: doc_id, text; train: a boolean column. doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    common.tune(spark)
    deleted = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("deleted")), F.lit(DELETED)) == 0
    texts = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), deleted.alias("deleted"), common.whole_text().cast("binary").alias("text"))
    blocks = common.kept(blocks_of(texts), "lm-blocks")
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // PART_TOKENS))
    answers = common.kept(keys_of(blocks, parts).groupBy("part").applyInArrow(_add_part, ANSWERS), "lm-answers")
    common.sweep(spark)
    sums = answers.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "main_n", "main_v")]).first()
    uniform, main_uniform, n, main_n, v = 1 / (sums.v + 1), 1 / (sums.main_v + 1), sums.n, max(1, sums.main_n), sums.v

    def cells(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple, int] = {}
        for row in left.to_pylist():
            x = _Block(row, parts)
            c1, c2, c = _answered(x, right.to_pylist(), "main_words", "main_pairs")
            none = -(10**6)
            with np.errstate(divide="ignore"):
                q2 = np.where(c2 > 0, np.round(np.log2(np.maximum(c2, 1) / np.maximum(c, 1)) * STEP), none)
                q1 = np.where(c1 > 0, np.round(np.log2(np.maximum(c1, 1) / main_n) * STEP), none)
            found, times = np.unique(np.column_stack([_bucket(c), q2, q1]).astype(np.int64), axis=0, return_counts=True)
            for f, t in zip(found.tolist(), times.tolist(), strict=True):
                out[tuple(f)] = out.get(tuple(f), 0) + t
        cols = list(zip(*((*k, t) for k, t in out.items()), strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["bucket", "q2", "q1", "times"])

    def by_block(df: DataFrame):
        return df.groupBy("block")

    gone = blocks.where("deleted")
    asked = answers.where("block >= 0 and octet_length(main_words) + octet_length(main_pairs) > 0")
    grid = by_block(gone).cogroup(by_block(asked)).applyInArrow(cells, "bucket long, q2 long, q1 long, times long")
    rows = grid.groupBy("bucket", "q2", "q1").agg(F.sum("times").alias("times")).collect() if sums.main_n else []
    back = lambda q: 0.0 if q <= -(10**6) else min(1.0, 2.0 ** (q / STEP))
    weights = learn(sorted((r.bucket, back(r.q2), back(r.q1), r.times) for r in rows), main_uniform)
    table = np.array([weights.get(b, weights[-1]) for b in range(66)])

    def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():
            x = _Block(row, parts)
            c1, c2, c = _answered(x, right.to_pylist(), "words", "pairs")
            w = table[_bucket(c)]
            p = w[:, 0] * c2 / np.maximum(c, 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] * uniform
            base = np.log10((c1 + 1) / (n + v + 1))
            add = np.add.reduceat
            made.append(
                pa.table(
                    {
                        "doc_id": pa.array(x.doc_ids, pa.int64(), mask=x.nameless),
                        "held_out": x.held,
                        "n_tokens": (x.ends - x.starts + 1).astype(np.int64),
                        "n_known": add((c1 > 0).astype(np.int64), x.starts),
                        "train_tokens": np.full(len(x.doc_ids), n, np.int64),
                        "base_score": add(base, x.starts),
                        "score": add(np.log10(p), x.starts),
                    }
                )
            )
        return pa.concat_tables(made)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block(blocks).cogroup(by_block(answers.where("block >= 0"))).applyInArrow(score, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return scores(common.documents(spark, sf_dir), train)
