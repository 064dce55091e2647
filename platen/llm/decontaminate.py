"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of white space as one space. An
item of n characters may be found with up to int(n * 0.08) edits. It is split into one piece
more than that, so any such occurrence holds a piece unchanged: all pieces are looked for at
once (Aho-Corasick), and around each hit Myers' bit-parallel distance decides.

Items are held by every task, so they are taken in rounds of a bounded number of characters.

Defined cases: null or empty text matches nothing; null items and items under 32 characters are
left out; equal items match each; repeated rows are matched each; extra columns are kept by
`clean` and ignored by `matches`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 0.08
LEAST_CHARS = 32
#: Characters of items in a round; this bounds what is broadcast.
ROUND_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def split_pieces(n: int, parts: int) -> list[tuple[int, int]]:
    return [(j * n // parts, (j + 1) * n // parts) for j in range(parts)]


def _masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """Myers: the least distance of the pattern to any part of text that starts anywhere, and the first end of such a part; (most + 1, -1) if above."""
    ones, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & ones
        pv = (mh << 1 & ones) | ~(xv | ph) & ones
        mv = ph & xv
        if score < best:
            best, at = score, j
            if not best:
                break
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for i, text in items:
            if len(t := normal(text)) >= LEAST_CHARS:
                by_text.setdefault(t, []).append(i)
        self.items = [(t, sorted(ids), int(len(t) * rate), _masks(t), _masks(t[::-1])) for t, ids in sorted(by_text.items())]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (t, _, edits, _, _) in enumerate(self.items):
            for a, b in split_pieces(len(t), edits + 1):
                places.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best occurrence, in the normal form; the first of equals."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, diagonals in starts.items():
            item, ids, edits, masks, backward = self.items[k]
            if (at := text.find(item)) >= 0:
                found = 0, at, at + len(item)
            else:
                found = None
                for a, b in _windows(sorted(diagonals), len(item), edits, len(text)):
                    distance, stop = best_end(masks, len(item), text[a:b], edits)
                    if distance <= edits and (found is None or distance < found[0]):
                        stop += a
                        _, back = best_end(backward, len(item), text[max(a, stop - len(item) - edits) : stop][::-1], edits)
                        found = distance, stop - back, stop
            if found:
                out += [(i, *found) for i in ids]
        return sorted(out)


def _windows(diagonals: list[int], n: int, edits: int, size: int) -> Iterator[tuple[int, int]]:
    """Where an occurrence may lie for any of the starts, joined where they overlap."""
    begin = end = None
    for d in diagonals:
        a, b = max(0, d - edits), min(size, d + n + edits)
        if begin is None:
            begin, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield begin, end
            begin, end = a, b
    if begin is not None:
        yield begin, end


def matchers(items: DataFrame) -> Iterator:
    """A broadcast Matcher for each round of items."""
    spark = items.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    rounds = max(1, -(-chars // ROUND_CHARS))
    for k in range(rounds):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).collect() if rounds > 1 else items.collect()
        yield spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows])


SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each text and item found in it."""
    common.tune(docs.sparkSession)
    texts = docs.select("doc_id", common.whole_text().alias("text"))
    out = None
    for shared in matchers(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matcher.find(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; nothing is shuffled."""
    common.tune(docs.sparkSession)
    place = docs.columns.index("text")
    for shared in matchers(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for b in batches:
                yield b.filter(pa.array([not (t and matcher.find(t)) for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
