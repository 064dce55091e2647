"""Suffix-array deduplication by common-prefix intervals.

Removes every byte covered by a string of 400 bytes that also starts anywhere else.

1. Anchors. Of the 100-byte grams in every 400-byte window the one of least hash is its anchor
   (the first of equals), so equal windows have the same anchor at the same place, and a window
   is known by its distance to the left of it. Only anchors whose gram occurs again matter;
   counts by hash find them.
2. Contexts. All windows at an anchor lie within 300 bytes before it and 400 after its start.
   Anchors with equal contexts are one class: with two members, all its windows are repeats.
   One of each class goes on, to meet other classes of its gram.
3. Suffix array. Spark sorts the contexts of a gram by what follows the anchor; with the common
   prefixes of neighbours this is the enhanced suffix array of the suffixes that start there.
   The array of the suffixes that start a byte earlier follows from it by a stable sort on
   that byte, common prefixes by minima over what lay between. So the arrays of all 301 distances
   come one from another, for all grams of a task at once.
4. Intervals. In each array a stack scan finds the intervals of common prefixes of 400 bytes or
   more whose first window has this anchor, so no occurrence is elsewhere. An interval whose suffixes all have the same byte before them is part of a longer repeat, found one
   byte earlier; those with different bytes (or a text's start) are maximal repeats, and come
   out as groups with their length, the groups they lie in, and all occurrences.
5. A gram with over 256 contexts is split before it is sorted: its windows are halved by distance,
   and each half is grouped by the longer string that all its windows share. A half needs less
   context, so more contexts are equal: they are classes again, counted, and one of each goes on, until groups
   are small. A half of one window is one class. No task holds a hot gram whole.

A repeat is followed as far as its anchor's context; a longer one comes as groups that overlap,
one or more an anchor, whose union is exact. Contexts are compared byte by byte but for equal
classes, which have equal 128-bit hashes. What is removed is the union of all occurrences.

Defined cases: null text is empty; texts under 400 bytes have no repeats and count in nothing;
repeated rows are copies of each other; rows that share an id (or have none) are known by their
text as well; an empty table gives no rows; extra columns are ignored. Very long texts are read
in slabs, so memory beyond the text itself is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes of an anchor's gram.
GRAM = 100
#: Contexts of a gram that are sorted together at most.
MOST = 256
#: Windows of a text that are handled at once.
SLAB = 1 << 19
#: Contexts that a task holds at once, to whole grams.
CHUNK = 4096
_POSITION = np.uint64((1 << 20) - 1)
_BEFORE, _AFTER = b"\xff", b"\xfe"  # bytes that UTF-8 doesn't have

ANCHOR = "doc long, own long, pos int, near int, far int, left int, room int, hash long, xa long, xb long"
CONTEXT = "key long, half long, depth int, doc long, own long, at int, near int, far int, copies long, back binary, ahead binary"
GROUP = "id binary, length int, within array<binary>, docs array<long>, owns array<long>, starts array<int>, copies array<long>"
HALF = f"{CONTEXT}, xa long, xb long, start int, end int"
_CONTEXT = pa.schema([("key", pa.int64()), ("half", pa.int64()), ("depth", pa.int32()), ("doc", pa.int64()), ("own", pa.int64()), ("at", pa.int32()), ("near", pa.int32()), ("far", pa.int32()), ("copies", pa.int64()), ("back", pa.binary()), ("ahead", pa.binary())])
_HALF = pa.schema([*_CONTEXT, ("xa", pa.int64()), ("xb", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_GROUP = pa.schema([("id", pa.binary()), ("length", pa.int32()), ("within", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("owns", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64()))])


class Grams:
    """64-bit polynomial hashes of all grams of a slab, by sums over powers of an odd base."""

    def __init__(self, most: int):
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, inverse)]), dtype=np.uint64)
        self.letters = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, data: np.ndarray, gram: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[data] * self.powers[: len(data)], dtype=np.uint64)])
            h = (sums[gram:] - sums[:-gram]) * self.inverses[: len(data) - gram + 1]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours: running minima over blocks from both sides."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def anchors_of(text: bytes, grams: Grams, length: int = LENGTH, gram: int = GRAM, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, ascending; the first and the last window of each; and the hashes of their grams."""
    places, first, last, hashes = [], [], [], []
    for start in range(0, max(0, len(text) - length + 1), slab):
        data = np.frombuffer(text, np.uint8, min(len(text) - start, slab + length - 1), start)
        h = grams.hashes(data, gram)
        ranked = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        least = (window_minima(ranked, length - gram + 1) & _POSITION).astype(np.int64)
        at, window, windows = np.unique(least, return_index=True, return_counts=True)
        if places and places[-1][-1] == at[0] + start:  # an anchor with windows in two slabs
            last[-1][-1] = start + windows[0] - 1
            at, window, windows = at[1:], window[1:], windows[1:]
        if len(at):
            places.append(at + start)
            first.append(window + start)
            last.append(window + windows - 1 + start)
            hashes.append(h[at])
    if not places:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in (places, first, last, hashes))


_LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64(common.whole_text()).alias("own"), common.whole_text().cast("binary").alias("text"))


def anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor: its text, place, bytes of context on both sides, hash of the gram and of the context."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        grams = Grams(SLAB + length)
        for b in batches:
            for doc, own, text in zip(*(b.column(c) for c in ("doc", "own", "text")), strict=True):
                t = text.as_py()
                at, first, last, h = anchors_of(t, grams, length, gram)
                n = len(at)
                if n:
                    left, room = np.minimum(at, reach), np.minimum(len(t) - at, length)
                    x = b"".join(xxhash.xxh3_128_digest(t[p - a : p + z], a) for p, a, z in zip(at.tolist(), left.tolist(), room.tolist(), strict=True))
                    x = np.frombuffer(x, np.int64).reshape(-1, 2)
                    cells = (np.full(n, doc.as_py()), np.full(n, own.as_py()), at.astype(np.int32), (at - last).astype(np.int32), (at - first).astype(np.int32), left.astype(np.int32), room.astype(np.int32), h.view(np.int64), x[:, 0], x[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=[c.split()[0] for c in ANCHOR.split(", ")])

    return keyed.select("doc", "own", "text").mapInArrow(run, ANCHOR)


def contexts(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The contexts of the wanted anchors (doc, own, hash, pos, near, far, copies), split at the anchor."""
    reach = length - gram
    lists = wanted.groupBy("doc", "own").agg(F.collect_list(F.struct("hash", "pos", "near", "far", "copies")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for doc, own, text, places in zip(*(b.column(c) for c in ("doc", "own", "text", "wanted")), strict=True):
                # Rows of one text come one after another; one is enough.
                if last == (last := (doc.as_py(), own.as_py())):
                    continue
                t, rows = text.as_py(), places.as_py()
                cells = [(r["hash"], 0, reach, *last, r["pos"], r["near"], r["far"], r["copies"], t[max(0, r["pos"] - reach - 1) : r["pos"]], t[r["pos"] : r["pos"] + length]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)

    return keyed.select("doc", "own", "text").join(lists, ["doc", "own"]).mapInArrow(run, CONTEXT)


def halves(rows: DataFrame, length: int) -> DataFrame:
    """Each context twice: its windows of smaller and of greater distance, under the hash of the string that all windows of a half share, with the hash and the place of the context that the half needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        two = lambda data, seed: np.frombuffer(xxhash.xxh3_128_digest(data, seed & (2**64 - 1)), np.int64).tolist()
        for b in batches:
            cells = []
            for r in b.to_pylist():
                middle = r["depth"] // 2
                whole, cut = r["back"] + r["ahead"], len(r["back"])
                for near, far in ((0, middle), (middle + 1, r["depth"])):
                    # A window at distance j lies in the text if length - len(ahead) <= j <= len(back).
                    if near > cut or far < length - len(r["ahead"]) or near > r["far"] or far < r["near"]:
                        continue
                    core = whole[cut - near : cut - far + length]
                    key, half = two(core, r["key"] ^ r["half"] ^ near)
                    low, at = max(0, cut - far), cut - near
                    needed = whole[low : at + length]
                    xa, xb = two(needed, at - low)
                    start = r["at"] - near - (at - low)
                    cells.append((key, half, far - near, r["doc"], r["own"], r["at"] - near, r["near"] - near, r["far"] - near, r["copies"], whole[max(0, low - 1) : at], whole[at : at + length], xa, xb, start, start + len(needed)))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), _HALF, strict=True)], schema=_HALF)

    return rows.mapInArrow(run, HALF)


def first_array(ahead: list[bytes], bucket: np.ndarray, length: int) -> np.ndarray:
    """Common prefixes of neighbours of sorted suffixes; 0 where a bucket begins."""
    m = np.frombuffer(b"".join(a.ljust(length, _AFTER) for a in ahead), np.uint8).reshape(-1, length)
    sizes = np.fromiter(map(len, ahead), np.int64, len(ahead))
    out = np.zeros(len(ahead), np.int64)
    differ = m[1:] != m[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    out[1:] = np.where(bucket[1:] == bucket[:-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1])), 0)
    return out


def earlier_array(order: np.ndarray, common_: np.ndarray, group: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The array of the suffixes that start a byte earlier. order: rows in the present order; group: of each place, its bucket and the byte before; stays: places that go on."""
    places = np.flatnonzero(stays)
    places = places[np.argsort(group[places], kind="stable")]
    out = np.zeros(len(places), np.int64)
    if len(places) > 1:
        near = np.flatnonzero(group[places[1:]] == group[places[:-1]])
        if len(near):
            ends = np.stack([places[near] + 1, places[near + 1] + 1], axis=1).ravel()
            out[near + 1] = np.minimum.reduceat(np.append(common_, 0), ends)[::2] + 1
    return order[places], out


def intervals(common_: list[int], before: list[int], least: int, edge: bool) -> list[tuple[int, list[int], int]]:
    """Maximal repeats of a run of neighbours that all share `least` bytes: (length, occurrences that lie in no smaller group, number of the group around it or -1).

    common_[i]: what suffixes i and i + 1 share; before: the byte before each, below 0 at a
    text's start. An interval goes out if its bytes before differ (or at the edge of the
    context); else its occurrences count for the interval around it.
    """
    found: list[list] = []
    stack: list[list] = []  # common prefix, byte before or -1, occurrences, groups inside

    def joined(node: list, byte: int, rows: list[int], groups: list[int]) -> None:
        node[1] = node[1] if node[1] == byte else -1
        node[2] += rows
        node[3] += groups

    for i, byte in enumerate(before):
        after = common_[i] if i < len(common_) else 0
        item = (byte, [i], [])
        while stack and stack[-1][0] > after:
            joined(stack[-1], *item)
            size, byte_, rows, groups = stack.pop()
            if byte_ < 0 or edge:
                for g in groups:
                    found[g][2] = len(found)
                found.append([size, rows, -1])
                rows, groups = [], [len(found) - 1]
            item = (byte_, rows, groups)
        if after >= least:
            if stack and stack[-1][0] == after:
                joined(stack[-1], *item)
            else:
                stack.append([after, *item])
    return [tuple(x) for x in found]


def repeats_of(back: list[bytes], ahead: list[bytes], near: list[int], far: list[int], bucket: np.ndarray, depth: int, length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, list[int], int]], np.ndarray]]:
    """(distance, groups, rows of their places) of each run: the maximal repeats of contexts that are sorted by bucket and what follows.

    Of a run's suffixes the first `length` bytes are the same, so they all have this anchor for
    that window or none has; near and far are the distances between which they have.
    """
    width = depth + 1
    before = np.frombuffer(b"".join(x[-width:].rjust(width, _BEFORE) for x in back), np.uint8).reshape(-1, width)
    reach = np.fromiter(map(len, back), np.int64, len(back))
    near, far = np.array(near), np.array(far)
    order, shared = np.arange(len(back)), first_array(ahead, bucket, length)
    for distance in range(depth + 1):
        if len(order) < 2:
            return
        goes = reach[order] > distance
        byte = np.where(goes, before[order, width - 1 - distance].astype(np.int64), -1)
        long = shared >= length
        if long.any():
            starts = np.flatnonzero(long & ~np.append(False, long[:-1])) - 1
            ends = np.flatnonzero(long & ~np.append(long[1:], False)) + 1
            cuts = np.stack([starts, ends], axis=1).ravel()
            low, high = (f.reduceat(np.append(byte, 0), cuts)[::2] for f in (np.minimum, np.maximum))
            edge = np.full(len(starts), True) if distance == depth else far[order[starts]] == distance
            # Runs whose suffixes all have one byte before them go on whole, but at the edge.
            out = (near[order[starts]] <= distance) & (edge | (low != high) | (low < 0))
            for run in np.flatnonzero(out):
                a, b = starts[run], ends[run]
                yield distance, intervals(shared[a + 1 : b].tolist(), byte[a:b].tolist(), length, bool(edge[run])), order[a:b]
        if distance == depth:
            return
        most = np.maximum(shared, np.append(shared[1:], 0))
        stays = goes & (far[order] > distance) & (most + (depth - distance) >= length)
        order, shared = earlier_array(order, shared, bucket[order] * 256 + np.maximum(byte, 0), stays)


def _chunk_groups(rows: dict[str, list], length: int) -> Iterator[tuple]:
    """Groups of whole buckets of one depth, sorted by bucket and what follows the anchor."""
    keys = list(zip(rows["key"], rows["half"], strict=True))
    fresh = [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    bucket = np.cumsum(fresh) - 1
    depth = rows["depth"][0]
    for distance, groups, order in repeats_of(rows["back"], rows["ahead"], rows["near"], rows["far"], bucket, depth, length):
        order = order.tolist()
        first = order[0]
        stem = b"".join(x.to_bytes(8, "big", signed=True) for x in keys[first]) + depth.to_bytes(2, "big") + distance.to_bytes(2, "big")
        # Runs of a bucket and distance are told apart by a suffix of theirs.
        stem += hashlib.blake2b((rows["back"][first][-distance:] if distance else b"") + rows["ahead"][first][: length - distance], digest_size=8).digest()
        ids = [stem + g.to_bytes(2, "big") for g in range(len(groups))]
        for g, (size, places, around) in enumerate(groups):
            within = []
            while around >= 0:
                within.append(ids[around])
                around = groups[around][2]
            at = [order[p] for p in places]
            yield ids[g], size, within, [rows["doc"][k] for k in at], [rows["own"][k] for k in at], [rows["at"][k] - distance for k in at], [rows["copies"][k] for k in at]


def grouped(rows: DataFrame, length: int) -> DataFrame:
    """Maximal repeats of contexts of small grams: id, length, ids of the groups around it, and the occurrences that no smaller group has."""
    names = [f.name for f in _CONTEXT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        seen: set = set()

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(_chunk_groups(held, length)) if held["key"] else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _GROUP, strict=True)], schema=_GROUP)
            for c in names:
                held[c].clear()

        last = None
        for b in batches:
            for cells in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                place = cells[:3]
                if place != last:
                    seen = set()
                    if last and (len(held["key"]) >= CHUNK or last[2] != place[2]):
                        yield from flush()
                    last = place
                if cells[3:6] not in seen:  # repeated rows bring a context twice
                    seen.add(cells[3:6])
                    for c, v in zip(names, cells, strict=True):
                        held[c].append(v)
        yield from flush()

    return rows.repartition("key", "half", "depth").sortWithinPartitions("depth", "key", "half", "ahead").mapInArrow(run, GROUP)


_GRAM = ["key", "half", "depth"]


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_GRAM).agg(F.count("*").alias("size"))


def groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(maximal repeat groups, spans of texts whose context others have): kept tables.

    Groups: id, length, within, docs, owns, starts, copies; an occurrence is a text (doc, own)
    and a place in bytes, and stands for as many copies of its context.
    Spans: doc, own, start, end.
    """
    spark = docs.sparkSession
    common.tune(spark)
    keyed = _keyed(docs)
    every = common.kept(anchors(keyed, length, gram), "anchors")
    # Tables of their own, so that adaptive execution can split a hot gram's join.
    again = common.kept(every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-grams")
    several = common.kept(every.join(again, "hash", "left_semi"), "repeated-anchors")
    common.drop_kept(every, again)
    classes = common.kept(several.groupBy("hash", "xa", "xb").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "own", "pos", "near", "far")).alias("one")), "contexts")
    copies = several.join(classes.where("copies > 1").select("hash", "xa", "xb"), ["hash", "xa", "xb"], "left_semi")
    whole = common.kept(copies.select("doc", "own", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("room")).alias("end")), "copied-spans")
    common.drop_kept(several)
    met = common.kept(classes.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1").select("hash"), "met-grams")
    wanted = common.kept(classes.join(met, "hash", "left_semi").select("one.doc", "one.own", "hash", "one.pos", "one.near", "one.far", "copies"), "wanted")
    common.drop_kept(classes, met)
    rows = common.kept(contexts(keyed, wanted, length, gram), "gram-contexts")
    common.drop_kept(wanted)
    found, spans = [], [whole]
    while True:
        hot = common.kept(_sizes(rows).where(F.col("size") > most).select(*_GRAM), "hot-grams")
        if hot.isEmpty():
            found.append(common.kept(grouped(rows, length), "repeat-groups"))
            common.drop_kept(rows, hot)
            return common.union(found), common.union(spans)
        found.append(common.kept(grouped(rows.join(hot, _GRAM, "left_anti"), length), "repeat-groups"))
        crowded = common.kept(rows.join(hot, _GRAM, "left_semi"), "hot-contexts")
        common.drop_kept(rows, hot)
        split = common.kept(halves(crowded, length), "halved-contexts")
        common.drop_kept(crowded)
        equal = [*_GRAM, "xa", "xb"]
        classes = common.kept(split.groupBy(*equal).agg(F.count("*").alias("members"), F.sum("copies").alias("all_copies"), F.min(F.struct("doc", "own", "at")).alias("one")), "half-classes")
        spans.append(common.kept(split.join(classes.where("members > 1").select(*equal), equal, "left_semi").select("doc", "own", "start", "end"), "copied-spans"))
        sizes = common.kept(_sizes(classes).where("size > 1").select(*_GRAM), "met-grams")
        ones = common.kept(classes.join(sizes, _GRAM, "left_semi").select(*equal, "one.*", "all_copies"), "half-ones")
        kept = split.join(ones, [*equal, "doc", "own", "at"]).withColumn("copies", F.col("all_copies"))
        rows = common.kept(kept.select(*[f.name for f in _CONTEXT]), "gram-contexts")
        common.drop_kept(split, classes, sizes, ones)


def occurrences(found: DataFrame) -> DataFrame:
    """id, doc, own, start, copies: all occurrences of each group, those in smaller groups included."""
    zipped = found.select("id", "within", F.explode(F.arrays_zip("docs", "owns", "starts", "copies")).alias("x"))
    return zipped.select(F.explode(F.concat(F.array("id"), "within")).alias("id"), F.col("x.docs").alias("doc"), F.col("x.owns").alias("own"), F.col("x.starts").alias("start"), F.col("x.copies").alias("copies"))


def covered(found: DataFrame, whole: DataFrame) -> DataFrame:
    """doc, own, spans: of each text with repeats, all spans to remove, in no order."""
    own = found.select("length", F.explode(F.arrays_zip("docs", "owns", "starts")).alias("x")).select(F.col("x.docs").alias("doc"), F.col("x.owns").alias("own"), F.col("x.starts").alias("start"), (F.col("x.starts") + F.col("length")).alias("end"))
    return own.union(whole).groupBy("doc", "own").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: overlapping and touching spans are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


KEPT = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (bytes, end exclusive), kept (the remaining bytes)."""
    found, whole = groups(docs, length, gram, most)
    cuts = common.kept(covered(found, whole), "repeat-spans")
    keyed = _keyed(docs)
    rows = keyed.join(cuts, ["doc", "own"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, runs, kept = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                t = text.as_py()
                cut = merged([(s["start"], s["end"]) for s in spans.as_py() or []])
                ends = [0, *(e for _, e in cut)]
                kept.append(b"".join(t[a:z] for a, z in zip(ends, [*(s for s, _ in cut), len(t)], strict=True)))
                sizes.append(len(t))
                gone.append(sum(e - s for s, e in cut))
                runs.append([{"start": s, "end": e} for s, e in cut])
            cells = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, {KEPT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
