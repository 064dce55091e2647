"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Sets are distinct five-word shingles; texts link at a Jaccard similarity of 0.75 or more.

1. Texts are packed into blocks. A block sends each shingle's hash once a text to the part that
   owns it; the part knows in how many texts a shingle lies, and answers with those that lie in
   several. Equal sets become one class there, represented by its first row; a block sends a
   class once, however many copies it holds.
2. Shingles are ordered from rare to frequent. A text whose similarity may reach the threshold
   shares l shingles within the first n - ceil(0.75 n) + l of this order. Each text picks the l
   (up to 8) of least estimated cost: list entries read, and candidates left to verify. Two texts
   are compared by the smaller l: only pairs with that many common prefix shingles are verified.
   All such bounds hold at once, so pairs come from the shortest prefixes (l = 1) alone, where
   frequent shingles are fewest, and are counted over the longer ones before any set is intersected.
3. At each shingle one text is the leader: first the one with fewest rare shingles, the middle of
   a group of copies, in later turns one drawn by a hash. Each text is verified against the
   leaders with which it shares most; turns go on while they join texts and many pairs are
   left, so nearly all of any large group is joined. Then only pairs of texts in different
   components are generated, so a group of copies never yields all its pairs.
4. Verification intersects the sets exactly; components come from star rounds.

Shingles are known by 64-bit hashes within a text, and by 40 bits and their part between texts.

Defined cases: null, empty or blank text has an empty set and links with nothing; a text under
five words is one shingle; repeated rows are equal sets; a null doc_id never names a component;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: The threshold in hundredths.
PERCENT = 75
MOST_MATCHES = 8
BLOCK_SHINGLES = 2_000_000
PART_SHINGLES = 2_000_000
#: Verifying a pair costs as much as reading so many list entries.
VERIFY_COST = 40.0
#: Turns of leaders at most, leaders that a text is verified against in a turn, and open pairs a row below which turns end. They also end when a turn finds a fiftieth of the best turn's links. Any numbers give the same components.
STAR_TURNS, LEADERS, FEW = 8, 4, 16
#: Shingles of fewer than 2^RARE texts don't count towards the middle of a group.
RARE = 5
#: Shingles before one that tell whether a pair has met already. Any number gives the same pairs; fewer give them more often.
BEFORE = 4
#: Row ids: block number, then the row's place in its block.
ROW_BITS = 21


class _Hashes(dict):
    def __init__(self):
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.hash(word)
        return n


def shingles(text: bytes, hashes: dict) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = max(1, len(h) - WORDS + 1)
    out = np.full(m, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


SENT = "part int, block long, kind int, a binary, b binary, c binary"
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
DOCS, SETS, TOKENS = 0, 1, 2


def _send(block: int, ids: list, owns: list, sets: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """DOCS: ids (null as 0) and hashes of the texts, sizes with the sign of null ids, class digests. SETS: digests and first rows. TOKENS: upper 40 bits of the hashes, and rows as differences."""
    import xxhash

    digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flags = np.where([i is None for i in ids], -1 - sizes, sizes)
    rows = [{"part": block % parts, "block": block, "kind": DOCS, "a": np.array([i or 0 for i in ids] + owns, np.int64).tobytes(), "b": flags.tobytes(), "c": b"".join(digests)}]
    first: dict[bytes, int] = {}
    for k, d in enumerate(digests):
        if sizes[k]:
            first.setdefault(d, k)
    owned: dict[int, list[bytes]] = {}
    for d in first:
        owned.setdefault(int.from_bytes(d[:8], "little") % parts, []).append(d)
    for part, ds in owned.items():
        rows.append({"part": part, "block": block, "kind": SETS, "a": b"".join(ds), "b": np.array([first[d] for d in ds], np.int64).tobytes(), "c": b""})
    # One of a block's equal sets sends its shingles; the part must learn how often a set's shingles occur, so more than one class counts, not copies.
    chosen = sorted(first.values())
    tokens = np.concatenate([sets[k] for k in chosen]) if chosen else np.empty(0, np.uint64)
    at = np.repeat(np.array(chosen, np.int32), sizes[chosen]) if chosen else np.empty(0, np.int32)
    part = ((tokens & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            mine = order[cut[p] : cut[p + 1]]
            key, where = tokens[mine] >> np.uint64(24), at[mine]
            steps = np.diff(where, prepend=0).astype(np.uint32)
            rows.append({"part": p, "block": block, "kind": TOKENS, "a": (key >> np.uint64(8)).astype(np.uint32).tobytes(), "b": key.astype(np.uint8).tobytes(), "c": steps.view(np.uint8).reshape(-1, 4).T.tobytes()})
    for k in range(0, len(rows), 500):
        yield pa.RecordBatch.from_pylist(rows[k : k + 500], _SENT)


def sent(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, owns, sets, size, hashes = [], [], [], 0, _Hashes()
        for b in batches:
            for doc_id, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(doc_id)
                owns.append(own)
                sets.append(shingles(text, hashes))
                size += len(sets[-1])
                if size >= BLOCK_SHINGLES or len(ids) >= 1 << 16:
                    yield from _send(task << 18 | made, ids, owns, sets, parts)
                    ids, owns, sets, size, hashes, made = [], [], [], 0, _Hashes(), made + 1
        if ids:
            yield from _send(task << 18 | made, ids, owns, sets, parts)

    return docs.select("doc_id", common.whole_text().cast("binary").alias("text"), F.xxhash64(common.whole_text()).alias("own")).mapInArrow(run, SENT)


def _steps_back(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64))


def _answer(table: pa.Table) -> pa.Table:
    """DOCS pass. SETS: digest -> row id of the class's first row. TOKENS: of those in several rows the global token (six bits of frequency, then the key), and rows."""
    out, rows = [], table.to_pylist()
    classes: dict[bytes, int] = {}
    for r in rows:
        if r["kind"] == SETS:
            for k, at in enumerate(np.frombuffer(r["b"], np.int64)):
                d, rid = r["a"][16 * k : 16 * k + 16], r["block"] << ROW_BITS | int(at)
                classes[d] = min(rid, classes.get(d, rid))
    for r in rows:
        if r["kind"] == DOCS:
            out.append(r)
        elif r["kind"] == SETS:
            first = [classes[r["a"][k : k + 16]] for k in range(0, len(r["a"]), 16)]
            out.append(r | {"b": np.array(first, np.int64).tobytes()})
    token_rows = [r for r in rows if r["kind"] == TOKENS]
    if token_rows:
        keys = [np.frombuffer(r["a"], np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(r["b"], np.uint8) for r in token_rows]
        cut = np.cumsum([0, *map(len, keys)])
        distinct, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        frequency = np.floor(np.log2(times)).astype(np.uint64)
        tokens = frequency << np.uint64(58) | distinct << np.uint64(18) | np.uint64(rows[0]["part"] & 0x3FFFF)
        for k, r in enumerate(token_rows):
            mine = at[cut[k] : cut[k + 1]]
            several = times[mine] > 1
            if several.any():
                out.append(r | {"a": tokens[mine[several]].tobytes(), "b": _steps_back(r["c"])[several].astype(np.int32).tobytes(), "c": b""})
    return pa.Table.from_pylist(out, _SENT)


SETS_OF = "rid long, doc_id long, own long, n long, first long, tokens binary"
_SETS_OF = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("tokens", pa.binary())])


def _assemble(table: pa.Table) -> pa.Table:
    """A row per text: row id, doc_id, hash of the text, set size, its class's first row, and for a first row its shared tokens, rare ones first."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["kind"] == DOCS)
    block = docs["block"]
    first: dict[bytes, int] = {}
    for r in rows:
        if r["kind"] == SETS:
            first.update(zip((r["a"][k : k + 16] for k in range(0, len(r["a"]), 16)), np.frombuffer(r["b"], np.int64).tolist(), strict=True))
    flags = np.frombuffer(docs["b"], np.int64)
    ids, owns = np.frombuffer(docs["a"], np.int64).reshape(2, -1)
    n = np.where(flags < 0, -1 - flags, flags)
    token_rows = [r for r in rows if r["kind"] == TOKENS]
    tokens = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in token_rows]) if token_rows else np.empty(0, np.uint64)
    at = np.concatenate([np.frombuffer(r["b"], np.int32) for r in token_rows]) if token_rows else np.empty(0, np.int32)
    order = np.lexsort((tokens, at))
    tokens, at = tokens[order], at[order]
    cut = np.searchsorted(at, np.arange(len(ids) + 1))
    rids = [block << ROW_BITS | k for k in range(len(ids))]
    classes = [first.get(docs["c"][16 * k : 16 * k + 16], rids[k]) if n[k] else rids[k] for k in range(len(ids))]
    held = [tokens[cut[k] : cut[k + 1]].tobytes() if classes[k] == rids[k] else None for k in range(len(ids))]
    return pa.Table.from_arrays([pa.array(rids, pa.int64()), pa.array(ids, pa.int64(), mask=flags < 0), pa.array(owns, pa.int64()), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(held, pa.binary())], schema=_SETS_OF)


def required(n: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-PERCENT * n // 100)


def choose_prefix(n: int, tokens: np.ndarray) -> tuple[int, int]:
    """(matches asked for, shared tokens in the prefix). Tokens of one text alone come first and reach no list."""
    alone, least = n - len(tokens), required(n)
    frequency = np.exp2((tokens >> np.uint64(58)).astype(float) + 0.5)
    read = np.concatenate([[0.0], np.cumsum(frequency)])
    best = None
    for matches in range(1, min(MOST_MATCHES, least) + 1):
        size = min(len(tokens), max(0, n - least + matches - alone))
        cost = read[size] + VERIFY_COST * read[size] / matches
        if best is None or cost < best[0]:
            best = cost, matches, size
    return best[1:]


PREFIX = "token long, rid long, n long, matches int, place int, first int, before array<long>"


def _before(tokens: np.ndarray) -> pa.ListArray:
    """For each token the BEFORE ones before it."""
    size = np.minimum(np.arange(len(tokens)), BEFORE)
    ends = np.cumsum(size)
    at = np.arange(size.sum()) + np.repeat(np.arange(len(tokens)) - ends, size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens[at], pa.int64()))


def prefixes(sets: DataFrame) -> DataFrame:
    """A row for each shared token in a text's prefix, with the token's place in the text's order, first: how many of the text's shingles fewer than 2^RARE texts have, and the tokens just before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
            before = [_before(np.empty(0, np.int64))]
            for rid, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                matches, size = choose_prefix(n, tokens)
                if size:
                    place = np.arange(size) + (n - len(tokens))
                    # Shingles that another text may have but hardly any does come before those of a group.
                    rare = int(np.searchsorted(tokens >> np.uint64(58), np.uint64(RARE))) + n - len(tokens)
                    for part, x in zip(parts, (tokens[:size].view(np.int64), np.full(size, rid), np.full(size, n), np.full(size, matches), place, np.full(size, rare)), strict=True):
                        part.append(x)
                    before.append(_before(tokens[:size].view(np.int64)))
            columns = [pa.array(np.concatenate(p), t) for p, t in zip(parts, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(before)], names=[x.split()[0] for x in PREFIX.split(", ")])

    return sets.where("tokens is not null and octet_length(tokens) > 0").select("rid", "n", "tokens").mapInArrow(run, PREFIX)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs u, v, need the linked ones. A pair without need common shingles in its prefixes isn't intersected."""
    one = sets.where("tokens is not null").select(F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    two = one.withColumnsRenamed({"u": "v", "nu": "nv", "tu": "tv"})

    def linked(nu: int, nv: int, tu: bytes, tv: bytes, need: int) -> bool:
        x, y = np.frombuffer(tu, np.uint64), np.frombuffer(tv, np.uint64)
        q = -(-PERCENT * (nu + nv) // (100 + PERCENT))
        first = [t[: max(0, len(t) - q + need)] for t in (x, y)]
        if len(np.intersect1d(*first)) < need:
            return False
        both = len(np.intersect1d(x, y))
        return 100 * both >= PERCENT * (nu + nv - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(*r) for r in zip(*(b.column(c).to_pylist() for c in ("nu", "nv", "tu", "tv", "need")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "tu", "tv", "need").mapInArrow(run, "u long, v long")


_SIDE = ("rid", "n", "matches", "place", "component")
_PROBE = (*_SIDE, "before")


def _shared(n: str, other: str):
    """Shingles that linked sets of these sizes share at least."""
    return F.ceil(F.lit(PERCENT) * (F.col(n) + F.col(other)) / (100 + PERCENT))


def _sides(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = _SIDE) -> DataFrame:
    """Rows of a and b (suffixes _u, _v) that share a token, of texts in different components whose sizes may link."""
    both = a.select("token", *[F.col(c).alias(f"{c}_u") for c in columns]).join(b.select("token", *[F.col(c).alias(f"{c}_v") for c in columns]), "token")
    return both.where("component_u != component_v").where(100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v"))


def _near(placed: DataFrame, leaders: DataFrame) -> DataFrame:
    """u, v, need: each text and the leaders with which it shares most of its prefix.

    Texts of nu and nv shingles must share q = ceil(0.75 (nu + nv) / 1.75), so with l matches
    asked for, l of the first nu - q + l and nv - q + l shingles; for texts of like size that
    is a shorter prefix than either needs for the smallest partner it may have.
    """
    need = F.least("matches_u", "matches_v")
    both = _sides(placed, leaders)
    both = both.where((F.col("place_u") < F.col("n_u") - _shared("n_u", "n_v") + need) & (F.col("place_v") < F.col("n_v") - _shared("n_u", "n_v") + need))
    pairs = both.groupBy(F.col("rid_u").alias("u"), F.col("rid_v").alias("v")).agg(F.count("*").alias("times"), F.min(need).alias("need")).where("times >= need")
    most = pairs.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "v", "need")), False), 1, LEADERS).alias("x"))
    return most.select("u", F.explode("x").alias("x")).select("u", "x.v", "x.need")


def _met(probes: DataFrame) -> DataFrame:
    """u, v, need, hardly any twice: all pairs in different components that may link. Besides l of the first n - q + l shingles a linked pair shares one of the first n - q + 1; only those generate pairs. Where one of the tokens just before is common, its rows make the pair: its places are smaller, so no bound on places leaves it out, and texts in different components keep it."""
    both = _sides(probes, probes.alias("other"), _PROBE).where("rid_u < rid_v").where(~F.arrays_overlap("before_u", "before_v"))
    both = both.where((F.col("place_u") <= F.col("n_u") - _shared("n_u", "n_v")) & (F.col("place_v") <= F.col("n_v") - _shared("n_u", "n_v")))
    return both.select(F.col("rid_u").alias("u"), F.col("rid_v").alias("v"), F.least("matches_u", "matches_v").alias("need"))


def _placed(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows of tokens that lie in several components, with their text's component, its first place, and whether they may be the first that a pair shares (probe), as a kept table. Places are compared with what the smallest holder of a token asks for; no other partner asks for a longer prefix."""
    rows = prefix.select("token", "rid", "n", "matches", "place", "first", "before")
    if labels is None:
        rows = rows.withColumn("component", F.col("rid"))
    else:
        rows = rows.join(labels, rows.rid == labels.node, "left").select("token", "rid", "n", "matches", "place", "first", "before", F.coalesce("component", "rid").alias("component"))
        rows = common.kept(rows, "jaccard-labelled")
    lists = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"))
    mixed = common.kept(lists.where("low < high").select("token", "least"), "jaccard-mixed")
    late = F.col("place") - F.col("n") + F.ceil(F.lit(PERCENT) * (F.col("n") + F.greatest("least", F.ceil(F.lit(PERCENT) * F.col("n") / 100))) / (100 + PERCENT))
    placed = rows.join(mixed, "token").withColumn("late", late).where("late < matches").withColumn("probe", F.col("late") <= 0)
    out = common.kept(placed.drop("least", "late"), "jaccard-placed")
    common.drop_kept(mixed, *([rows] if labels is not None else []))
    return out


def _open_pairs(probes: DataFrame) -> tuple[int, int]:
    """Probe rows, and pairs of rows of a token in different components: what generating all of them would cost at most."""
    each = probes.groupBy("token", "component").agg(F.count("*").alias("c"))
    token = each.groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    found = token.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0.0)).alias("pairs")).first()
    return int(found.rows), int(found.pairs)


def links(sets: DataFrame) -> DataFrame:
    """Links (u, v) between class representatives: enough of them to join exactly the texts that links join."""
    prefix = common.kept(prefixes(sets), "jaccard-prefixes")
    placed = _placed(prefix, None)
    common.drop_kept(prefix)
    edges, most = None, 0
    for turn in range(STAR_TURNS):
        rows, pairs = _open_pairs(placed.where("probe"))
        if pairs <= FEW * rows:
            break
        # The text with the fewest shingles that are rare stands nearest to the middle of a group; later turns draw by hash.
        draw = F.col("first") if turn == 0 else F.lit(0)
        drawn = F.struct(draw.alias("near"), F.xxhash64("rid", F.lit(turn)).alias("draw"), *_SIDE)
        leaders = placed.groupBy("token").agg(F.min(drawn).alias("x")).select("token", *[F.col(f"x.{c}").alias(c) for c in _SIDE])
        leaders = common.kept(leaders, "jaccard-leaders")
        near = common.kept(verified(_near(placed, leaders), sets), "jaccard-links")
        common.drop_kept(leaders)
        found = near.count()
        most = max(most, found)
        if not found:
            break
        edges = near if edges is None else edges.union(near)
        before, placed = placed, _placed(placed, components(edges))
        common.drop_kept(before)
        if 50 * found < most:
            break
    far = common.kept(verified(_met(placed.where("probe")).distinct(), sets), "jaccard-links")
    common.drop_kept(placed)
    return far if edges is None else edges.union(far)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), n, component, as a kept table: a row for each row of docs."""
    spark = docs.sparkSession
    common.tune(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // (6 * PART_SHINGLES)))
    answers = common.kept(sent(docs, parts).groupBy("part").applyInArrow(_answer, SENT), "jaccard-answers")
    common.sweep(spark)
    sets = common.kept(answers.groupBy("block").applyInArrow(_assemble, SETS_OF), "jaccard-sets")
    common.drop_kept(answers)
    common.sweep(spark)
    labels = common.kept(components(links(sets)), "jaccard-labels")
    rows = sets.select("doc_id", "own", "n", "first")
    placed = rows.join(labels, rows["first"] == labels.node, "left").select("doc_id", "own", "n", F.coalesce("component", "first").alias("component"))
    placed = common.kept(placed, "jaccard-rows")
    common.drop_kept(sets, labels)
    return placed


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    placed = _rows(docs)
    names = common.kept(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-names")
    return placed.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


_LAST = 2**63 - 1


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of rows that link: the one of least doc_id (null last), then of least text hash. A row is known by doc_id and text, so rows that share an id stand for themselves; of equal rows one stays."""
    placed = _rows(docs).withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
    first = placed.groupBy("component").agg(F.min("doc").alias("first"))
    first = common.kept(first, "jaccard-first")
    there = placed.join(first, "component").where("doc = first").groupBy("component", "first").agg(F.min("own").alias("first_own"))
    stays = common.kept(there, "jaccard-stays")
    gone = placed.join(stays, "component").where("doc != first or own != first_own")
    doc, own = common.fresh(docs, "doc", "own")
    gone = common.kept(gone.select(F.col("doc").alias(doc), F.col("own").alias(own)).distinct(), "jaccard-gone")
    keyed = docs.withColumns({doc: F.coalesce(docs["doc_id"], F.lit(_LAST)), own: F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
    left = keyed.join(gone, [doc, own], "left_anti")
    return left.dropDuplicates([doc, own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.documents(spark, sf_dir))
