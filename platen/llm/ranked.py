"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

One pass over the texts counts the query terms of each document; the postings become a table
that is partitioned and sorted by term and falling impact, so a list's head and all that is above
a threshold are found by the statistics of its files. Hot terms span many partitions. For each query:

1. Heads: the first k postings of each list name documents, whose scores are looked up; the kth
   largest is a lower bound of a query's kth best score, far above that of partial sums.
2. Threshold: from every list of a query, all postings that bring at least the query's threshold:
   the greatest one for which lists, each cut at the threshold or at its own head, can't reach the
   bound together. So a document that was fetched from no list is out. A fetched one stays a
   candidate if its partial sum and what unseen lists can still bring reach the bound.
3. Look-up: candidates get their exact scores from their own term counts, for all queries at once.

Everything is an integer, so bounds are exact: a posting's part of a score is (times of the term in
the query) * w * impact. A round's lists (query, term, weight) are arrays that tasks look up; Spark
partitions postings, partial sums by document, and look-ups.

Queries are held by every task, so they are taken in rounds of a bounded number of terms.

Defined cases: null text and text without a term has no score and isn't counted in N; null, empty
and term-free queries give no rows; repeated query rows are ranked each; rows of documents that share an
id (or have none) are ranked each, null ids last among equal scores; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

TOP = 10
#: Terms of the queries of a round, repeats included; this bounds what every task holds.
ROUND_TERMS = 200_000
#: Lists that weren't fetched may bring the bound's SHARE-th part together: 1 fetches least, more leaves fewer candidates.
SHARE = 4
#: Bytes outside terms become blanks, A-Z their small letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def rounds(items: DataFrame, most: int = ROUND_TERMS) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """(item_id, terms with their times) of each query that has terms; a round's terms are at most `most`, but for a longer single query."""
    now, size = [], 0
    for r in items.select("item_id", common.whole_text().cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        times = Counter(terms(bytes(r.text)))
        if not times:
            continue
        if now and size + len(times) > most:
            yield now
            now, size = [], 0
        now.append((r.item_id, times))
        size += len(times)
    if now:
        yield now


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, held (term number and tf of each query term that it holds): the documents with a term, as a kept table with a row number rid."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("held", T.ArrayType(T.StructType([T.StructField("term", T.IntegerType()), T.StructField("tf", T.IntegerType())])))])
    pair = pa.list_(pa.struct([("term", pa.int32()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.get
        for b in batches:
            n, held = [], []
            for text in b.column("text"):
                words = terms(text.as_py())
                n.append(len(words))
                times = Counter(map(known, words))
                times.pop(None, None)
                held.append([{"term": t, "tf": c} for t, c in times.items()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pair)], names=["doc_id", "n", "held"])

    got = docs.select("doc_id", common.whole_text().cast("binary").alias("text")).mapInArrow(run, schema)
    return common.kept(got.where("n > 0").withColumn("rid", F.monotonically_increasing_id()), "term-counts")


def weights(vectors: DataFrame, documents: int) -> DataFrame:
    """term, w: a row for each query term that some document holds and whose weight isn't 0."""
    df = vectors.select(F.explode("held.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0")


def impact(documents: int, all_terms: int):
    """(1000000000 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {documents}L) div {all_terms}L))")


def postings(vectors: DataFrame, weighted: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """term, impact, rid, partitioned and sorted by term and falling impact, as a kept table."""
    rows = vectors.select("rid", "n", F.explode("held").alias("x")).select("rid", "n", "x.term", F.col("x.tf").cast("long").alias("tf"))
    rows = rows.join(F.broadcast(weighted.select("term")), "term").select("term", impact(documents, all_terms).alias("impact"), "rid")
    size = vectors.agg(F.sum(F.size("held"))).first()[0] or 0
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // 4_000_000))
    order = [F.col("term"), F.col("impact").desc(), F.col("rid")]
    return common.kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "postings")


class Lists:
    """The lists of a round's queries by term: entries first[t] to first[t + 1] hold queries and weights (times * w)."""

    def __init__(self, entries: list[tuple[int, int, int]], queries: int, all_terms: int):
        term, query, weight = np.array(sorted(entries), np.int64).reshape(-1, 3).T
        self.term, self.query, self.weight, self.queries = term, query, weight, queries
        self.first = np.searchsorted(term, np.arange(all_terms + 1))

    def met(self, terms_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in terms_, entry) of each entry of each term."""
        low, times = self.first[terms_], self.first[terms_ + 1] - self.first[terms_]
        place = np.repeat(np.arange(len(terms_)), times)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(times) - times - low, times)

    def thresholds(self, bounds: np.ndarray, heads: np.ndarray) -> None:
        """bounds: by query; heads: the greatest impact by term. Sets threshold by query, and by entry what an unseen posting brings at most."""
        self.bounds, self.threshold = bounds, np.zeros(self.queries, np.int64)
        most = self.weight * heads[self.term]
        by = np.lexsort((most, self.query))
        for entries in np.split(by, np.flatnonzero(np.diff(self.query[by])) + 1):
            if len(entries) and (bound := int(bounds[self.query[entries[0]]])):
                # With the i least lists at their heads, the others may bring (bound - 1 - sum) div (how many) each.
                tops = most[entries].tolist()
                left, n = (bound - 1) // SHARE, len(tops)
                for i, top in enumerate(tops):
                    if top * (n - i) > left:
                        break
                    left -= top
                else:
                    i, left = n - 1, tops[-1]
                self.threshold[self.query[entries[0]]] = left // (n - i) + 1
        self.unseen = np.minimum(most, np.maximum(self.threshold[self.query] - 1, 0))
        self.all_unseen = np.zeros(self.queries, np.int64)
        np.add.at(self.all_unseen, self.query, self.unseen)

    def floors(self, all_terms: int) -> np.ndarray:
        """By term, the least impact that any of its queries asks for; above all impacts where none has the term."""
        out = np.full(all_terms, np.iinfo(np.int64).max)
        np.minimum.at(out, self.term, -(-self.threshold[self.query] // self.weight))
        return out

    def summed(self, row: np.ndarray, query: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, query and sums of the values for each pair of them."""
        key = row * self.queries + query
        by = np.argsort(key, kind="stable")
        key, first = np.unique(key[by], return_index=True)
        return key // self.queries, key % self.queries, *(np.add.reduceat(v[by], first) if len(by) else v for v in values)


def exact(vectors: DataFrame, lists: Lists, documents: int, all_terms: int, k: int, bounds: np.ndarray | None = None) -> DataFrame:
    """q, rid, doc_id, s: scores above 0 of the documents for all queries; with bounds, those that reach them, else the k best of a task."""
    kind = vectors.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("doc_id", kind), T.StructField("s", T.LongType())])
    least = np.maximum(bounds, 1) if bounds is not None else np.ones(lists.queries, np.int64)

    def scored(b: pa.RecordBatch) -> pa.Table:
        held = b.column("held")
        n, sizes = b.column("n").to_numpy(), np.diff(held.offsets.to_numpy())
        term, tf = (held.flatten().field(c).to_numpy().astype(np.int64) for c in ("term", "tf"))
        row = np.repeat(np.arange(b.num_rows), sizes)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n[row] * documents // all_terms))
        place, entry = lists.met(term)
        row, query, s = lists.summed(row[place], lists.query[entry], impacts[place] * lists.weight[entry])
        good = s >= least[query]
        at = pa.array(row[good])
        return pa.table({"q": query[good], "rid": b.column("rid").take(at), "doc_id": b.column("doc_id").take(at), "s": s[good]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ = None
        for b in batches:
            if b.num_rows:
                found = scored(b)
                if bounds is not None:
                    yield from found.to_batches()
                    continue
                best_ = found if best_ is None else pa.concat_tables([best_, found])
                by = np.lexsort((-best_.column("s").to_numpy(), q := best_.column("q").to_numpy()))
                q = q[by]
                best_ = best_.take(pa.array(by[np.arange(len(q)) - np.searchsorted(q, q) < k]))
        if best_ is not None:
            yield from best_.to_batches()

    return vectors.select("rid", "doc_id", "n", "held").mapInArrow(run, schema)


#: Fetched postings that a task sums at once.
CHUNK = 50_000


def candidates(fetched: DataFrame, lists: Lists) -> DataFrame:
    """rid: the documents that may reach the bound of some query, by their partial sums. fetched: rid, term, impact."""

    def reach(held: pa.Table) -> pa.Table:
        rid, term, impacts = (held.column(c).to_numpy() for c in ("rid", "term", "impact"))
        row = np.cumsum(np.append(0, rid[1:] != rid[:-1]))
        place, entry = lists.met(term.astype(np.int64))
        query, part = lists.query[entry], impacts[place] * lists.weight[entry]
        taken = part >= lists.threshold[query]
        place, entry, query, part = place[taken], entry[taken], query[taken], part[taken]
        row, query, s, seen = lists.summed(row[place], query, part, lists.unseen[entry])
        good = s + lists.all_unseen[query] - seen >= lists.bounds[query]
        ids = rid[np.unique(np.append(0, np.flatnonzero(rid[1:] != rid[:-1]) + 1))]
        return pa.table({"rid": ids[np.unique(row[good])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                whole = pa.Table.from_batches(held)
                rid = whole.column("rid").to_numpy()
                cut = int(np.searchsorted(rid, rid[-1]))  # the last document may go on
                if cut:
                    yield from reach(whole.slice(0, cut)).to_batches()
                held = whole.slice(cut).to_batches()
                size = len(rid) - cut
        if size:
            yield from reach(pa.Table.from_batches(held)).to_batches()

    return fetched.repartition("rid").sortWithinPartitions("rid").mapInArrow(run, "rid long")


def best(vectors: DataFrame, lists: Lists, listed: DataFrame, documents: int, all_terms: int, k: int = TOP) -> DataFrame:
    """q, rank, doc_id, score. listed: the postings."""
    spark = vectors.sparkSession
    size = len(lists.first) - 1
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc(), "rid"))
    heads = common.kept(listed.withColumn("place", place).where(F.col("place") <= k).select("term", "impact", "rid"), "heads")
    named = vectors.join(heads.select("rid").distinct(), "rid", "left_semi")
    row = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "rid"))
    first = exact(named, lists, documents, all_terms, k).withColumn("row", row).where(F.col("row") <= k).groupBy("q").agg(F.count("*").alias("rows"), F.min("s").alias("s"))
    # A number for each query and for each term of the round.
    bounds, tops = np.zeros(lists.queries, np.int64), np.zeros(size, np.int64)
    for r in first.where(F.col("rows") == k).collect():
        bounds[r.q] = r.s
    for r in heads.groupBy("term").agg(F.max("impact").alias("impact")).collect():
        tops[r.term] = r.impact
    lists.thresholds(bounds, tops)
    floors = spark.createDataFrame([(t, int(f)) for t, f in enumerate(lists.floors(size)) if f <= tops[t]], "term int, floor long")
    fetched = listed.join(F.broadcast(floors), "term").where("impact >= floor").select("rid", "term", "impact")
    reaching = common.kept(candidates(fetched, lists), "candidates")
    scores = exact(vectors.join(reaching, "rid", "left_semi"), lists, documents, all_terms, k, bounds)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("doc_id").asc_nulls_last(), "rid"))
    out = common.kept(scores.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "doc_id", F.col("s").alias("score")), "ranked")
    common.drop_kept(heads, reaching)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = ROUND_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. items: item_id, text."""
    spark = docs.sparkSession
    common.tune(spark)
    ids = items.select("item_id").schema["item_id"].dataType
    kinds = T.StructType([T.StructField("item_id", ids), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    found = []
    for queries in rounds(items, most):
        numbers = {t: i for i, t in enumerate(dict.fromkeys(t for _, times in queries for t in times))}
        vectors = counted(docs, numbers)
        documents, all_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        weighted = common.kept(weights(vectors, documents), "weights")
        w = dict(weighted.collect())  # one number for each term of the round
        entries = [(numbers[t], q, c * w[numbers[t]]) for q, (_, times) in enumerate(queries) for t, c in times.items() if numbers[t] in w]
        lists = Lists(entries, len(queries), len(numbers))
        listed = postings(vectors, weighted, documents, all_terms)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", ids)]))
        ranked = best(vectors, lists, listed, documents, all_terms, k)
        found.append(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        common.drop_kept(vectors, weighted, listed)
        common.sweep(spark)
    return common.union(found) if found else spark.createDataFrame([], kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
