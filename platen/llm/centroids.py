"""Centroid clustering of integer vectors by partial-distance search.

A vector's components become integers, floor(256 x). Each round assigns every vector to its
nearest centroid and moves each centroid to the floor of its vectors' mean. A search adds up
squared differences over the dimensions of highest variance first, a few at a time, and abandons
a centroid once its sum is strictly above the vector's best distance so far; those that survive
all dimensions are compared whole. The first sums choose which centroid is finished first, so the
best distance is low from the start. Sums that are equal to the best never go, so ties are
settled exactly: the smaller number wins.

Vectors stay in a table; a round's task gives one row of sums a centroid, and only those (a bound
of centroids x dimensions) are added up and reach the driver.

Defined cases: null vectors, those of another length and those with a null or non-finite
component are left out; a null vec_id counts as the text 'null' that sorts last; repeated rows
count each; fewer vectors than centroids give as many centroids as vectors; an empty table gives
no rows; extra columns are ignored. Components beyond 2^27 after scaling raise an error: squared
distances of such vectors don't fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Dimensions added before each test of the sums.
STEP = 8
#: Components above this don't fit: 64 squared differences of twice as much reach 2^62.
LARGEST = 2**27


def quantised(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, v: the vectors that count, as integers."""
    x = F.col(column)
    whole = vectors.where(F.size(x) == dimensions).where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    fits = F.forall(F.transform(x, lambda c: F.abs(c.cast("double")) * 256), lambda c: c < LARGEST)
    return whole.select("vec_id", F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large"))).alias("v"))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select("vec_id", key.alias("key"), "v").orderBy(F.col("vec_id").isNull(), "key", "v").limit(count)
    return [list(r.v) for r in rows.collect()]


def variances(vectors: DataFrame, dimensions: int) -> list[float]:
    row = vectors.agg(*[F.var_pop(F.col("v")[d].cast("double")).alias(f"d{d}") for d in range(dimensions)]).first()
    return [x or 0.0 for x in row]


def nearest(points: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each point, all in int64; order: dimensions by falling variance."""
    p, c = points[:, order], centroids[:, order]
    n, k, size = len(p), len(c), p.shape[1]
    head = np.stack([np.square(p[:, :step] - c[j, :step]).sum(axis=1) for j in range(k)], axis=1)
    likely = head.argmin(axis=1)
    every = np.arange(n)
    best = head[every, likely] + np.square(p[:, step:] - c[likely, step:]).sum(axis=1)
    found = likely.copy()
    for j in range(k):
        left = every[(head[:, j] <= best) & (likely != j)]
        sums = head[left, j]
        for at in range(step, size, step):
            if not len(left):
                break
            sums = sums + np.square(p[left, at : at + step] - c[j, at : at + step]).sum(axis=1)
            stays = sums <= best[left]
            left, sums = left[stays], sums[stays]
        better = (sums < best[left]) | (j < found[left])
        best[left[better]], found[left[better]] = sums[better], j
    return found, best


def _points(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dimensions)


def assigned(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> DataFrame:
    """vec_id, cluster, distance."""
    c, o = np.array(centroids, np.int64), np.array(order)
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, best = nearest(_points(b.column("v"), len(o)), c, o)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(found, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, schema)


def moved(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> list[list[int]]:
    """The centroids after a round: exact floors of means; those without vectors stay."""
    c, o = np.array(centroids, np.int64), np.array(order)
    k, size = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                points = _points(b.column("v"), size)
                found, _ = nearest(points, c, o)
                by = np.argsort(found, kind="stable")
                there, first = np.unique(found[by], return_index=True)
                sums[there] += np.add.reduceat(points[by], first, axis=0)
                counts += np.bincount(found, minlength=k)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64()), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(size)])
    new = [list(x) for x in centroids]
    for r in wide.collect():
        new[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(size)]
    return new


def clusters(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance as a kept table; the final centroids). vectors: vec_id, v."""
    common.tune(vectors.sparkSession)
    vectors = common.kept(vectors.select("vec_id", "v"), "vectors")
    centroids = first_centroids(vectors, count, seed)
    spread = variances(vectors, dimensions)
    order = sorted(range(dimensions), key=lambda d: -spread[d])
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, order)
    out = common.kept(assigned(vectors, centroids, order), "clusters")
    common.drop_kept(vectors)
    return out, centroids


def described(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with cluster_inertia, inertia and centroid_sha256. The table of clusters is as long as the centroids are many."""
    spark = rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    table = [(j, sums.get(j, 0), sum(sums.values()), d) for j, d in digests]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*clusters(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))


def oracle(count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in DuckDB's SQL, the rounds written out."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    near = f"select v.k, v.vec_id, v.v, arg_min(c.c, ({distance}, c.c)) as c, min({distance}) as d from v, c{{}} c group by 1, 2, 3"
    parts = [
        """v as (select row_number() over () as k, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, v from v qualify c < {count})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} as ({near.format(r)})")
        parts.append(
            f"""m{r} as (select c, list(f order by i) as v from (select c, i, (s - ((s % n) + n) % n) // n as f
from (select c, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from a{r}, range(1, 65) t(i) group by 1, 2)) group by 1)"""
        )
        parts.append(f"c{r + 1} as (select c{r}.c, coalesce(list_transform(m{r}.v, lambda x: x::bigint), c{r}.v) as v from c{r} left join m{r} on m{r}.c = c{r}.c)")
    parts.append(f"a as materialized ({near.format(rounds)})")
    final = f"""select a.vec_id, a.c::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
sha256(array_to_string(z.v, ',')) as centroid_sha256 from a join c{rounds} z on z.c = a.c"""
    materialised = [p.replace(" as (", " as materialized (", 1) for p in parts]
    return f"with {', '.join(materialised)} {final}"
