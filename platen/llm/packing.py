"""Packing by power-of-two decomposition.

A document's ids, with the separator behind them, are cut into full sequences and then into
pieces of the binary digits of the rest, longest first. Every piece is a sequence of its own,
so none crosses documents and none needs padding; equal lengths share a bucket, whose number
leads the sequence id. Ids are given where a piece is made: nothing is shuffled.

Defined cases: null or empty text is the separator alone; repeated rows are packed each;
an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordbpe import word_bpe

LENGTH = 4096
SEPARATOR = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pieces(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of n ids; most is a power of two."""
    at = 0
    while n - at >= most:
        yield at, most
        at += most
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        yield at, length
        at += length


def pack(docs: DataFrame, path: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """A row per piece. sequence_id: bucket, then the task that made it, then a running number; so buckets are contiguous."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    common.tune(docs.sparkSession)
    end = separator.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = word_bpe(path), TaskContext.get().partitionId()
        given = [0] * length.bit_length()
        for b in batches:
            rows = [[] for _ in range(8)]
            doc_ids, starts, lengths, crcs, totals, sequences, offsets, buckets = rows
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(bpe.encode(text) + end)
                n = len(ids) // 4
                for start, size in pieces(n, length):
                    k = size.bit_length() - 1
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(size)
                    crcs.append(crc32(ids[4 * start : 4 * (start + size)]))
                    totals.append(n)
                    sequences.append(k << 58 | task << 34 | given[k])
                    offsets.append(0)
                    buckets.append(k)
                    given[k] += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:-1]), pa.array(buckets, pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", common.whole_text().alias("text")).mapInArrow(run, SCHEMA)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
