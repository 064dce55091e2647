"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds
a document's counts, a delete subtracts them, a revision does both. Each batch is
pre-aggregated and committed once under its id; a batch that is committed again adds nothing.

Defined cases: null text counts as empty (0 tokens), null source or language is a group of
its own (null), an empty table commits an empty batch, repeated rows count each time, and
columns beyond doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordbpe import word_bpe

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "n_chars", "n_bytes"]


def counted(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """A row per document: doc_id, source, lang, tokenizer, n_docs (1), n_tokens, n_chars, n_bytes."""
    common.tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            n = [len(bpe.encode(t)) // 4 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    text = common.whole_text()
    return (
        docs.select("doc_id", "source", "lang", F.char_length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(count, "doc_id long, source string, lang string, n_chars long, n_bytes long, n_tokens long")
        .select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars", "n_bytes")
    )


def _signed(df: DataFrame, sign: int) -> DataFrame:
    return df.select("doc_id", *KEYS, *[(F.col(c) * sign).alias(c) for c in TOTALS])


def inserts(new: DataFrame) -> DataFrame:
    return _signed(new, 1)


def deletes(old: DataFrame) -> DataFrame:
    return _signed(old, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Take the old counts of the revised documents away and add the new ones."""
    return _signed(old, -1).unionByName(_signed(new, 1))


class TokenRollup:
    """Committed batches of signed deltas under one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, dots, dashes and underscores only")
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        """The writer's _SUCCESS file is the commit: it appears after all of a batch's files."""
        return common.exists(self.spark, f"{self._batch(batch_id)}/_SUCCESS")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False, and no work, if that id is committed already. What a failed try left is overwritten."""
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
        sums.coalesce(1).write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def batches(self) -> list[str]:
        p, fs = common._path(self.spark, self.path)
        found = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
        ids = sorted(x.rpartition("batch=")[2] for x in found if "/batch=" in x)
        return [x for x in ids if self.committed(x)]

    def totals(self) -> DataFrame:
        """The sums over all committed batches; groups whose sums are all zero are gone."""
        schema = "source string, lang string, tokenizer string, " + ", ".join(f"{c} long" for c in TOTALS)
        paths = [self._batch(b) for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        some: Column = F.lit(False)
        for c in TOTALS:
            some = some | (F.col(c) != 0)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).where(some)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load the whole table as one batch, twice: the second commit changes nothing."""
    import public_tokenizers

    name = "word_bpe_49k"
    rollup = TokenRollup(spark, f"{common.shared_root(spark)}/token-counts-{uuid.uuid4().hex}")
    changes = inserts(counted(common.documents(spark, sf_dir), name, public_tokenizers.path(f"{name}.json")))
    rollup.commit("load", changes)
    rollup.commit("load", changes)
    return rollup.totals()
