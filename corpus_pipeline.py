"""A corpus through five operators: toxic documents go, repeated lines go, one of each group of near copies stays, contaminated documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last
return the columns of documents.

Defined cases, for every stage: an empty table gives none; null text counts as empty, is neither
toxic, repeated, near anything nor contaminated, and so stays up to packing; a null doc_id is an id like
any other, and rows are known by doc_id and text, so rows that share an id stand for themselves; extra columns of any name are
kept up to packing and ignored there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import common, decontaminate, jaccard, lines, packing
from platen.llm import toxicity as nearest

#: SQL can't express the tokenizer or the trained scores.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic. A row is known by its doc_id and its text, so a rejected one takes no other row of its id along."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = nearest.scores(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("rejected_id"), F.col("text_hash").alias("rejected_hash")).distinct()
    rejected = common.kept(rejected, "toxic-rows")
    same = docs["doc_id"].eqNullSafe(rejected["rejected_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rejected["rejected_hash"])
    return docs.join(rejected, same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each repeated line kept once; n_chars follows the text. A document all of whose lines go stays, with empty text."""
    out = lines.without_repeats(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id, null last, of equal ids the one of least text hash; of equal rows one. Texts without words are near nothing."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, with up to 8 % of its characters changed."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; an empty text is its end token alone."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
