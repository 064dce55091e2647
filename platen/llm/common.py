"""What the corpus operators share: shared storage, Arrow batch sizes, safe input columns."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.session import whole_texts
from platen.tables import _path, drop_kept, kept, remove, shared_root  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    whole_texts(spark)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def union(tables: list[DataFrame], spark: SparkSession | None = None, schema: str = "") -> DataFrame:
    """All rows of the tables; without any, an empty table of the schema."""
    if not tables:
        return spark.createDataFrame([], schema)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
