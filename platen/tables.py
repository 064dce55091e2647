"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished write go at once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='platen-')}"
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/platen-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended already
        pass


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def placed(df: DataFrame) -> DataFrame:
    """df with `at`, a row's file and place in it; df alone where it isn't read from files."""
    return df.select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("at")) if df.inputFiles() else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._platen_path = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Delete tables of kept() that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t._platen_path)
