"""Sessions, and how this package reaches Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Arrow functions import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="platen-")) / "platen.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def whole_texts(spark: SparkSession) -> None:
    """For functions on whole texts: small Arrow batches, so a Python worker holds rows x length, and the package on every executor."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt evenly over four tasks a core, for Python work that is long for its bytes: a file of one row group is one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def local_session(cores: int = 8, memory: str = "16g", partitions: int | None = None) -> SparkSession:
    """For tests and benchmarks; on a cluster the settings come from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
