"""Readers and writers of inspection records. Readers are lazy frames; schemas are given, never inferred from data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REC_ID = r"[0-9]{8}-[0-9]{6}(-[0-9]+)?"
CORRUPT = "_corrupt"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with rec_id (its folder's name); documents that don't parse are left out."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", True).json(path)
    return raw.withColumn("rec_id", F.element_at(F.split(F.input_file_name(), "/"), -2)).where(f"{CORRUPT} is null").drop(CORRUPT)


def newest(records: DataFrame, limit: int) -> DataFrame:
    return records.orderBy(F.desc("rec_id")).limit(limit)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append log; lines that aren't objects of the schema are dropped. line_no orders a file's lines."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"))
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    read = rows.where(F.trim("value").startswith("{")).select("file", "line_no", parsed.alias("row"))
    return read.where(F.col("row").isNotNull() & F.col(f"row.{CORRUPT}").isNull()).select("file", "line_no", "row.*").drop(CORRUPT)


def read_record(records: DataFrame, rec_id: str) -> DataFrame:
    """A record by its id; ids of another form (paths, say) are refused."""
    if not re.fullmatch(REC_ID, rec_id):
        raise ValueError(f"not a record id: {rec_id!r}")
    return records.where(F.col("rec_id") == rec_id)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Exactly the columns of defaults: nulls and missing columns get the default, unknown columns go."""
    return df.select(*[(F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)).alias(c) for c, v in defaults.items()])


def append_events(events: DataFrame, path: str, start_id: int = 0) -> None:
    """Append with ids that follow (ts, seq): ranked in day partitions whose sizes are summed before."""
    day = events.withColumn("day", F.to_date("ts"))
    sizes = day.groupBy("day").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = day.withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy("ts", "seq"))).join(before, "day")
    ranked.withColumn("id", (F.lit(start_id) + F.col("before") + F.col("rn")).cast("long")).drop("rn", "before").write.mode("append").partitionBy("day").parquet(path)


def clear_events(spark: SparkSession, path: str) -> int:
    """Empty the table; the number of rows it had."""
    old = spark.read.parquet(path)
    n = old.count()
    old.limit(0).write.mode("overwrite").parquet(f"{path}.empty")
    spark.read.schema(old.schema).parquet(f"{path}.empty").write.mode("overwrite").parquet(path)
    return n


def slim(df: DataFrame, heavy: list[str]) -> DataFrame:
    """Heavy text columns blanked; the schema stays."""
    return df.withColumns({c: F.lit("") for c in heavy})


def distinct_ids(df: DataFrame, base: str, order: list[str]) -> DataFrame:
    """rec_id: the base id, with -1, -2, ... for its repeats."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn("rec_id", F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, length, modified of files named by one to eight digits; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(path)
    number = F.regexp_extract("path", r"/([0-9]{1,8})\.jpg$", 1)
    return files.select("path", F.nullif(number, F.lit("")).cast("int").alias("frame"), "length", F.col("modificationTime").alias("modified")).where("frame is not null")


def detection_log(spark: SparkSession, path: str) -> DataFrame:
    """kind, confidence, box of log lines `Defect: t | Confidence: c | BBox: [...]`."""
    pattern = r"Defect: (.*?) \| Confidence: ([0-9.]+)%? \| BBox: [\[(]([^\])]*)[\])]"
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(part(1).alias("kind"), part(2).cast("double").alias("confidence"), F.transform(F.split(part(3), ","), lambda x: F.trim(x).cast("int")).alias("box"))


def expired(files: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Files older than so many days."""
    return files.where(F.col("modified") < (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days)))


def embedded_image(df: DataFrame, columns: list[str]) -> DataFrame:
    """image: the first of the columns over 1000 characters that decodes from base64."""
    return df.withColumn("image", F.coalesce(*[F.when(F.char_length(c) > 1000, F.try_to_binary(F.col(c), F.lit("base64"))) for c in columns]))


def blocks(raw: str | Column) -> Column:
    """Text blocks of a JSON list: blank texts go, a bad confidence is 0, a box is four numbers or null. Anything but a list is empty."""
    column = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.from_json(column, "array<struct<text:string,conf:string,bbox:array<string>>>")
    made = F.transform(
        parsed,
        lambda b: F.struct(
            b["text"].alias("text"),
            F.coalesce(b["conf"].try_cast("double"), F.lit(0.0)).alias("conf"),
            F.when((F.size(b["bbox"]) == 4) & F.forall(b["bbox"], lambda v: v.try_cast("double").isNotNull()), F.transform(b["bbox"], lambda v: v.try_cast("double"))).alias("bbox"),
        ),
    )
    return F.coalesce(F.filter(made, lambda b: F.trim(b["text"]) != ""), F.array().cast("array<struct<text:string,conf:double,bbox:array<double>>>"))


def session_rollup(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """session, frames, ng, last: detections summed before they meet the frames."""
    ng = detections.groupBy("session").agg(F.count_if(F.col("verdict") == "ng").alias("ng"))
    return frames.groupBy("session").agg(F.count("*").alias("frames"), F.max("ts").alias("last")).join(ng, "session", "left").na.fill(0, ["ng"])


def without_files(files: DataFrame, gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """files and further tables without the (session, file) pairs of gone."""
    return [t.join(gone, ["session", "file"], "left_anti") for t in (files, *tables)]
