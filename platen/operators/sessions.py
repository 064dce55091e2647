"""Objects on a line of frames: a session opens at a frame that isn't empty and closes after a run of empty ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.operators.folds import folded

RESET = 3


def frame_verdict(defects: Column, bodies: Column) -> Column:
    """ng with any defect, ok with any body, else null."""
    return F.when(defects > 0, "ng").when(bodies > 0, "ok")


def sessions(frames: DataFrame, keys: list[str], order: list[str], present: Column, reset: int = RESET) -> DataFrame:
    """The frames that aren't empty, with session (from 1 for each key). Gaps and islands over frame numbers; runs of fewer than reset empty frames don't split."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = frames.withColumn("frame_no", F.row_number().over(w)).where(present)
    gap = F.col("frame_no") - F.lag("frame_no").over(w) - 1
    return seen.withColumn("_new", F.coalesce((gap >= reset).cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_log(framed: DataFrame, keys: list[str], defect: Column) -> DataFrame:
    """A row for each session: first frame, last frame, frames, and first_defect (null: the object passed)."""
    return framed.groupBy(*keys, "session").agg(
        F.min("frame_no").alias("first_frame"),
        F.max("frame_no").alias("last_frame"),
        F.count("*").alias("frames"),
        F.min(F.when(defect, F.col("frame_no"))).alias("first_defect"),
    )


def best_frame(framed: DataFrame, keys: list[str], score: Column, id_: str) -> DataFrame:
    """The frame of the greatest score in each session, the first of equals."""
    return framed.groupBy(*keys, "session").agg(F.max_by(id_, F.struct(score, -F.col("frame_no"))).alias("best"), F.max(score).alias("best_score"))


def best_of_windows(frames: DataFrame, keys: list[str], ts: str, score: str, id_: str, width: float) -> DataFrame:
    """Tumbling best-of windows that restart at the frame that closes them: each window's end depends on the last, so a key's ordered frames are folded, with one window as the state. A frame without a score counts as -1; the first of equals is best."""

    def step(window: dict, frame: dict):
        t, s = frame[ts], frame[score]
        window.setdefault("start", t)
        s = -1.0 if s is None or s != s else float(s)
        window["frames"] = window.get("frames", 0) + 1
        if "best" not in window or s > window["score"]:
            window |= {"best": frame[id_], "score": s}
        if t - window["start"] >= width:
            yield from close(window)
            window.clear()
            window["start"] = t

    def close(window: dict):
        if window.get("frames"):
            yield float(window["start"]), window["best"], window["score"], window["frames"]

    return folded(frames.select(*dict.fromkeys([*keys, ts, score, id_])), keys, [ts, id_], "start double, best long, best_score double, frames long", dict, step, close)
