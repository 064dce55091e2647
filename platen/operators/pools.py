"""The candidate pool of a line: camera-rate frames compete for an object's picture only while its defect is in view, and are published only if they show it.

Rows of a line, in order: kind 'raw' (a camera frame: sharpness, and shows: whether the defect is found on it again with the whole
object in view), 'seen' (an inferred frame: verdict ng, ok or null for empty, whole, score), 'pause' and 'resume'.
The batch form folds sorted rows; the streaming twin keeps the same state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from platen.operators.folds import folded
from platen.operators.sessions import RESET

#: What a score counts for when the object isn't whole in view.
PARTIAL = 0.25
COLUMNS = ["frame_id", "kind", "sharpness", "shows", "verdict", "whole", "score"]
OUT = "session long, frame_id long, source string"
#: Frame numbers are -1 where there is none. present, collecting and paused; the run of empty frames; the object's number; the pool's and the inferred best frame.
FRESH = {"present": False, "collecting": False, "paused": False, "empty": 0, "session": 0, "pool": -1, "pool_sharp": -1.0, "pool_shows": False, "best": -1, "best_score": -1.0}


def _cleared(state: dict) -> None:
    state.update({k: FRESH[k] for k in ("pool", "pool_sharp", "pool_shows", "best", "best_score")})


def advance(state: dict, row: dict, reset: int = RESET) -> Iterator[tuple[int, int, str]]:
    """(object, frame, source) if the row publishes one. Source: pool, or inferred where the pool's frame doesn't show the defect or there is none. A pause drops the object without publishing."""
    kind, number = row["kind"], lambda x: -1.0 if x is None or x != x else float(x)
    if kind in ("pause", "resume"):
        if kind == "pause":
            state.update(present=False, collecting=False, empty=0)
            _cleared(state)
        state["paused"] = kind == "pause"
    elif kind == "raw":
        if state["collecting"] and number(row["sharpness"]) > state["pool_sharp"]:
            state.update(pool=row["frame_id"], pool_sharp=number(row["sharpness"]), pool_shows=bool(row["shows"]))
    elif kind == "seen" and not state["paused"]:
        if row["verdict"] not in ("ng", "ok"):
            state["collecting"] = False
            state["empty"] += 1
            if state["empty"] >= reset and state["present"]:
                from_pool = state["pool"] >= 0 and state["pool_shows"]
                frame = state["pool"] if from_pool else state["best"]
                if frame >= 0:
                    yield state["session"], frame, "pool" if from_pool else "inferred"
                state["present"] = False
                _cleared(state)
            return
        state["empty"] = 0
        if not state["present"]:
            state.update(present=True, session=state["session"] + 1)
            _cleared(state)
        state["collecting"] = row["verdict"] == "ng" and bool(row["whole"])
        if row["verdict"] == "ng":
            score = number(row["score"]) * (1.0 if row["whole"] else PARTIAL)
            if score > state["best_score"]:
                state.update(best=row["frame_id"], best_score=score)


def published(frames: DataFrame, line: str = "line", order: str = "seq", reset: int = RESET) -> DataFrame:
    """line, session, frame_id, source: the picture of each object with a defect that has left."""
    return folded(frames.select(line, order, *COLUMNS), [line], [order, "frame_id"], OUT, lambda: dict(FRESH), lambda s, r: advance(s, r, reset))
