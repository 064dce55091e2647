"""The streaming twin of operators.sessions: state per line is three numbers, restored from the checkpoint after a failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from platen.operators.sessions import RESET
from platen.session import ship

STATE = "present boolean, empty int, session long, counted boolean"
OUT = "line long, session long, frame_id long, kind string"


def counted_objects(frames: DataFrame, reset: int = RESET, timeout_ms: int = 86_400_000) -> DataFrame:
    """frames: line, frame_id, verdict (ng, ok or null), in arrival order. Emits open at an object's first frame and ng once, at its first defect."""
    ship(frames.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        present, empty, session, counted = state.get if state.exists else (False, 0, 0, False)
        rows = []
        for pdf in batches:
            pdf = pdf.sort_values("frame_id", kind="stable")
            for frame, verdict in zip(pdf["frame_id"], pdf["verdict"], strict=True):
                if verdict is None or verdict != verdict:
                    empty += 1
                    present = present and empty < reset
                    continue
                if not present:
                    session, counted = session + 1, False
                    rows.append((key[0], session, frame, "open"))
                present, empty = True, 0
                if verdict == "ng" and not counted:
                    counted = True
                    rows.append((key[0], session, frame, "ng"))
        state.update((bool(present), int(empty), int(session), bool(counted)))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["line", "session", "frame_id", "kind"])

    return frames.groupBy("line").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
