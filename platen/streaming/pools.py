"""The streaming twin of operators.pools: a line's state is a few numbers, restored from the checkpoint after a failure and dropped when the line has been silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from platen.operators.pools import FRESH, advance
from platen.operators.sessions import RESET
from platen.session import ship

STATE = "present boolean, collecting boolean, paused boolean, empty int, session long, pool long, pool_sharp double, pool_shows boolean, best long, best_score double"
OUT = "line long, session long, frame_id long, source string"


def published(frames: DataFrame, reset: int = RESET, timeout_ms: int = 3_600_000) -> DataFrame:
    """frames: line and the columns of operators.pools, in arrival order by seq. A line that says nothing for timeout_ms loses its state: what was in view is gone, and nothing is published for it."""
    ship(frames.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = dict(zip(FRESH, state.get, strict=True)) if state.exists else dict(FRESH)
        out = []
        rows = pd.concat(list(batches)).sort_values(["seq", "frame_id"], kind="stable")
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            out += [(key[0], *r) for r in advance(now, row, reset)]
        state.update(tuple(now[k] for k in FRESH))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["line", "session", "frame_id", "source"])

    return frames.groupBy("line").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
