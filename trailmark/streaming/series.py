"""Epochs and averages of ordered series on a stream, with typed state that can be carried over.

The state of a series is a row of numbers: its epoch, whether the last frame was
one of reset, the average and the last frame. It lives in the state store; a new
query begins from a table of such rows (``carried``), so a stage that stopped at
any batch goes on elsewhere as if it had not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "epoch_id long, was_reset boolean, g double, frame_idx long"
OUT = f"video string, {STATE}, mode string"


class _Series(StatefulProcessor):
    def __init__(self, alpha: float, start: float, mode: str):
        self.alpha, self.start, self.mode = alpha, start, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, was, g, last = self.state.get() if self.state.exists() else (1, False, self.start, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_idx").itertuples():
            if last is not None and r.frame_idx <= last:
                continue  # taken before
            epoch += int(bool(r.reset) and not was)
            was, last = bool(r.reset), int(r.frame_idx)
            if r.value is not None and not pd.isna(r.value):
                g = (1 - self.alpha) * g + self.alpha * min(1.0, max(0.0, float(r.value)))
            out.append((key[0], epoch, was, g, last, self.mode))
        self.state.update((epoch, was, g, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["epoch_id"]), bool(r["was_reset"]), float(r["g"]), int(r["frame_idx"])))

    def close(self) -> None:
        pass


def mode_of(alpha: float, start: float) -> str:
    """What must agree between a state and the query that goes on from it."""
    return f"series-1:{alpha!r}:{start!r}"


def series_stream(frames: DataFrame, alpha: float, start: float = 1.0, carried: DataFrame | None = None) -> DataFrame:
    """``video, epoch_id, was_reset, g, frame_idx, mode`` of a stream of frames
    (``video, frame_idx, reset, value``), whose batches bring frames in order.

    An epoch begins where ``reset`` rises; ``g`` averages ``value`` (a null leaves it
    as it is). Frames up to the last one taken are late and left out, so what is
    replayed changes nothing. ``carried``: states to begin with; one of another
    mode is an error. The session's state store must be RocksDB's.
    """
    mode = mode_of(alpha, start)
    if carried is not None:
        other = carried.where(F.col("mode").isNull() | (F.col("mode") != mode)).select("mode").first()
        if other:
            raise ValueError(f"the states are of mode {other[0]!r}, not {mode!r}")
    initial = carried.select("video", *(c.split()[0] for c in STATE.split(", "))).groupBy("video") if carried is not None else None
    return frames.groupBy("video").transformWithStateInPandas(_Series(alpha, start, mode), OUT, "Append", "None", initialState=initial)


def states(rows: DataFrame) -> DataFrame:
    """Each video's last state, of the rows that a query gave: what the next one carries over."""
    names = [c.split()[0] for c in STATE.split(", ")]
    return rows.groupBy("video").agg(F.max_by(F.struct(*names, "mode"), "frame_idx").alias("s")).select("video", "s.*")
