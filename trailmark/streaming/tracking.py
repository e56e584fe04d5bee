"""The tracking fold on a stream: one state for each video, kept in the state store."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmark.operators.tracking import STATES, Params, Tracker, fold


def track_stream(detections: DataFrame, params: Params | None = None) -> DataFrame:
    """As the batch fold, for a stream whose batches bring whole frames in order.

    A new ``epoch_id`` starts a new tracker. Frames up to the last one taken are
    late and not taken again, so a batch that is replayed changes nothing.
    """
    columns = [f.split()[0] for f in STATES.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last, tracker = pickle.loads(state.get[0]) if state.exists else (None, None, None)
        rows = pd.concat(list(batches))
        rows = rows if last is None else rows[rows["frame_idx"] > last]
        out = []
        for frame, part in rows.groupby("frame_idx", sort=True):
            if part["epoch_id"].iloc[0] != epoch:
                epoch, tracker = part["epoch_id"].iloc[0], Tracker(params)
            out += [(key[0], epoch, *s) for s in fold(tracker, part)]
            last = int(frame)
        state.update((pickle.dumps((epoch, last, tracker)),))
        yield pd.DataFrame(out, columns=columns)

    return detections.groupBy("video").applyInPandasWithState(run, STATES, "blob binary", "append", GroupStateTimeout.NoTimeout)
