"""State kept from frame to frame of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream string, frame_index long, repeats boolean"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_index, last = state.get if state.exists else (-1, "")
    rows = pd.concat(list(parts)).sort_values("frame_index", kind="stable")
    out = []
    for i, d in zip(rows["frame_index"], rows["digest"], strict=True):
        if i <= last_index:
            continue  # came late: its successor was already judged
        out.append((key[0], int(i), i == last_index + 1 and d == last))
        last_index, last = int(i), d
    state.update((last_index, last))
    yield pd.DataFrame(out, columns=["stream", "frame_index", "repeats"]).astype({"frame_index": "int64", "repeats": bool})


def repeats(frames: DataFrame) -> DataFrame:
    """For a stream of (stream, frame_index, digest): whether each frame equals the one before it, across micro-batches.

    State is one digest a stream. A frame that comes after a later one of its stream is left out.
    """
    return frames.groupBy("stream").applyInPandasWithState(_step, OUT, "frame_index long, digest string", "append", GroupStateTimeout.NoTimeout)
