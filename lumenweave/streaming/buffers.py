"""Buffers kept from batch to batch of a stream: bounded pictures with references, and sessions that give out at their end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class BufferError(ValueError):
    """A row that a buffer does not take."""


PICTURES = "stream string, id long, evicted long, latest_reference long, held int"


def _pictures(capacity: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        info, ids, refs = state.get if state.exists else (None, [], [])
        ids, refs = list(ids), list(refs)
        rows = pd.concat(list(parts)).sort_values("position", kind="stable")
        out = []
        for i, ref, its in zip(rows["id"], rows["reference"], rows["info"], strict=True):
            if info not in (None, its):
                raise BufferError(f"picture {i} of stream {key[0]} is {its}, not {info}")
            if i in ids:
                raise BufferError(f"picture {i} of stream {key[0]} is there already")
            info, gone = its, None
            if len(ids) == capacity:
                at = refs.index(False) if False in refs else 0
                gone, _ = ids.pop(at), refs.pop(at)
            ids.append(int(i))
            refs.append(bool(ref))
            latest = next((a for a, r in zip(reversed(ids), reversed(refs), strict=True) if r), None)
            out.append((key[0], int(i), gone, latest, len(ids)))
        state.update((info, ids, refs))
        df = pd.DataFrame(out, columns=["stream", "id", "evicted", "latest_reference", "held"])
        yield df.astype({"id": "int64", "evicted": "Int64", "latest_reference": "Int64", "held": "int32"})

    return step


def picture_buffer(pictures: DataFrame, capacity: int) -> DataFrame:
    """For a stream of (stream, position, id, reference, info): what each insertion evicts and the latest reference after it.

    A full buffer gives up its oldest picture that is no reference, else its oldest. Another info or an id that is held is an error.
    """
    if capacity < 1:
        raise BufferError("a buffer holds one picture at least")
    step = _pictures(capacity)
    return pictures.groupBy("stream").applyInPandasWithState(step, PICTURES, "info string, ids array<long>, refs array<boolean>", "append", GroupStateTimeout.NoTimeout)


def _session(limit: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, done = state.get if state.exists else ([], False)
        names = list(names)
        rows = pd.concat(list(parts)).sort_values("position", kind="stable")
        out = []
        for digest, last in zip(rows["digest"], rows["flush"], strict=True):
            if last:  # a second end gives nothing
                out += [(key[0], k, d) for k, d in enumerate(names)]
                names, done = [], True
            elif done:
                raise BufferError(f"stream {key[0]} goes on after its end")
            elif len(names) >= limit:
                raise BufferError(f"stream {key[0]} has over {limit} frames")
            else:
                names.append(digest)
        state.update((names, done))
        yield pd.DataFrame(out, columns=["stream", "frame_index", "digest"]).astype({"frame_index": "int64", "digest": object})

    return step


def session(rows: DataFrame, limit: int) -> DataFrame:
    """For a stream of (stream, position, digest, flush): the frames of each stream in order, given out when its end comes.

    Kept are names, not samples, and at most `limit` of a stream: one more is an error, and so is a frame after the end.
    """
    return rows.groupBy("stream").applyInPandasWithState(_session(limit), "stream string, frame_index long, digest string", "names array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)
