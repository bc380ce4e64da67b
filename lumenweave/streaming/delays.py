"""Stages that may hold frames back, and the flush of what they hold at the end of a stream, in order through all later stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


class Delay:
    """Gives each frame after `n` later ones have come, and the rest when flushed."""

    def __init__(self, n: int):
        self.n, self.held = n, []

    def __call__(self, frame) -> list:
        self.held.append(frame)
        return [self.held.pop(0)] if len(self.held) > self.n else []

    def flush(self) -> list:
        out, self.held = self.held, []
        return out


def chain(stages: list[Callable], frames: Iterable) -> Iterator:
    """What comes out of the last stage. A stage turns a frame into a list of frames; one with `flush` is flushed when its input has ended, before the stages after it."""

    def through(k: int, frame) -> Iterator:
        if k == len(stages):
            yield frame
            return
        for x in stages[k](frame):
            yield from through(k + 1, x)

    for f in frames:
        yield from through(0, f)
    for k, stage in enumerate(stages):
        if hasattr(stage, "flush"):
            for x in stage.flush():
                yield from through(k + 1, x)
