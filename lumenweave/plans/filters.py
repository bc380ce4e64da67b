"""Filter chains from text: `pattern=checker`, `crop=x=8:y=4:w=16:h=12`, `scale=w=20:h=10`, `identity`.

A chain is checked as a whole, and its output's size and format are known, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from lumenweave.operators import frames
from lumenweave.sources import patterns
from lumenweave.sources.video import FrameError, frame_size

# fixed values: how many luma samples a chroma sample covers, across and down
SUBSAMPLING = {"yuv420p": (2, 2), "yuv422p": (2, 1), "yuv444p": (1, 1)}
PATTERNS = ("black", "checker", "gradient", "color_blocks")
PATTERN_FORMATS = ("yuv420p8", "yuv444p8")


class FilterError(ValueError):
    """A chain that cannot be built."""


@dataclass(frozen=True)
class FrameInfo:
    width: int
    height: int
    format: str

    def __post_init__(self):
        try:
            frame_size(self.width, self.height, self.format)
        except FrameError as e:
            raise FilterError(str(e)) from e


@dataclass(frozen=True)
class Stage:
    name: str
    params: dict[str, int | str]


@dataclass(frozen=True)
class Kind:
    """A registered filter: which parameters it needs, the least value of each, what it makes of a frame and of samples."""

    least: dict[str, int]
    info: Callable[[FrameInfo, dict], FrameInfo]
    apply: Callable[[DataFrame, FrameInfo, dict], DataFrame]


def _cropped(info: FrameInfo, p: dict) -> FrameInfo:
    if p["x"] + p["w"] > info.width or p["y"] + p["h"] > info.height:
        raise FilterError(f"the rectangle leaves the {info.width}x{info.height} frame")
    sx, sy = next((s for k, s in SUBSAMPLING.items() if info.format.startswith(k)), (1, 1))
    if p["x"] % sx or p["w"] % sx or p["y"] % sy or p["h"] % sy:
        raise FilterError(f"the rectangle must lie on steps of {sx}x{sy} samples")
    return replace(info, width=p["w"], height=p["h"])


FILTERS: dict[str, Kind] = {
    "identity": Kind({}, lambda i, p: i, lambda s, i, p: s),
    "crop": Kind({"x": 0, "y": 0, "w": 1, "h": 1}, _cropped, lambda s, i, p: frames.crop(s, p["x"], p["y"], p["w"], p["h"])),
    "scale": Kind({"w": 1, "h": 1}, lambda i, p: replace(i, width=p["w"], height=p["h"]), lambda s, i, p: frames.scale(s, (i.width, i.height), (p["w"], p["h"]))),
}


def register(name: str, kind: Kind) -> None:
    """A filter of the user's own; names are taken once."""
    if name in FILTERS or name == "pattern":
        raise FilterError(f"there is a filter {name}")
    FILTERS[name] = kind


def parse(text: str) -> Stage:
    name, eq, body = text.partition("=")
    if name == "pattern":
        if body not in PATTERNS:
            raise FilterError(f"no such pattern: {body}")
        return Stage(name, {"kind": body})
    if name not in FILTERS:
        raise FilterError(f"no such filter: {name}")
    least, params = FILTERS[name].least, {}
    if bool(eq) != bool(least) or (least and not body):
        raise FilterError(f"{name} takes {'parameters as key=value' if least else 'no parameters'}")
    for token in body.split(":") if least else ():
        key, sep, value = token.partition("=")
        if not (key and sep and value):
            raise FilterError(f"{name}: {token} is not key=value")
        if key not in least or key in params:
            raise FilterError(f"{name}: {key} is {'given twice' if key in params else 'unknown'}")
        if not (value.isascii() and value.isdigit()) or int(value) < least[key]:
            raise FilterError(f"{name}: {key} must be a whole number of at least {least[key]}")
        params[key] = int(value)
    if missing := sorted(set(least) - set(params)):
        raise FilterError(f"{name}: {', '.join(missing)} missing")
    return Stage(name, params)


def chain(specs: list[str], has_input: bool) -> tuple[Stage | None, list[Stage]]:
    """(source, transforms). A source comes first, once, and only where no input is given; without an input it is needed."""
    stages = [parse(s) for s in specs]
    for k, s in enumerate(stages):
        if s.name == "pattern" and (has_input or k):
            raise FilterError("a source cannot follow an input" if has_input else "a source comes first and once")
    source = stages[0] if stages and stages[0].name == "pattern" else None
    if not has_input and source is None:
        raise FilterError("without an input the first filter must be a source, as pattern=black")
    return source, stages[1:] if source else stages


def output_info(info: FrameInfo, transforms: list[Stage]) -> FrameInfo:
    for s in transforms:
        info = FILTERS[s.name].info(info, s.params)
    return info


def run(samples: DataFrame, info: FrameInfo, transforms: list[Stage]) -> tuple[DataFrame, FrameInfo]:
    """Samples (frame, y, x, v0, v1, v2) through the chain; all of it is checked first."""
    output_info(info, transforms)
    for s in transforms:
        samples, info = FILTERS[s.name].apply(samples, info, s.params), FILTERS[s.name].info(info, s.params)
    return samples, info


def build(spark: SparkSession, specs: list[str], info: FrameInfo, n: int) -> tuple[DataFrame, FrameInfo]:
    """n generated frames through the chain."""
    source, transforms = chain(specs, has_input=False)
    if info.format not in PATTERN_FORMATS:
        raise FilterError(f"patterns are made as {' or '.join(PATTERN_FORMATS)}")
    return run(patterns.pattern(spark, source.params["kind"], info.width, info.height, n), info, transforms)
