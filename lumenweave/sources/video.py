"""Raw planar and Y4M files as a data source of frames: `spark.read.format("frames").option("path", ...)`.

Options: path (a file, or files joined by commas); for raw files width, height, format; frames (at most so many of each file);
chunk (frames in a partition). Files must be reachable by the executors. Columns: path, frame_index, width, height, format, data.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame_index bigint, width int, height int, format string, data binary"
# fixed values: chroma tags of the header without a depth
PLAIN_TAGS = ("420", "420jpeg", "420mpeg2", "420paldv")


class FrameError(ValueError):
    """A file that does not hold what its header or the options say."""


def frame_size(width: int, height: int, fmt: str) -> int:
    """Bytes of a frame of yuv420p8..16le, yuv422p.., yuv444p.., gray8.., gbrp8 or rgb24."""
    if width <= 0 or height <= 0:
        raise FrameError("width and height must be positive")
    if fmt in ("rgb24", "gbrp8"):
        return 3 * width * height
    m = re.fullmatch(r"(yuv420p|yuv422p|yuv444p|gray)(\d+)(?:le)?", fmt)
    if not m or not 8 <= int(m[2]) <= 16:
        raise FrameError(f"no such format: {fmt}")
    if m[1] == "yuv420p" and (width % 2 or height % 2) or m[1] == "yuv422p" and width % 2:
        raise FrameError(f"{width}x{height} does not fit {fmt}")
    n = width * height
    chroma = {"yuv420p": n // 4, "yuv422p": n // 2, "yuv444p": n, "gray": 0}[m[1]]
    return (n + 2 * chroma) * (2 if int(m[2]) > 8 else 1)


def tag_format(tag: str | None) -> str:
    if tag is None or tag in PLAIN_TAGS:
        return "yuv420p8"
    m = re.fullmatch(r"(420|422|444)(?:p(\d+))?", tag)
    if not m or not 8 <= int(m[2] or 8) <= 16:
        raise FrameError(f"no such chroma tag: {tag}")
    depth = int(m[2] or 8)
    return f"yuv{m[1]}p{depth}" + ("le" if depth > 8 else "")


@dataclass
class Header:
    width: int
    height: int
    format: str
    fps: str | None
    size: int  # bytes of the header line


def read_header(line: bytes) -> Header:
    """The first line of a Y4M file, with its newline."""
    if not line.endswith(b"\n"):
        raise FrameError("the header has no end" if line else "the file is empty")
    try:
        words = line[:-1].decode("utf-8").split(" ")
    except UnicodeDecodeError as e:
        raise FrameError("the header is not text") from e
    if words[0] != "YUV4MPEG2":
        raise FrameError("not a Y4M file")
    tags: dict[str, str] = {}
    for w in words[1:]:
        if w:
            tags.setdefault(w[0], w[1:])
    if not all(tags.get(k, "").isdigit() and int(tags[k]) for k in "WH"):
        raise FrameError("the header has no size")
    fps = None
    if "F" in tags:
        n, _, d = tags["F"].partition(":")
        if not (n.isdigit() and d.isdigit() and int(n) and int(d)):
            raise FrameError(f"no such frame rate: {tags['F']}")
        fps = n if int(d) == 1 else f"{n}/{d}"
    return Header(int(tags["W"]), int(tags["H"]), tag_format(tags.get("C")), fps, len(line))


@dataclass
class Piece(InputPartition):
    path: str
    width: int
    height: int
    format: str
    first: int
    count: int
    offset: int  # of the first frame
    marked: bool


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.options = options

    def partitions(self) -> list[Piece]:
        most, chunk = int(self.options.get("frames", 1 << 60)), int(self.options.get("chunk", 64))
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                if path.endswith(".y4m"):
                    h = read_header(f.readline(4096))
                    size, at, offsets = frame_size(h.width, h.height, h.format), h.size, []
                    total = os.path.getsize(path)
                    while at < total and len(offsets) < most:  # markers alone are read here
                        f.seek(at)
                        marker = f.readline(4096)
                        if not re.match(rb"FRAME(\s.*)?\n$", marker):
                            raise FrameError(f"{path}: frame {len(offsets) + 1} has no marker")
                        if at + len(marker) + size > total:
                            raise FrameError(f"{path}: frame {len(offsets) + 1} is cut short")
                        offsets.append(at)
                        at += len(marker) + size
                    out += [Piece(path, h.width, h.height, h.format, k, min(chunk, len(offsets) - k), offsets[k], True) for k in range(0, len(offsets), chunk)]
                    n = len(offsets)
                else:
                    w, h, fmt = int(self.options["width"]), int(self.options["height"]), self.options["format"]
                    size = frame_size(w, h, fmt)
                    n, rest = divmod(os.path.getsize(path), size)
                    if rest and "frames" not in self.options:
                        raise FrameError(f"{path}: {rest} bytes after the last frame")
                    n = min(n, most)
                    out += [Piece(path, w, h, fmt, k, min(chunk, n - k), k * size, False) for k in range(0, n, chunk)]
                if n == 0:
                    raise FrameError(f"{path}: no frame")
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        size = frame_size(piece.width, piece.height, piece.format)
        with open(piece.path, "rb") as f:
            f.seek(piece.offset)
            for k in range(piece.first, piece.first + piece.count):
                if piece.marked:
                    f.readline(4096)
                data = f.read(size)
                if len(data) != size:
                    raise FrameError(f"{piece.path}: frame {k + 1} is cut short")
                yield piece.path, k, piece.width, piece.height, piece.format, data


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))
