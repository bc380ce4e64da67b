"""Scans of unit streams: start-code framed and length-prefixed, in Arrow batches; a row for each unit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

START = re.compile(rb"\x00?\x00\x00\x01")
UNITS = "stream string, unit int, offset long, kind int, layer int, temporal int, payload binary"


class UnitError(ValueError):
    """A stream that is not a sequence of units."""


def _framed(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    codes = list(START.finditer(data))
    for c, after in zip(codes, [*codes[1:], None], strict=True) if codes else ():
        end = after.start() if after else len(data)
        at = c.end()
        if end - at < 2:
            raise UnitError(f"the unit at {at} has no whole header")
        a, b = data[at], data[at + 1]
        if a > 55 or not b & 7:  # the two high bits must be zero as well
            raise UnitError(f"the unit at {at} has a header that is not allowed")
        yield at, b >> 3, a, (b & 7) - 1, data[at + 2 : end]


def _prefixed(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    at = 0
    while at < len(data):
        size = shift = 0
        start = at
        while True:
            if at >= len(data) or shift > 28:
                raise UnitError(f"the unit at {start} has no whole length")
            size |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        if size < 1 or at + size > len(data):
            raise UnitError(f"the unit at {start} is cut short")
        yield start, data[at] >> 2 & 31, 0, data[at] & 3, data[at + 1 : at + size]
        at += size


def _scan(streams: DataFrame, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # a batch for each stream bounds memory by one stream
                rows = [(name, k, *u) for k, u in enumerate(read(data or b""))]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["stream", "unit", "offset", "kind", "layer", "temporal", "payload"])

    return streams.select("stream", "data").mapInArrow(run, UNITS)


def framed_units(streams: DataFrame) -> DataFrame:
    """Units after start codes of three or four bytes, of (stream, data). Null or empty data: no unit. Payloads stay escaped."""
    return _scan(streams, _framed)


def prefixed_units(streams: DataFrame) -> DataFrame:
    """Units with a base-128 length, of (stream, data); offset is where the length starts."""
    return _scan(streams, _prefixed)
