"""Sinks: one ordered file for each stream, JSON lines, reports, manifests."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class SinkError(ValueError):
    """Rows that a sink does not take."""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (as written, as it will be named)


class StreamWriter(DataSourceWriter):
    """Tasks write files under names of their own; the commit renames them, so a task that is run again leaves no half file."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        out, f, last = [], None, None
        try:
            for stream, _, data in rows:
                if f is None or stream != last:
                    if f:
                        f.close()
                    if not re.fullmatch(r"[\w.-]+", stream or "") or stream.startswith("."):
                        raise SinkError(f"no file can have the name of stream {stream!r}")
                    own = os.path.join(self.path, f".{stream}.{uuid.uuid4().hex}")
                    f, last = open(own, "wb"), stream
                    out.append((own, os.path.join(self.path, stream + self.suffix)))
                f.write(data or b"")
        finally:
            if f:
                f.close()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for own, name in m.files if m else ():
                os.replace(own, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for own, _ in m.files if m else ():
                if os.path.exists(own):
                    os.remove(own)


class Streams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "streams"

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("suffix", ".bin"))


def write_streams(rows: DataFrame, path: str, suffix: str = ".bin") -> None:
    """A file for each stream of (stream, position, data), its data joined by position. The folder must be shared by executors.

    A stream is one task's work, as its file is one file; its rows pass through and are not held.
    """
    rows.sparkSession.dataSource.register(Streams)
    dealt = rows.select("stream", F.col("position").cast("long").alias("position"), "data").repartition("stream").sortWithinPartitions("stream", "position")
    dealt.write.format("streams").mode("append").options(path=path, suffix=suffix).save()


def one_info(frames: DataFrame) -> DataFrame:
    """Frames as they are; a query over them fails at one whose size or format is not its stream's first frame's."""
    info = F.struct("width", "height", "format")
    first = frames.groupBy("stream").agg(F.min_by(info, "frame_index").alias("_first"))
    checked = frames.join(first, "stream")
    return checked.where(F.when(info == F.col("_first"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a frame of another size or format in stream "), "stream")).cast("boolean"))).drop("_first")


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Adds records to a folder of JSON lines; null fields are left out."""
    rows.write.mode("append").json(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report as a table of text. Reports are small; one of more than `most` rows is an error, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise SinkError(f"a report of over {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def write_manifest(vectors: DataFrame, path: str) -> None:
    """Vectors as CSV with a header, lists joined by `|`; no list of codecs is an empty field, an empty one is `none`."""
    codecs = F.when(F.col("codecs").isNull(), "").when(F.size("codecs") == 0, "none").otherwise(F.array_join("codecs", "|"))
    cols = ["name", "width", "height", "frames", "format", "pattern", "fps", "lossless", "path", "source", "crop_x", "crop_y"]
    vectors.select(*cols, codecs.alias("codecs"), F.array_join("filters", "|").alias("filters")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
