"""Frame files and state of streams."""

import pytest

from lumenweave.sources.video import FrameError, Frames, frame_size, read_header, tag_format
from lumenweave.streaming.reference import repeats


def test_header():
    h = read_header(b"YUV4MPEG2 W16 H8 F30000:1001 C422p10\n")
    assert (h.width, h.height, h.format, h.fps) == (16, 8, "yuv422p10le", "30000/1001")
    assert read_header(b"YUV4MPEG2 W2 H2 F25:1\n").fps == "25" and tag_format(None) == "yuv420p8"
    for bad in (b"", b"YUV4MPEG2 W2 H2", b"RIFF W2 H2\n", b"YUV4MPEG2 W0 H2\n", b"YUV4MPEG2 W2 H2 F0:1\n", b"YUV4MPEG2 W2 H2 C411\n", b"\xff\n"):
        with pytest.raises(FrameError):
            read_header(bad)
    assert frame_size(4, 4, "yuv420p8") == 24 and frame_size(4, 4, "yuv444p12le") == 96 and frame_size(3, 3, "gray8") == 9
    with pytest.raises(FrameError):
        frame_size(3, 4, "yuv420p8")


def test_frames(spark, tmp_path):
    spark.dataSource.register(Frames)
    body = [bytes([k]) * 24 for k in range(7)]
    y4m, raw = tmp_path / "a.y4m", tmp_path / "a.yuv"
    y4m.write_bytes(b"YUV4MPEG2 W4 H4 F25:1\n" + b"".join((b"FRAME\n" if k % 2 else b"FRAME Ip\n") + b for k, b in enumerate(body)))
    raw.write_bytes(b"".join(body))
    got = spark.read.format("frames").option("path", str(y4m)).option("chunk", 3).load().orderBy("frame_index").collect()
    assert [bytes(r["data"]) for r in got] == body and got[0]["format"] == "yuv420p8"
    opts = {"path": str(raw), "width": 4, "height": 4, "format": "yuv420p8"}
    got = spark.read.format("frames").options(**opts, frames=5, chunk=2).load().orderBy("frame_index").collect()
    assert [bytes(r["data"]) for r in got] == body[:5]
    raw.write_bytes(raw.read_bytes() + b"x")
    with pytest.raises(Exception, match="after the last frame"):
        spark.read.format("frames").options(**opts).load().collect()


def test_repeats_across_batches(spark, tmp_path):
    rows = [("s", k, "ab"[k // 3 % 2]) for k in range(9)] + [("t", k, "z") for k in range(3)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], "stream string, frame_index long, digest string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream string, frame_index long, digest string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = repeats(src).writeStream.format("memory").queryName("rep").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["stream"], r["frame_index"]): r["repeats"] for r in spark.table("rep").collect()}
    assert got == {(s, k): k > 0 and (s == "t" or k % 3 > 0) for s, k, _ in rows}
