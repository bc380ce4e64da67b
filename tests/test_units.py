"""Codes, unit streams, filter chains, traces, sinks and stream buffers against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import bits
from lumenweave.plans.filters import FilterError, FrameInfo, chain, output_info, parse
from lumenweave.sources import sinks, traces, units
from lumenweave.sources.units import UnitError
from lumenweave.streaming import buffers


def escaped(data: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def test_escape(spark):
    rnd = random.Random(1)
    data = [b"", b"\0", b"\0" * 9, bytes(range(256)), None, *(bytes(rnd.choice((0, 0, 0, 1, 3, 4, 255)) for _ in range(rnd.randrange(60))) for _ in range(400))]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    e = bits.escape(F.col("d"))
    for r in df.select("d", e.alias("e"), bits.unescape(e).alias("u")).collect():
        assert r["d"] is None and r["e"] is None or bytes(r["e"]) == escaped(bytes(r["d"])) and bytes(r["u"]) == bytes(r["d"])


def test_units(spark):
    rows = [("a", b"\0\0\1\x05\x09xy\0\0\0\1\x00\x3aq"), ("b", b""), ("c", None), ("d", b"no code")]
    got = units.framed_units(spark.createDataFrame(rows, "stream string, data binary")).collect()
    assert [(r["stream"], r["unit"], r["offset"], r["kind"], r["layer"], r["temporal"], bytes(r["payload"])) for r in got] == [("a", 0, 3, 1, 5, 0, b"xy"), ("a", 1, 11, 7, 0, 1, b"q")]
    for bad in (b"\0\0\1\x05", b"\0\0\1\x80\x09", b"\0\0\1\x38\x09", b"\0\0\1\x05\x08"):
        with pytest.raises(UnitError):
            list(units._framed(bad))
    for bad in (b"\x80", b"\x05\x10", b"\x00"):
        with pytest.raises(UnitError):
            list(units._prefixed(bad))
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(bits.nal_unit(F.lit(1), F.lit(56), F.lit(0), F.unhex(F.lit("")))).collect()


def test_chains():
    assert parse("crop=h=2:x=0:y=0:w=4").params == {"h": 2, "x": 0, "y": 0, "w": 4}
    for bad in ("blur", "crop", "crop=", "crop=x=1", "crop=x=0:y=0:w=0:h=2", "crop=x=0:x=0:y=0:w=2:h=2", "crop=x=0:y=0:w=2:h=2:q=1", "scale=w=-1:h=2", "scale=w=2:h=", "identity=a=1", "pattern=x", "scale=w=2;h=3"):
        with pytest.raises(FilterError):
            parse(bad)
    for specs, given in ((["identity"], False), (["pattern=black"], True), (["identity", "pattern=black"], False), (["pattern=black", "pattern=black"], False), ([], False)):
        with pytest.raises(FilterError):
            chain(specs, given)
    assert chain([], True) == (None, [])
    info = FrameInfo(16, 16, "yuv420p8")
    assert output_info(info, [parse("crop=x=2:y=4:w=8:h=6"), parse("scale=w=4:h=2")]) == FrameInfo(4, 2, "yuv420p8")
    for bad in ("crop=x=1:y=0:w=2:h=2", "crop=x=0:y=0:w=2:h=3", "crop=x=10:y=0:w=8:h=2", "scale=w=3:h=2"):
        with pytest.raises(FilterError):
            output_info(info, [parse(bad)])


def test_traces(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"kind":"a","v":1}\n\n{"kind":"b","v":2}\n')
    got = traces.json_lines(spark, str(tmp_path / "t.jsonl"), "kind string, v long", ["b"])
    assert [tuple(r) for r in got.collect()] == [("b", 2)]
    (tmp_path / "bad.jsonl").write_text('{"kind":"a"\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        traces.json_lines(spark, str(tmp_path / "bad.jsonl"), "kind string, v long").collect()
    (tmp_path / "m.json").write_text('{"results":[{"codec":"x","mode_key":"m","filename":"f","bytes":1},\n{"codec":"x","mode_key":"m","filename":"f","bytes":2}]}')
    assert [r["bytes"] for r in traces.matrix_report(spark, str(tmp_path / "m.json"), "codec string, mode_key string, filename string, bytes long").collect()] == [2]
    (tmp_path / "v.csv").write_text("# description=small, set\nwidth,name,height,frames,format,pattern,codecs,filters,lossless\n16,a,8,2,yuv420p8,black,,identity|crop,\n\n8,b,8,1,gray8,checker,NONE,,true\n8,c,8,1,gray8,checker,X|y,,\n")
    v = traces.manifests(spark, str(tmp_path / "v.csv"))
    rows = {r["name"]: r for r in v.collect()}
    assert rows["a"]["set"] == "v" and rows["a"]["description"] == "small, set" and rows["a"]["codecs"] is None and rows["a"]["filters"] == ["identity", "crop"] and rows["a"]["crop_x"] is None
    assert rows["b"]["codecs"] == [] and rows["b"]["lossless"] and not rows["a"]["lossless"]
    assert {r["name"] for r in traces.for_codec(v, "Y").collect()} == {"a", "c"}
    for bad in ("", "name,pattern\n", "name,width,height,frames,format,pattern\na,0,2,1,gray8,black\n", "name,width,height,frames,format,pattern\na,2,2,,gray8,black\n", "name,width,height,frames,format,pattern\n,2,2,1,gray8,black\n"):
        with pytest.raises(traces.ManifestError):
            traces.parse_manifest(bad, "x.csv")
    sinks.write_manifest(v, str(tmp_path / "out"))
    key = lambda d: sorted((r["name"], r["width"], r["codecs"], r["filters"], r["lossless"]) for r in d.select("name", "width", F.col("codecs").cast("string").alias("codecs"), F.col("filters").cast("string").alias("filters"), "lossless").fillna("any").collect())
    assert key(traces.manifests(spark, str(tmp_path / "out" / "*.csv")).repartition(1)) == key(v)


def test_sinks(spark, tmp_path):
    rows = [(f"s{k % 3}", 9 - k, bytes([k])) for k in range(10)]
    sinks.write_streams(spark.createDataFrame(rows, "stream string, position long, data binary").repartition(4), str(tmp_path / "o"), ".obu")
    for s in range(3):
        assert (tmp_path / "o" / f"s{s}.obu").read_bytes() == bytes(sorted((k for k in range(10) if k % 3 == s), reverse=True))
    assert len(list((tmp_path / "o").iterdir())) == 3
    with pytest.raises(Exception, match="no file can have the name"):
        sinks.write_streams(spark.createDataFrame([("../x", 0, b"")], "stream string, position long, data binary"), str(tmp_path / "o"))
    f = spark.createDataFrame([("a", 0, 2, 2, "gray8"), ("a", 1, 2, 2, "gray8"), ("b", 0, 4, 2, "gray8")], "stream string, frame_index long, width int, height int, format string")
    assert sinks.one_info(f).count() == 3
    with pytest.raises(Exception, match="another size"):
        sinks.one_info(f.union(spark.createDataFrame([("b", 1, 2, 2, "gray8")], f.schema))).collect()
    assert sinks.markdown(spark.createDataFrame([("x|y", 0.5)], "a string, b double")) == "| a | b |\n|---|---|\n| x\\|y | 0.5000 |\n"
    with pytest.raises(sinks.SinkError):
        sinks.markdown(spark.range(3), most=2)
    for _ in range(2):
        sinks.append_json_lines(spark.createDataFrame([(1, None)], "a int, b int"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).distinct().collect()[0][0] == '{"a":1}' and spark.read.text(str(tmp_path / "j")).count() == 2


def drain(spark, tmp_path, parts, schema, apply, name):
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = apply(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_picture_buffer(spark, tmp_path):
    schema = "stream string, position long, id long, reference boolean, info string"
    parts = [[("s", 0, 10, True, "i"), ("s", 1, 11, False, "i")], [("s", 2, 12, False, "i")], [("s", 3, 13, True, "i"), ("s", 4, 14, True, "i")]]
    got = drain(spark, tmp_path, parts, schema, lambda s: buffers.picture_buffer(s, 2), "pics")
    assert got == [("s", 10, None, 10, 1), ("s", 11, None, 10, 2), ("s", 12, 11, 10, 2), ("s", 13, 12, 13, 2), ("s", 14, 10, 14, 2)]
    with pytest.raises(Exception, match="there already"):
        drain(spark, tmp_path, [[("s", 0, 1, True, "i"), ("s", 1, 1, True, "i")]], schema, lambda s: buffers.picture_buffer(s, 2), "twice")


def test_session(spark, tmp_path):
    schema = "stream string, position long, digest string, flush boolean"
    parts = [[("s", 0, "a", False), ("t", 0, "z", False)], [("s", 1, "b", False), ("s", 2, None, True), ("s", 3, None, True)]]
    assert sorted(drain(spark, tmp_path, parts, schema, lambda s: buffers.session(s, 5), "ses")) == [("s", 0, "a"), ("s", 1, "b")]
    with pytest.raises(Exception, match="after its end"):
        drain(spark, tmp_path, [[("s", 0, None, True)], [("s", 1, "b", False)]], schema, lambda s: buffers.session(s, 5), "late")
