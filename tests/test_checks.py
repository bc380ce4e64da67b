"""Validation, prediction, stream pipeline and command surface against plain versions."""

import random

from pyspark.sql import functions as F

from lumenweave.__main__ import main
from lumenweave.operators import checks, prediction
from lumenweave.streaming import pipeline


def test_validate(spark):
    schema = "stream string, frame_index long, data binary"
    a = [("e", 0, b"ab"), ("e", 1, None), ("s", 0, b"ab"), ("s", 1, b"cd"), ("l", 0, b"ab"), ("m", 0, b"x")]
    b = [("e", 0, b"ab"), ("e", 1, b""), ("s", 0, b"ab"), ("s", 1, b"ce"), ("l", 0, b"ab"), ("l", 1, b"q"), ("n", 3, b"x")]
    got = {r["stream"]: tuple(r)[1:] for r in checks.validate(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {"e": ("equal", 2, 2, None), "s": ("samples", 2, 2, 1), "l": ("length", 1, 2, 1), "m": ("missing", 1, 0, 0), "n": ("missing", 0, 1, 3)}
    assert checks.validate(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_intra_modes(spark):
    rnd = random.Random(3)
    v = [[rnd.randrange(256) if (y // 4 + x // 4) % 2 else x * 9 + y for x in range(14)] for y in range(13)]
    s = spark.createDataFrame([(0, y, x, v[y][x]) for y in range(13) for x in range(14)], "frame long, y long, x long, v0 long")

    def paeth(left, above, corner):
        base = left + above - corner
        return min((left, above, corner), key=lambda c: abs(base - c))

    want = {}
    for gy in range(1, 3):
        for gx in range(1, 3):
            left, above, corner = [v[gy * 4 + j][gx * 4 - 1] for j in range(4)], [v[gy * 4 - 1][gx * 4 + i] for i in range(4)], v[gy * 4 - 1][gx * 4 - 1]
            dc = (sum(left) + sum(above) + 4) // 8
            for m, f in (("dc", lambda j, i: dc), ("vertical", lambda j, i: above[i]), ("horizontal", lambda j, i: left[j]), ("paeth", lambda j, i: paeth(left[j], above[i], corner))):
                want[gy, gx, m] = sum((v[gy * 4 + j][gx * 4 + i] - f(j, i)) ** 2 for j in range(4) for i in range(4))
    modes = prediction.intra_modes(s)
    assert {(r["gy"], r["gx"], r["mode"]): r["sse"] for r in modes.collect()} == want
    for r in prediction.short_list(modes, 2).collect():
        ranked = sorted(prediction.MODES, key=lambda m: want[r["gy"], r["gx"], m])
        assert r["modes"] == ",".join(ranked[:2]) and r["sse"] == want[r["gy"], r["gx"], ranked[0]]


def test_pipeline(spark, tmp_path):
    schema = "stream string, frame_index long, data binary"
    for k in range(3):
        spark.createDataFrame([("s", k, bytes(k + 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    double = lambda d: d.withColumn("data", F.concat("data", "data"))
    q = pipeline.start(src, [lambda d: d.where("frame_index <> 1"), double], str(tmp_path / "out"), str(tmp_path / "ck"), lambda d, n: seen.extend(tuple(r) for r in pipeline.frame_figures(d).collect()))
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted(seen) == [("s", 0, 2, 16), ("s", 2, 6, 48)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command(capsys):
    assert main(["plan", "crop=x=0:y=0:w=8:h=8", "scale=w=4:h=2"]) == 0 and capsys.readouterr().out == "4x2:yuv420p8\n"
    assert main(["plan", "crop=x=1:y=0:w=8:h=8"]) == 2 and main(["plan", "identity", "--video", "ax2:gray8"]) == 2
    assert main(["filters"]) == 0 and "crop=x=<0..>" in capsys.readouterr().out
    assert main(["queries"]) == 0 and "group_summary" in capsys.readouterr().out
    assert main(["run", "group_summary", "/no/such/folder"]) == 1
