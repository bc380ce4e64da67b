"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of records. Each archive (`.warc.zst`) begins with a
skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one Zstandard frame per
record, so any record can be read alone. Records whose payload another record has already are
`revisit` records without payload. Archives go to the shared folder under names unique to the
attempt that wrote them; the manifest of committed archives is a table, and only those are read.
Readers parse the archives themselves: digests are recomputed from the stored payloads.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom
from .common import cut, heavy_join, made, shared_dir, ship, table

SKIPPABLE = 0x184D2A5D


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit (refers_to given) has no block; its payload's length is in an extension header."""
    kind = "response" if refers_to is None else "revisit"
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    if data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("record of wrong length")
    return head, data[end + 4 : end + 4 + n]


def dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; b"" if the records are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Writes one archive in memory of bounded size."""

    def __init__(self, words: bytes, level: int):
        self.out = io.BytesIO()
        if words:
            packed = zstandard.ZstdCompressor(level=19).compress(words)
            self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True)
        self.n = 0

    def add(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))
        self.n += 1

    def size(self) -> int:
        return self.out.tell()


def read_archive(source) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    head = source.read(8)
    words, left = b"", head
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        raw, left = source.read(struct.unpack("<II", head)[1]), b""
        words = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while True:
        one, parts = unzip.decompressobj(), []
        while not one.eof:
            left = left or source.read(1 << 20)
            if not left:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield b"".join(parts)


@dataclass
class Archives:
    manifest: DataFrame  # path, records, bytes
    dictionary_bytes: int


def write(pages: DataFrame, *, least_bytes: int = 1000, level: int = 9, dict_size: int = 64 << 10, sample: int = 400, sample_bytes: int = 64 << 10, archive_mb: int = 32, partitions: int | None = None) -> Archives:
    """Archives page_id, url, html. Of pages with equal payloads of least_bytes or more, the one with the largest page_id is
    the response and the others revisit it; where rows repeat that page_id, each is written as a response. Rows without page_id are
    responses each, null html is an empty payload, and bodies of any length are written whole. Without pages there is no archive. Columns besides
    page_id, url and html, whatever their names, are not read.

    Archives are written through Arrow's file systems, by the URI of the shared folder: one of a scheme that Arrow does not know raises.

    The dictionary is trained on at most `sample` records by hash order, of at most sample_bytes each.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select("page_id", "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    few = pages.where(F.octet_length(body).between(1, sample_bytes)).orderBy(F.xxhash64("page_id"), "page_id").limit(sample).toArrow().to_pylist()
    words = dictionary([record(r["page_id"], r["url"], (b := r["html"].encode("utf-8", "surrogatepass")), hashlib.sha1(b).hexdigest(), None) for r in few], dict_size)
    # only ids and digests are shuffled to find equal payloads
    keyed = pages.where((F.octet_length(body) >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1(body).alias("d"), F.octet_length(body).alias("n"))
    keyed = cut(keyed)
    keeper = keyed.groupBy("d", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("m")).where("m > 1")
    revisits = cut(heavy_join(keyed, keeper, ["d", "n"], "m").where("page_id <> keeper").select("page_id", "d", "keeper").distinct())
    rows = pages.withColumn("d", F.sha1(body))
    n = revisits.count()
    if n:
        # a filter of bounded size tells which bodies may be revisits; all others, those without page_id too, stay where they are
        says = F.col("page_id").isNotNull() & bloom(revisits.select(F.xxhash64("page_id", "d").alias("key")), n, 53, 12, 4).says(F.xxhash64("page_id", "d"))
        maybe = rows.where(says).join(revisits.withColumnRenamed("keeper", "refers_to"), ["page_id", "d"], "left")
        names = ["page_id", "url", "html", "d", "refers_to"]
        rows = rows.where(~says).withColumn("refers_to", F.lit(None).cast("long")).select(*names).union(maybe.select(*names))
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long")).select("page_id", "url", "html", "d", "refers_to")
    if partitions:
        rows = rows.repartition(partitions)
    base = made(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(w: Writer) -> pa.RecordBatch:
            place = f"{base}/{uuid.uuid4().hex}.warc.zst"
            fs, path = pafs.FileSystem.from_uri(place)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(w.out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([w.n], pa.int64()), pa.array([w.size()], pa.int64())], names=["path", "records", "bytes"])

        w = None
        for batch in batches:
            for page, url, html, d, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = w or Writer(shared.value, level)
                w.add(record(page, url, (html or "").encode("utf-8", "surrogatepass"), d, to))
                if w.size() >= archive_mb << 20:
                    yield out(w)
                    w = None
        if w:
            yield out(w)

    return Archives(cut(rows.mapInArrow(run, "path string, records long, bytes long")), len(words))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: Archives, *, payloads: bool = True) -> DataFrame:
    """The records of the archives. A stored payload that does not fit its digest raises."""
    shown = payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]

        def out(rows):
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for place in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(place)
                rows, size = [], 0
                with fs.open_input_stream(path) as f:
                    for data in read_archive(f):
                        head, block = parse(data)
                        name, digest = head["WARC-Record-ID"][10:-1], head["WARC-Payload-Digest"][5:]
                        to = head.get("WARC-Refers-To")
                        if to is None:
                            n, digest_now = len(block), hashlib.sha1(block).hexdigest()
                            if digest_now != digest:
                                raise ValueError(f"payload of page {name} does not fit its digest")
                        else:
                            n = int(head["X-Payload-Length"])
                        rows.append((None if name == "null" else int(name), head.get("WARC-Target-URI"), n, digest, head["WARC-Type"], int(to[10:-1]) if to else None, block if shown and to is None else None))
                        size += len(block)
                        if len(rows) >= 2000 or size >= 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    spark = archives.manifest.sparkSession
    n = max(1, archives.manifest.count())
    return archives.manifest.select("path").repartition(min(n, 10 * spark.sparkContext.defaultParallelism)).mapInArrow(run, READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back. Null html is an empty payload; equal payloads under 1000 bytes are all responses."""
    got = read(write(table(spark, sf_dir, "pages")), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
q AS (SELECT page_id, octet_length(encode(b)) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
