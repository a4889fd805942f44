"""WARC archives with dictionary compression, and their reader.

An archive is the bytes of one ``.warc.zst`` file: a skippable frame that holds a Zstandard dictionary
built from the archive's own records, then one frame per record. Archives are rows of a table, cut at
``ARCHIVE_BYTES`` of record bytes, since only Spark writes to where all executors can read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, shared_dir, written

MIN_REVISIT = 1000
#: Digests that repeat are sent to all tasks up to so many, about 30 MB.
SENT = 300_000
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 64 << 10
#: The dictionary is built from so many bytes of an archive's records, spread evenly over them.
SAMPLE_BYTES = 1 << 20
SKIPPABLE = 0x184D2A5D
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, sha1: bytes, revisits: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if revisits is not None:
        lines += [f"WARC-Refers-To: {_id(revisits)}", f"X-Refers-To-Page-ID: {revisits}", f"WARC-Profile: {_PROFILE}"]
    block = head + payload if revisits is None else head
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """The file of these records. Too few or too small ones to train on give a dictionary of their raw bytes."""
    import zstandard

    step = max(1, sum(map(len, records)) // sample_bytes)
    sample = [r[: sample_bytes // 8] for r in records[::step]]
    try:
        d = zstandard.train_dictionary(min(dict_bytes, max(256, sum(map(len, sample)) // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        d = zstandard.ZstdCompressionDict(b"".join(sample)[:4096] + b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = d.as_bytes()
    kept = zstandard.ZstdCompressor(level=3).compress(raw)
    d.precompute_compress(level=3)
    c = zstandard.ZstdCompressor(level=3, dict_data=d)
    return b"".join([struct.pack("<II", SKIPPABLE, len(kept)), kept, *map(c.compress, records)])


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive's bytes."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame leads the archive")
    raw = zstandard.ZstdDecompressor().decompress(content[8 : 8 + n])
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    data = zstandard.ZstdDecompressor(dict_data=d).stream_reader(memoryview(content)[8 + n :], read_across_frames=True).read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        at = stop + 4


def _digest(html: Column) -> Column:
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of pages to the table of archives (content binary) at path.

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with the largest page_id is a response and
    those with smaller or null ids revisit it; rows that repeat the largest id are all responses, as are
    all smaller payloads. A null html is an empty payload; a null url becomes about:blank; a null id is left out of its record.
    Digests are compared first, and of those only what repeats, a row each, is joined to the payloads: sent to all tasks where it is at most ``SENT``
    rows, so that no payload is shuffled; beyond that by shuffling both sides. A payload of a third of all rows is one row there.
    """
    p = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", _digest(F.col("html")))
    same = p.where(F.octet_length("html") >= min_revisit).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha1", "last")
    same = written(same, "digests")
    if same.limit(SENT + 1).count() <= SENT:
        same = F.broadcast(same)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    rows = p.join(same, "sha1", "left").select("page_id", "url", "html", F.unhex("sha1").alias("sha1"), refers.alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for page, url, html, sha1, refers in zip(*(c.slice(i, 256).to_pylist() for c in b.columns)):
                    held.append(record(page, url, html.encode("utf-8", "replace"), sha1, refers))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["content"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["content"])

    rows.mapInArrow(pack, "content binary").write.option("compression", "uncompressed").parquet(path)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """(path, bytes) of writing each archive as a file of its own, ``<hash of its content>.warc.zst``, to a folder that the executors have mounted.

    Writing happens as the result is read; a task that runs twice writes the same files again, each as a whole.
    """
    folder = folder.removeprefix("file:").rstrip("/")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for k in range(b.num_rows):
                content = b.column(0)[k].as_py()
                path = f"{folder}/{hashlib.sha256(content).hexdigest()}.warc.zst"
                with open(f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([len(content)], pa.int64())], ["path", "bytes"])

    return archives.select("content").mapInArrow(of, "path string, bytes long")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives (content binary).

    A response's length and digest are taken from its payload as read, which must agree with its header; a revisit's from its headers.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                out: list[tuple] = []
                for head, block in records_of(b.column(0)[k].as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if head["WARC-Type"] == "response" and (size, said) != (len(payload), hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    out.append((page and int(page), size, said, head["WARC-Type"], refers and int(refers)))
                cols = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/framesift-warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark.read.schema("content binary").parquet(path))


SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
l AS (SELECT html, max(page_id) AS last FROM p WHERE n >= {MIN_REVISIT} GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l USING (html)"""
