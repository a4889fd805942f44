import hashlib
import random

import pytest
import zstandard

from framesift.llm import queries, warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    last, out = {}, []
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            last[b] = max(last.get(b, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        to = last.get(b)
        to = to if to is not None and (p is None or p < to) else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_equals_sql(compare, sf):
    compare(queries.QUERIES["op9_warc"], queries.ORACLES["op9_warc"], sf)


def test_copies_nulls_and_sizes(spark):
    big, edge = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/\r\nX: y ü", big), (3, "u", edge), (4, "u", edge), (5, "u", edge[1:]), (6, "u", edge[1:]), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "WARC/1.1\r\n\r\n" * 90), (10, "u", "twice")]
    assert got(warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3))) == brute(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    clash = spark.createDataFrame([(1, "u", "h", "r", "s")], PAGES + ", sha1 string, last string")
    assert got(warc.round_trip(clash)) == brute([(1, "u", "h")])


@pytest.mark.parametrize("n", [1, 3, 400])
def test_archive_is_a_dictionary_frame_and_one_frame_a_record(n):
    r = random.Random(n)
    payloads = [" ".join(r.choices(["alpha", "beta", "gamma", "<div>"], k=r.randrange(3, 400))).encode() for _ in range(n)]
    records = [warc.record(i, f"http://h/{i}", p, hashlib.sha1(p).digest(), None) for i, p in enumerate(payloads)]
    file = warc.archive(records)
    assert int.from_bytes(file[:4], "little") == warc.SKIPPABLE
    rest, frames = file[8 + int.from_bytes(file[4:8], "little") :], 0
    while rest:  # each frame states where it ends
        size = zstandard.frame_content_size(rest)
        assert size == len(records[frames])
        d = zstandard.ZstdDecompressor().decompress(file[8 : 8 + int.from_bytes(file[4:8], "little")])
        o = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)).decompressobj()
        assert o.decompress(rest) == records[frames]
        rest, frames = o.unused_data, frames + 1
    assert frames == n
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.records_of(file)] == payloads


def test_damage_is_seen(spark, tmp_path):
    p = b"payload"
    bad = warc.archive([warc.record(1, "u", p, hashlib.sha1(b"other").digest(), None)])
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark.createDataFrame([(bytearray(bad),)], "content binary")).collect()


def test_payload_larger_than_an_archive_and_many_digests(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    huge = "".join(r.choices("abcdefgh <>", k=3 << 20)) * 3
    rows = [(1, "u", huge), (2, "u", huge), (3, "u", huge + "x"), (4, "u", "small")] + [(10 + i, "u", f"{i % 40}" * 900) for i in range(200)]
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    assert len(huge) > warc.ARCHIVE_BYTES and got(warc.round_trip(df)) == brute(rows)
    monkeypatch.setattr(warc, "SENT", 3)
    assert got(warc.round_trip(df)) == brute(rows)
    warc.write(df, str(tmp_path / "a"))
    files = warc.export(spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "f")).collect()
    content = [(tmp_path / "f" / f["path"].rsplit("/", 1)[1]).read_bytes() for f in files]
    assert sorted(map(len, content)) == sorted(f["bytes"] for f in files) and sum(len(list(warc.records_of(c))) for c in content) == len(rows)
