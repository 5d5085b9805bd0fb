"""Archives: records by hand, a round trip, pushed filters, commits."""

import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from adlytics.llm import warc
from adlytics.workspace import Workspace
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, extra string"
PAGES = [
    (5, "http://a/1", "<p>same</p>", "x"),
    (2, "http://a/2", "<p>same</p>", "x"),
    (9, None, "<p>same</p>", "x"),
    (1, "http://a/é b\n", "été 漢字 🙂\r\n\r\nWARC/1.1\r\n", "x"),
    (3, "http://b/", "", "x"),
    (4, "http://b/", None, "x"),
    (6, "http://b/", "z" * 300_000, "x"),
    (None, "http://c/", "<p>same</p>", "x"),
    (None, "http://c/", "alone", "x"),
    (2, "http://a/2", "<p>same</p>", "x"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def written(spark, space, pages=PAGES):
    warc.register(spark)
    path = space.path("archives")
    docs = spark.createDataFrame(pages, SCHEMA).repartition(3)
    warc.records(docs).write.format("warc").mode("append").save(path)
    return path


def test_round_trip(spark):
    with Workspace(spark) as space:
        found = spark.read.format("warc").load(written(spark, space)).collect()
    assert len(found) == len(PAGES)
    by_payload = {}
    for i, _, html, _ in PAGES:
        by_payload.setdefault(html or "", []).append(i)
    expected = []
    for i, _, html, _ in PAGES:
        known = [x for x in by_payload[html or ""] if x is not None]
        first = min(known) if known else None
        kind = "response" if i == first else "revisit"
        payload = (html or "").encode()
        expected.append((f"urn:page:{'' if i is None else i}", kind, f"sha1:{digest(html)}", len(payload), None if kind == "response" else f"urn:page:{first}", payload if kind == "response" else b""))
    shown = [(r.record_id, r.record_type, r.payload_digest, r.payload_length, r.refers_to, bytes(r.payload)) for r in found]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)


def test_filters_are_pushed_and_payloads_skipped(spark, capfd):
    with Workspace(spark) as space:
        path = written(spark, space)
        read = spark.read.format("warc").load(path)
        assert read.filter("record_type = 'revisit'").count() == 4
        assert {r.record_id for r in read.filter("target_uri like 'http://b%' and record_type in ('response')").collect()} == {"urn:page:3", "urn:page:6"}
        assert read.filter("refers_to is not null and payload_length = 0").count() == 1
        bare = spark.read.format("warc").option("payload", "false").load(path)
        assert bare.filter("payload is not null").count() == 0
        assert bare.select("record_id").distinct().count() == 8


def test_reader_takes_what_headers_decide():
    reader = warc.WarcReader({"path": "/nowhere"})
    mine = [warc.EqualTo(("record_type",), "response"), warc.In(("target_uri",), ("a", "b")), warc.IsNotNull(("refers_to",))]
    others = [warc.EqualTo(("payload_length",), 3), warc.EqualTo(("payload",), b"x")]
    assert list(reader.pushFilters([*mine, *others])) == others
    assert len(reader.tests) == 3


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        Counted.taken += len(out)
        return out


def test_unwanted_blocks_are_not_read():
    row = {"record_id": "urn:x", "record_type": "response", "target_uri": "http://a", "date": None, "payload_digest": "sha1:A", "payload_length": 5000, "refers_to": None, "payload": b"p" * 5000}
    data = b"".join(warc.record({**row, "record_type": kind}) for kind in ("response", "metadata", "response"))
    stream = Counted(data)
    found = list(warc.read_records(stream, lambda r: r["record_type"] == "metadata", True))
    assert len(found) == 1 and Counted.taken < 6000


def test_headers_of_other_writers():
    text = b"\r\nWARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI: http://x/\r\n y\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (found,) = warc.read_records(io.BufferedReader(io.BytesIO(text)), lambda r: True, True)
    assert (found["record_type"], found["target_uri"], found["payload"]) == ("response", "http://x/ y", b"abcd")
    with pytest.raises(ValueError):
        list(warc.read_records(io.BufferedReader(io.BytesIO(text[:-10])), lambda r: True, True))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BufferedReader(io.BytesIO(b"nonsense\r\n")), lambda r: True, True))


def test_only_committed_files_are_left(spark, tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)}, False)
    row = dict.fromkeys(["target_uri", "date", "payload_digest", "refers_to"]) | {"record_id": "urn:x", "record_type": "response", "payload_length": 1, "payload": b"x"}
    kept, lost = writer.write(iter([row])), writer.write(iter([row]))
    writer.commit([kept, None])
    assert os.listdir(tmp_path) == kept.files and lost.files != kept.files
    writer.write(iter([row]))
    writer.abort([])
    assert os.listdir(tmp_path) == kept.files


def test_files_are_planned_by_size(tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 100)
    planned = warc.WarcReader({"path": str(tmp_path), "partitionbytes": "250"}).partitions()
    assert [len(p.paths) for p in planned] == [2, 2, 1]


def test_no_pages(spark):
    with Workspace(spark) as space:
        path = written(spark, space, [])
        assert spark.read.format("warc").load(path).count() == 0


def test_base32(spark):
    values = ["", "a", "été", "x" * 1000]
    found = spark.createDataFrame([(v,) for v in values], "v string").select("v", warc.sha1_base32(F.encode("v", "UTF-8")).alias("d")).collect()
    assert all(r["d"] == digest(r["v"]) for r in found)


def test_compressed_archives(spark, tmp_path):
    """Members of other writers, one with two records, and payloads of all sizes; unwanted ones stay deflated."""
    plain = [warc.record(saved(f"urn:{i}", "response", bytes(range(256)) * (i * 37))) for i in range(12)]
    folder = tmp_path / "archives"
    folder.mkdir()
    spoilt = bytearray(warc.member(warc.record(saved("urn:x", "metadata", random.Random(1).randbytes(900_000)))))
    spoilt[300_000:600_000] = bytes(300_000)  # reading this payload would fail
    told = b"".join(map(warc.member, plain[:6])) + bytes(spoilt) + gzip.compress(plain[6] + plain[7]) + b"".join(map(warc.member, plain[8:]))
    (folder / "a.warc.gz").write_bytes(told)
    warc.register(spark)
    table = spark.read.format("warc").load(str(folder))
    found = {r["record_id"]: bytes(r["payload"]) for r in table.filter("record_type = 'response'").collect()}
    assert found == {f"urn:{i}": bytes(range(256)) * (i * 37) for i in range(12)}
    headers = spark.read.format("warc").option("payload", "false").load(str(folder))
    assert headers.count() == 13
    with pytest.raises(Exception, match="invalid stored block"):
        table.filter("record_type = 'metadata'").collect()


def test_members_are_gzip(spark, tmp_path):
    rows = [saved("urn:a", "response", b"abc" * 1000), saved("urn:b", "response", b"")]
    assert gzip.decompress(b"".join(warc.member(warc.record(r)) for r in rows)) == b"".join(map(warc.record, rows))


def saved(record_id, record_type, payload):
    return {
        "record_id": record_id,
        "record_type": record_type,
        "target_uri": None,
        "date": None,
        "payload_digest": None,
        "payload_length": len(payload),
        "refers_to": None,
        "payload": payload,
    }
