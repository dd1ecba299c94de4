import base64
import gzip
import hashlib
import io

import pytest

from auditlake.llm import warc
from auditlake.llm.common import open_filesystem, qualified


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip_with_revisits(spark):
    body = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 200_000, "<p>a</p>"]
    rows = [(i + 10, f"http://x/{i}", t) for i, t in enumerate(body)]
    folder = warc.write_archives(pages(spark, rows).repartition(3))
    got = {r.page_id: r for r in warc.read_archives(spark, folder, with_payload=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        10: ("response", None), 11: ("response", None), 12: ("revisit", 10), 13: ("response", None),
        14: ("revisit", 13), 15: ("response", None), 16: ("revisit", 10),
    }
    for i, url, text in rows:
        text = text or ""
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(text.encode()), digest(text), url)
        assert got[i].payload == (None if got[i].record_type == "revisit" else text.encode())


def test_small_payloads_are_not_revisited(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = warc.read_archives(spark, warc.write_archives(pages(spark, rows), min_revisit=3)).orderBy("page_id").collect()
    assert [r.refers_to for r in got] == [None, None, None, 3]


def test_odd_rows(spark):
    rows = [(None, "u", "same"), (5, "bad\r\nX: y", "same"), (5, None, "same"), (9, "", "same"), (None, "u", "alone")]
    got = warc.read_archives(spark, warc.write_archives(pages(spark, rows))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0), (9, "revisit", 5),
    ]
    assert warc.read_archives(spark, warc.write_archives(pages(spark, []))).count() == 0


def test_every_record_is_a_gzip_member_of_its_own(spark):
    folder = warc.write_archives(pages(spark, [(i, "u", f"text {i}") for i in range(4)]).coalesce(1))
    filesystem, base = open_filesystem(folder)
    name = spark.read.parquet(f"{folder}/_manifest").first().archive
    raw = filesystem.open_input_stream(f"{base}/{name}", compression=None).read()
    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1\r\n") == 4 and raw.count(b"\x1f\x8b\x08") >= 4


class Slow(io.BytesIO):
    """A stream that gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_the_reader_takes_any_chunks_and_refuses_damage():
    good = warc.member(1, "u", b"payload " * 50, None) + warc.member(2, "u", b"", None) + warc.member(3, "u", b"payload " * 50, 1)
    assert [r["record_type"] for r in warc.records(Slow(good))] == ["response", "response", "revisit"]
    with pytest.raises(ValueError, match="within a member"):
        list(warc.records(io.BytesIO(good[:-5])))
    whole = gzip.decompress(warc.member(1, "u", b"abcdef", None))
    for wrong, why in ((whole.replace(b"abcdef", b"abcdeg"), "digest"), (whole.replace(b"abcdef", b"abc"), "Content-Length"), (whole.replace(b"abcdef", b"abcdefgh"), "Content-Length")):
        with pytest.raises(ValueError, match=why):
            list(warc.records(io.BytesIO(gzip.compress(wrong))))


def foreign(kind, block, *, version="WARC/1.0", content_type=None, **headers):
    """A record as other programs write it: no page id, other digests or none."""
    lines = [version, f"WARC-Type: {kind}", "warc-record-id: <urn:uuid:x>", f"Content-Length: {len(block)}"]
    lines += [f"Content-Type: {content_type}"] if content_type else []
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def archive_of_others():
    message = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>page</p>"
    return [
        foreign("warcinfo", b"software: other\r\n\r\nmore", content_type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.0\r\n\r\n", content_type="application/http; msgtype=request", WARC_Target_URI="http://a/"),
        foreign("response", message, version="WARC/1.1", content_type="application/http;msgtype=response", WARC_Payload_Digest="sha1:" + digest("<p>page</p>")),
        foreign("response", message, content_type="application/http", WARC_Block_Digest="sha256:" + hashlib.sha256(message).hexdigest()),
        foreign("resource", b"\x00\xff" * 10, content_type="image/png", WARC_Payload_Digest="whirlwind:123"),
        foreign("response", b"HTTP/1.0 204 No", content_type="application/http"),
        foreign("metadata", b""),
        foreign("revisit", b"HTTP/1.0 200 OK\r\n\r\n", content_type="application/http", WARC_Payload_Digest="sha1:ABC"),
    ]


def test_records_of_other_programs():
    got = list(warc.records(Slow(b"".join(archive_of_others())), with_payload=True))
    assert [(r["record_type"], r["payload"]) for r in got] == [
        ("warcinfo", b"software: other\r\n\r\nmore"), ("request", b""), ("response", b"<p>page</p>"), ("response", b"<p>page</p>"),
        ("resource", b"\x00\xff" * 10), ("response", b""), ("metadata", b""), ("revisit", b""),
    ]
    assert {r["page_id"] for r in got} == {None} and got[1]["url"] == "http://a/" and got[0]["url"] is None
    assert got[3]["payload_digest"] == digest("<p>page</p>") and (got[7]["payload_bytes"], got[7]["payload_digest"]) == (None, "ABC")
    wrong = foreign("response", b"HTTP/1.0 200 OK\r\n\r\nabc", content_type="application/http", WARC_Payload_Digest="sha1:" + digest("abd"))
    with pytest.raises(ValueError, match="payload"):
        list(warc.records(io.BytesIO(wrong)))
    with pytest.raises(ValueError, match="without type"):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"))))


def test_a_folder_of_another_program(spark, tmp_path):
    for i, record in enumerate(archive_of_others()):
        (tmp_path / f"a{i % 2}.warc.gz").open("ab").write(record)
    (tmp_path / "readme.txt").write_text("no archive")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in rows) == ["metadata", "request", "resource", "response", "response", "response", "revisit", "warcinfo"]


def test_negative_ids_and_very_long_payloads(spark):
    rows = [(-7, "u", "y" * 3_000_000), (3, "u", "y" * 3_000_000)]
    got = warc.read_archives(spark, warc.write_archives(pages(spark, rows))).orderBy("page_id").collect()
    assert [(r.page_id, r.payload_bytes, r.refers_to) for r in got] == [(-7, 3_000_000, None), (3, 3_000_000, -7)]


def test_folders_keep_the_file_system_spark_gives_them(spark):
    assert qualified(spark, "/tmp/x") == "file:/tmp/x"
    assert open_filesystem(qualified(spark, "/tmp/x"))[1] == "/tmp/x" and open_filesystem("file:///tmp/x")[1] == "/tmp/x"
    for folder in ("viewfs://here/x", "abfss://here/x"):
        with pytest.raises(ValueError, match="cannot be written"):
            open_filesystem(folder)
    with pytest.raises(ValueError, match="no file system"):
        open_filesystem("/tmp/x")
