import base64
import glob
import hashlib
import io
import struct

import pytest
import zstandard

from ledgerloom.llm import warc_zstd

from .fixtures import odd_texts

PAGES = "page_id long, url string, html string, digest string, first long"


def pages(spark):
    rows = [(i, f"http://e.org/{i}\r\nX: y", t, "clash", 5) for i, t in enumerate(odd_texts() * 3)]
    rows += [rows[7], (None, None, None, None, None), (None, None, "only without id", None, None), (None, "u", "only without id", None, None), (-4, None, "one two", None, None)]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("files,roll", [(1, 1 << 30), (5, 1 << 30), (2, 40_000)])
def test_round_trip(spark, tmp_path, files, roll):
    manifest = warc_zstd.write_archives(pages(spark), str(tmp_path / "a"), files=files, roll_bytes=roll)
    got = warc_zstd.read_archives(manifest).collect()
    rows = pages(spark).collect()
    assert len(got) == len(rows) and (roll > 1 << 20 or manifest.count() > files)
    digest = lambda r: base64.b32encode(hashlib.sha1((r["html"] or "").encode()).digest()).decode()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[digest(r)] = min(r["page_id"], first.get(digest(r), r["page_id"]))
    size = {digest(r): len((r["html"] or "").encode()) for r in rows}
    responses = {}
    for r in got:
        assert r["payload_bytes"] == size[r["payload_digest"]]
        if r["record_type"] == "response":
            responses.setdefault(r["payload_digest"], []).append(r["page_id"])
            assert r["refers_to"] is None and r["intact"] and len(r["payload"]) == r["payload_bytes"] and r["page_id"] == first.get(r["payload_digest"])
        else:
            assert r["refers_to"] == first.get(r["payload_digest"]) and r["payload"] == b""
    assert all(len(v) == 1 for v in responses.values()) and responses.keys() == size.keys()
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in got) == sorted((r["page_id"] is None, r["page_id"] or 0) for r in rows)


def test_the_file_format(spark, tmp_path):
    many = spark.createDataFrame([(i, f"http://e.org/{i}", f"<html><body class='common words in all pages'>{i} " + "some text " * 40 + "</body></html>", None, None) for i in range(300)], PAGES)
    warc_zstd.write_archives(many, str(tmp_path / "a"), files=1).collect()
    (path,) = glob.glob(str(tmp_path / "a" / "*.warc.zst"))
    data = open(path, "rb").read()
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and struct.unpack_from("<I", data, 8)[0] == 0xEC30A437
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    one = reader.decompressobj()
    record = one.decompress(data[8 + n :])
    assert one.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    fields, http, payload = warc_zstd.parse_record(record)
    assert fields["warc-type"] == "response" and http.startswith(b"HTTP/1.1 200") and warc_zstd.page_of(fields["warc-record-id"]) in range(300)
    assert len(list(warc_zstd.read_frames(io.BytesIO(data), chunk=7))) == 300
    with pytest.raises(ValueError, match="truncated"):
        list(warc_zstd.read_frames(io.BytesIO(data[:-9])))


def test_small_payloads_can_be_kept_whole(spark, tmp_path):
    manifest = warc_zstd.write_archives(pages(spark), str(tmp_path / "a"), least_revisit_bytes=100, files=2)
    for r in warc_zstd.read_archives(manifest).collect():
        assert r["record_type"] == "response" or r["payload_bytes"] >= 100


def test_ids_and_empty_tables(spark, tmp_path):
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 12345, None):
        assert warc_zstd.page_of(warc_zstd.record_id(i)) == i
    assert warc_zstd.read_archives(warc_zstd.write_archives(pages(spark).limit(0), str(tmp_path / "b"))).isEmpty()
