import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest

from ledgerloom.llm import gif_media as g

from .fixtures import docs, odd_texts


def test_lzw_round_trips():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 576, 5000, 70_000):
        for make in (lambda: rng.randbytes(n), lambda: b"a" * n, lambda: bytes(rng.choice(b"abc") for _ in range(n))):
            data = make()
            assert g.lzw_decode(g.lzw_encode(data), 8, len(data)) == data
    small = bytes(rng.randrange(4) for _ in range(3000))
    assert g.lzw_decode(g.lzw_encode(small, 2), 2, 3000) == small


def late_clear(data):
    """A stream that keeps its full table: no clear code after the first."""
    codes, table, now = [256], {bytes((i,)): i for i in range(256)}, b""
    free = 258
    for b in data:
        if now + bytes((b,)) in table:
            now += bytes((b,))
            continue
        codes.append(table[now])
        if free < 4096:
            table[now + bytes((b,))] = free
            free += 1
        now = bytes((b,))
    codes += [table[now], 257]
    bits, known = [], 257
    for k, c in enumerate(codes):
        width = 9 if k == 0 else min((known + max(k - 1, 1)).bit_length(), 12)
        bits += [c >> i & 1 for i in range(width)]
    return np.packbits(bits, bitorder="little").tobytes()


def test_a_full_table_may_be_kept():
    data = bytes(random.Random(2).choice(range(64)) for _ in range(60_000))
    assert g.lzw_decode(late_clear(data), 8, len(data)) == data


def test_decoding_has_no_step_for_each_code():
    """Lines of Python that a frame of text takes; its codes are over 2,000."""
    words = random.Random(3).choices(["lorem", "ipsum", "dolor", "sit", "amet", "labore", "magna"], k=1700)
    data = " ".join(words).encode()[:9216]
    packed, lines = g.lzw_encode(data), 0

    def trace(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        got = g.lzw_decode(packed, 8, len(data))
    finally:
        sys.settrace(before)
    assert got == data and len(packed) * 8 > 1500 * 9 and lines < 1000


def test_decoding_runs_of_one_sample_and_codes_ahead():
    for n in (1, 2, 3, 9216, 40_000):
        data = b"\xff" * n
        assert g.lzw_decode(g.lzw_encode(data), 8, n) == data and g.lzw_decode(g.lzw_encode(data), 8, n // 2) == data[: n // 2]
    ahead = np.packbits([256 >> i & 1 for i in range(9)] + [65 >> i & 1 for i in range(9)] + [259 >> i & 1 for i in range(9)], bitorder="little").tobytes()
    with pytest.raises(ValueError, match="ahead"):
        g.lzw_decode(ahead, 8, 9)


def gif(frames, size=(4, 2), palette=bytes(range(12)), extra=b""):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + palette + extra
    for box, samples, disposal, transparent, delay, flags, local in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, *box, flags) + local + b"\x02" + g._blocks(g.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_disposal_transparency_palettes_and_interlace():
    whole, dot = (0, 0, 4, 2), (1, 0, 1, 1)
    local = bytes([200] * 12)
    data = gif([
        (whole, [1] * 8, 1, None, 5, 0, b""), (dot, [2], 3, None, 6, 0, b""), (dot, [0], 1, 0, 7, 0, b""), (dot, [3], 2, None, 8, 0, b""), ((2, 1, 2, 1), [1, 1], 0, None, 9, 0x81, local),
    ], extra=b"\x21\xfe\x03abc\x00")
    w, h, frames = g.decode_gif(data)
    assert (w, h) == (4, 2) and [(f.start_ms, f.delay_ms) for f in frames] == [(0, 50), (50, 60), (110, 70), (180, 80), (260, 90)]
    red = [f.pixels[..., 0].tolist() for f in frames]
    assert red[0] == [[3] * 4] * 2 and red[1][0] == [3, 6, 3, 3]
    assert red[2][0] == [3, 3, 3, 3]  # the dot was taken back, and a transparent one drawn
    assert red[3][0] == [3, 9, 3, 3] and red[4] == [[3, 0, 3, 3], [3, 3, 200, 200]]  # the dot went to the background
    rows = [[i % 4] * 2 for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    woven = gif([((0, 0, 2, 9), sum((rows[i] for i in order), []), 0, None, 0, 0x40, b"")], size=(2, 9))
    assert g.decode_gif(woven)[2][0].pixels[:, 0, 0].tolist() == [3 * (i % 4) for i in range(9)]


@pytest.mark.parametrize("cut", [0, 5, 12, 30, 800, -1, -20])
def test_damage_is_an_error(cut):
    with pytest.raises(ValueError):
        g.decode_gif(g.encode_gif(g.payload_of(b"text"))[:cut])


def test_query_equals_the_payload(spark):
    texts = odd_texts()
    got = g.store_documents(docs(spark)).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode() if r["doc_id"] >= 0 else b""
            pay = data + b"\xff" * (-len(data) % 576 if data else 576)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
            media = g.encode_gif(pay)
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) 
            frames = [np.frombuffer(pay[k : k + 9216], np.uint8) for k in range(0, len(pay), 9216)]
            bins = [3 * np.bincount(f >> 5, minlength=8).tolist() for f in frames]  # grey: the same for the three colours
            assert [(f["start_ms"], f["delay_ms"], f["width"], f["height"], f["histogram"]) for f in r["frames"]] == [(40 * k, 40, 24, len(f) // 24, b) for k, (f, b) in enumerate(zip(frames, bins, strict=True))]
            assert r["feature"] == f"gif;frames={len(frames)};ms={40 * len(frames)};rgb=" + ",".join(map(str, np.sum(bins, 0)))
    by = {r["doc_id"]: r["feature"] for r in got}
    assert by[12] == by[19] and by[0] == by[1]
    assert g.store_documents(docs(spark).limit(0)).isEmpty()


def test_frame_table(spark):
    media = g.text_to_gif(docs(spark)).select("doc_id", "media", "score")
    frames = g.frame_table(media).collect()
    long = sorted((r for r in frames if r["doc_id"] == 10), key=lambda r: r["frame"])
    assert [r["start_ms"] for r in long] == [40 * i for i in range(4)] and all(len(r["pixels"]) == r["width"] * r["height"] * 3 and sum(r["histogram"]) == len(r["pixels"]) for r in long)
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None)], "doc_id long, media binary")
    assert g.frame_table(bad).isEmpty()
    named = media.selectExpr("doc_id", "media", "'own' AS width", "'own' AS __f", "'own' AS __row")
    clashing = g.frame_table(named)
    assert len(clashing.columns) == len(set(clashing.columns)) and {r["width"] for r in clashing.collect()} == {24} and {(r["__f"], r["__row"]) for r in clashing.collect()} == {("own", "own")}


def plain_lzw(data, bits=8):
    """The textbook decoder: one code at a time, its width from the size of its table."""
    stream, out, at, table, before = "".join(f"{b:08b}"[::-1] for b in data), b"", 0, None, None
    while True:
        width = bits + 1 if table is None else min(max((len(table) if before is None else len(table)).bit_length(), bits + 1), 12)
        code, at = int(stream[at : at + width][::-1], 2), at + width
        if code == 1 << bits:
            table, before = [bytes((i,)) for i in range(1 << bits)] + [None, None], None
        elif code == (1 << bits) + 1:
            return out
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            out, before = out + entry, entry


def test_the_stored_files_decode_by_the_textbook():
    rng = random.Random(6)
    for text in (b"", b"abc" * 500, bytes(rng.choice(b"abcde ") for _ in range(40_000)), rng.randbytes(20_000)):
        data, out, at = g.encode_gif(g.payload_of(text)), b"", 13 + 768 + 19
        while data[at] != 0x3B:
            assert data[at : at + 4] == b"\x21\xf9\x04\x04" and data[at + 8] == 0x2C
            w, h = struct.unpack_from("<HH", data, at + 13)
            at, stream = at + 19, b""
            while data[at]:
                stream += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            part = plain_lzw(stream)
            assert len(part) == w * h
            out += part
        assert out == g.payload_of(text)


def test_codes_are_read_without_a_row_of_bits_each(monkeypatch):
    monkeypatch.setattr(np, "unpackbits", lambda *_, **__: 1 / 0)
    rng = random.Random(4)
    for bits in range(2, 9):
        for n in (0, 1, 7, 9000):
            data = bytes(rng.randrange(1 << bits) for _ in range(n))
            stream = g.lzw_encode(data, bits)
            assert g.lzw_decode(stream, bits, n) == data
            assert data.startswith(g.lzw_decode(stream[: len(stream) // 2], bits, n))
