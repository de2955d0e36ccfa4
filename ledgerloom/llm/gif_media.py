"""Media columns: animated GIF.

``encode_gif`` stores samples of one byte as a GIF89a of timed grey frames, LZW-coded.  ``decode_gif``
reads any GIF: it unpacks the variable-width LZW codes, undoes interlacing, applies global and local
palettes, and draws each frame on the canvas under the disposal and transparency rules of the format.
``frame_table`` stores the frames of a column of GIFs as rows with times, pixels and a colour histogram;
``store_documents`` codes each text, reads the stored file back in the same worker, and keeps its frames with
their times and histograms as a column.

Frames are at most ``HEIGHT`` rows of ``WIDTH`` samples; an image takes as many frames as it needs, and a
frame is at most 9,216 samples, so the state of the coder stays small for any size of text.

Defined results: null and empty payloads are padded like others (the payload is never empty); equal
payloads give equal files and features, repeated rows included; a damaged GIF raises ValueError in
``decode_gif`` and has no rows in ``frame_table``; an empty table gives no rows; columns that the functions
append replace input columns of the same name, and ``store_documents`` returns only its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, text_bytes

UNIT = 576
WIDTH = 24
HEIGHT = 384
DELAY = 4  # hundredths of a second
BINS = 8

_CHANNELS = np.arange(0, 3 * BINS, BINS, dtype=np.uint8)
_GREY = bytes(v for i in range(256) for v in (i, i, i))
#: By code size: the width of code k after a clear code, before which the decoder knows k - 1 entries more than at first.
_WIDTHS = {bits: np.minimum(np.floor(np.log2((1 << bits) + 1 + np.maximum(np.arange(1 << 13), 1))).astype(np.int64) + 1, 12) for bits in range(1, 9)}


def _widths(first: int, n: int, bits: int) -> np.ndarray:
    """Widths of ``n`` codes from number ``first`` after a clear code."""
    known = _WIDTHS[bits]
    return known[first : first + n] if first + n <= len(known) else known[np.minimum(np.arange(first, first + n), len(known) - 1)]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's LZW: variable-width codes, packed from the low bit; a clear code comes first and when the table is full.

    The table is a tree: each code has its longer codes by their last sample, so a step looks a small number up.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    groups: list[list[int]] = []
    out: list[int] = []
    none: dict[int, int] = {}
    longer, put, free = [none] * 4096, out.append, end + 1
    if data:
        now, after = data[0], none
        for b in data[1:]:
            if b in after:
                now = after[b]
                after = longer[now]
                continue
            put(now)
            if free < 4096:
                if after is none:
                    longer[now] = {b: free}
                else:
                    after[b] = free
                free += 1
            else:
                put(clear)
                groups.append(out)
                out, longer, free = [], [none] * 4096, end + 1
                put = out.append
            now, after = b, longer[b]
        put(now)
    put(end)
    groups.append(out)
    codes = np.concatenate([[clear], *groups])
    widths = np.concatenate([[bits + 1], *[_widths(0, len(g), bits) for g in groups]])
    ends = np.cumsum(widths)
    spots = ends - widths
    # a code of up to 12 bits lies in the three bytes from that of its first bit; no two codes share a bit, so sums are unions
    at, moved, size = spots >> 3, codes << (spots & 7), int(ends[-1]) + 7 >> 3
    packed = np.bincount(at, moved & 255, size + 2) + np.bincount(at + 1, moved >> 8 & 255, size + 2) + np.bincount(at + 2, moved >> 16, size + 2)
    return packed[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """At most ``size`` samples of a code stream; streams may clear early or late, or keep a full table.

    Widths depend only on a code's number after the last clear code, so a run of codes is unpacked at once.
    """
    if not 1 <= bits <= 8:
        raise ValueError("LZW code size")
    clear, end, run = 1 << bits, (1 << bits) + 1, 1 << 12
    padded = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int64)
    threes, total = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16, 8 * len(data)
    out: list[bytes] = []
    since: list[np.ndarray] = []  # the codes since the last clear code
    at = number = have = 0
    ended = False
    while have < size and not ended:
        widths = _widths(number, max(0, min(run, (total - at) // (bits + 1))), bits)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        spots = ends[:n] - widths[:n]
        codes = threes[spots >> 3] >> (spots & 7) & (1 << widths[:n]) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stops[0]) if len(stops) else n
        since.append(codes[:upto])
        number += upto
        if 0 < n == upto and number < size - have:  # a code gives one sample at least
            at = int(ends[n - 1])
            continue
        out.append(_spelled(np.concatenate(since), clear, size - have))
        have += len(out[-1])
        ended = upto == n or codes[upto] == end
        if not ended:
            at, number, since = int(ends[upto]), 0, []
    return b"".join(out)


def _spelled(codes: np.ndarray, clear: int, most: int) -> bytes:
    """At most ``most`` samples of the codes after a clear code.

    The table's k-th entry is what code k gives and the first sample of code k + 1.  So lengths and first samples follow
    from chains of entries, which are halved until they end, and all codes are written from their ends at once.
    """
    n = len(codes)
    if not n:
        return b""
    entry, own = codes - (clear + 2), np.arange(n)
    if (entry >= own).any():
        raise ValueError("LZW code ahead of its table")
    long = entry >= 0
    root, lengths = np.where(long, entry, own), long.astype(np.int64)
    while (more := lengths[root]).any():
        lengths, root = lengths + more, root[root]
    ends = np.cumsum(lengths + 1)
    kept = int(np.searchsorted(ends, most)) + 1  # codes that begin before ``most``
    ends, entry, lengths, first = ends[:kept], entry[:kept], lengths[:kept], codes[root].astype(np.uint8)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - lengths - 1] = first[:kept]
    left = np.flatnonzero(entry >= 0)
    at, k = ends[left] - 1, entry[left]
    while len(k):
        out[at] = first[k + 1]
        k = entry[k]
        left = k >= 0
        at, k = at[left] - 1, k[left]
    return out[:most].tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(p),)) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """Samples as grey frames; the length must be a multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be whole rows")
    tall = min(height, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), _GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for i in range(0, len(payload), width * height):
        part = payload[i : i + width * height]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass(frozen=True)
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height of what the frame drew
    pixels: np.ndarray  # the whole canvas after drawing: height x width x RGB


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and the drawn frames."""
    frames = list(iter_frames(data))
    width, height = struct.unpack_from("<HH", data, 6)
    return width, height, frames


def iter_frames(data: bytes, keep: bool = True) -> Iterator[Frame]:
    """The drawn frames; without ``keep`` each one's pixels are the canvas itself, to be read before the next is drawn."""
    try:
        yield from _iter_frames(data, keep)
    except (IndexError, struct.error) as error:
        raise ValueError("truncated GIF") from error


def _iter_frames(data: bytes, keep: bool) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flags & 7) + 1
        if at + n > len(data):
            raise ValueError("truncated GIF")
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(flags) if flags & 0x80 else None
    canvas = np.zeros((height, width, 3), np.uint8)
    clock, delay, disposal, transparent = 0, 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(packed) if packed & 0x80 else shared
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        at += 1
        samples = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("truncated image")
        samples = samples.reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            undone = np.empty_like(samples)
            undone[rows] = samples
            samples = undone
        if samples.size and int(samples.max()) >= len(colours):
            colours = np.concatenate([colours, np.zeros((256 - len(colours), 3), np.uint8)])
        saved = canvas.copy() if disposal == 3 else None
        inside = samples[: max(0, height - top), : max(0, width - left)]
        view = canvas[top : top + inside.shape[0], left : left + inside.shape[1]]
        drawn = colours[inside]
        view[...] = drawn if transparent is None else np.where((inside == transparent)[..., None], view, drawn)
        yield Frame(clock * 10, delay * 10, (left, top, w, h), canvas.copy() if keep else canvas)
        clock += delay
        if disposal == 2:
            # to the background: transparent in practice, and so black here
            view[...] = 0
        elif disposal == 3:
            canvas = saved
        delay, disposal, transparent = 0, 0, None


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of pixels in ``BINS`` equal ranges of each of red, green and blue, in that order."""
    shift = 8 - BINS.bit_length() + 1
    return np.bincount(((pixels >> shift) + _CHANNELS).ravel(), minlength=3 * BINS)


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    """The text's bytes, padded with 255 to a positive multiple of ``unit``."""
    return text + b"\xff" * (-len(text) % unit if text else unit)


def text_to_gif(df: DataFrame, text_column: str = "text", into: str = "media") -> DataFrame:
    """Append each whole text as a GIF."""

    @F.arrow_udf("binary")
    def gif(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([encode_gif(payload_of(as_bytes(x.as_py()))) for x in batch], pa.binary())

    return df.withColumn(into, gif.asNondeterministic()(text_bytes(text_column)))


_FRAMES = "array<struct<frame:int,start_ms:bigint,delay_ms:bigint,width:int,height:int,pixels:binary,histogram:array<bigint>>>"


def frame_table(df: DataFrame, media: str | Column = "media") -> DataFrame:
    """A row per frame with ``frame``, ``start_ms``, ``delay_ms``, ``width``, ``height``, ``pixels`` (RGB) and ``histogram``.

    The other columns of ``df`` are kept; a damaged GIF gives no rows.
    """
    kind = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    def rows(data: bytes) -> list[dict]:
        try:
            return [{"frame": i, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": f.pixels.shape[1], "height": f.pixels.shape[0],
                     "pixels": f.pixels.tobytes(), "histogram": histogram(f.pixels).tolist()} for i, f in enumerate(iter_frames(data))]
        except ValueError:
            return []

    @F.arrow_udf(_FRAMES)
    def frames(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([rows(as_bytes(x.as_py())) for x in batch], kind)

    column = F.col(media) if isinstance(media, str) else media
    made = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), frames.asNondeterministic()(column).alias("__frames")).select("__row", F.explode("__frames").alias("__f"))
    return made.select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c not in {f.name for f in kind.value_type}], "__f.*")


_STORED = (
    "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,"
    "frames:array<struct<start_ms:bigint,delay_ms:bigint,width:int,height:int,histogram:array<bigint>>>>"
)
_FRAME_KIND = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
_STORED_KIND = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(_FRAME_KIND))])


def stored(text: bytes) -> dict:
    """What a text's GIF is and decodes to: digests of file and samples, and each frame's times, size and histogram of what it drew."""
    media = encode_gif(payload_of(text))
    digest, size, tail, frames = hashlib.sha256(), 0, b"", []
    for frame in iter_frames(media, keep=False):
        left, top, w, h = frame.box
        drawn = frame.pixels[top : top + h, left : left + w]
        samples = drawn[..., 0].tobytes()  # grey: the red channel is the sample
        digest.update(samples)
        size, tail = size + len(samples), (tail + samples[-32:])[-32:]
        frames.append({"start_ms": frame.start_ms, "delay_ms": frame.delay_ms, "width": w, "height": h, "histogram": histogram(drawn).tolist()})
    return {"payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "frames": frames}


def store_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, sizes and digests of the text stored as a GIF and read back, its ``frames`` (times and colour histograms) and ``feature``, which sums them up."""

    @F.arrow_udf(_STORED)
    def gif(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for i in range(0, len(batch), 64):
                yield pa.array([stored(as_bytes(x.as_py())) for x in batch.slice(i, 64)], _STORED_KIND)

    out = docs.select(F.col(id_column).alias("__id"), F.length(text_bytes(text_column)).cast("bigint").alias("n_bytes"), gif.asNondeterministic()(text_bytes(text_column)).alias("g"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 3 * BINS)
    counts = F.aggregate("g.frames", zero, lambda sums, f: F.zip_with(sums, f["histogram"], lambda a, b: a + b))
    end = F.element_at("g.frames", -1)
    feature = F.concat(
        F.lit("gif;frames="), F.size("g.frames").cast("string"), F.lit(";ms="), (end["start_ms"] + end["delay_ms"]).cast("string"),
        F.lit(";rgb="), F.array_join(counts.cast("array<string>"), ","),
    )
    return out.select(F.col("__id").alias(id_column), "n_bytes", "g.payload_bytes", "g.payload_sha256", "g.tail_crc32", "g.media_bytes", "g.media_sha256", feature.alias("feature"), "g.frames")
