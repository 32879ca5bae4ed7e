"""GIF as a media column: LZW streams, palettes, disposal and transparency, timed frames, colour histograms.

The codes of many streams are read in step, as arrays. An LZW table entry is always a stretch of what the stream has given
so far, so reading codes only notes where each one's stretch begins; the bytes are then filled in by following these notes,
all positions at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, over_arrow, ranges, with_columns_of

SIDE = 24
PIECE = SIDE * SIDE
#: Streams read in step, streams packed at once, and payload bytes that one group of documents may hold.
TOGETHER, PACKED, GROUP_BYTES = 1024, 16, 4 << 20
DELAY = 4  # hundredths of a second
#: Pixels of a screen or an image beyond which a GIF isn't decoded: a frame's RGBA bytes must fit into one value of a column.
MOST_PIXELS = 1 << 26


@lru_cache(1)
def palette_332() -> np.ndarray:
    """256 colours: three bits of red, three of green, two of blue. The top bits give the index back."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], axis=1).astype(np.uint8)


def index_332(rgb: np.ndarray) -> np.ndarray:
    return (rgb[..., 0] >> 5 << 5 | rgb[..., 1] >> 5 << 2 | rgb[..., 2] >> 6).astype(np.uint8)


def lzw_codes(data: bytes, bits: int = 8) -> list[list[int]]:
    """Codes of data in runs; a run starts where the table is cleared."""
    if not data:
        return [[]]
    first, runs = (1 << bits) + 2, []
    table: dict[int, int] = {}
    out: list[int] = []
    get, put, free = table.get, out.append, first
    code, *rest = data
    for b in rest:
        key = code << 8 | b
        known = get(key)
        if known is not None:
            code = known
            continue
        put(code)
        code = b
        if free < 4095:
            table[key] = free
            free += 1
        else:
            runs.append(out)
            table, out = {}, []
            get, put, free = table.get, out.append, first
    put(code)
    return [*runs, out]


@lru_cache(16)
def code_widths(bits: int) -> np.ndarray:
    """How wide code j after a clear is, from j = 1 on: as wide as the reader's next entry asks for."""
    free = np.maximum((1 << bits) + 2, (1 << bits) + np.arange(1, 4200))
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, bits + 1, 12)


def lzw_pack(streams: list[list[list[int]]], bits: int = 8) -> list[bytes]:
    """Runs of codes to bytes, low bits first; each stream ends on a byte."""
    clear, widths = 1 << bits, code_widths(bits)
    codes, parts, ends = [], [], []
    for runs in streams:
        total, before = 0, None
        for r, run in enumerate(runs):
            last = r == len(runs) - 1
            start = bits + 1 if before is None else int(widths[before])  # a clear is as wide as the code that it stands for
            n = len(run) + last
            codes += [clear, *run, clear + 1] if last else [clear, *run]
            parts += [np.array([start]), widths[:n]]
            total, before = total + start + int(widths[:n].sum()), len(run)
        if fill := -total % 8:
            codes.append(0)
            parts.append(np.array([fill]))
        ends.append((total + fill) // 8)
    c, w = np.array(codes, np.uint16), np.concatenate(parts)
    place = np.arange(12, dtype=np.uint16)
    flat = (c[:, None] >> place & 1).astype(np.uint8)[place[None, :] < w[:, None]]
    packed, at, out = np.packbits(flat, bitorder="little").tobytes(), 0, []
    for n in ends:
        out.append(packed[at : at + n])
        at += n
    return out


def lzw_decode(streams: list[bytes], bits: int, sizes: list[int]) -> list[np.ndarray]:
    """The first `sizes` bytes of each stream; ValueError if one ends early or holds a code that its table hasn't yet."""
    out: list[np.ndarray] = []
    for a in range(0, len(streams), TOGETHER):
        out += _decode_some(streams[a : a + TOGETHER], bits, np.array(sizes[a : a + TOGETHER], np.int64))
    return out


def _decode_some(streams: list[bytes], bits: int, sizes: np.ndarray) -> list[np.ndarray]:
    n, clear = len(streams), 1 << bits
    lengths = np.fromiter(map(len, streams), np.int64, n)
    wide = int(lengths.max(initial=0)) + 4
    data = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in streams), np.uint8).astype(np.uint32)
    # Of each stream still read: its number, place in bits, width, next entry, start and length of the code before, length so far.
    who = np.flatnonzero(sizes > 0)
    at, width, free = np.zeros(len(who), np.int64), np.full(len(who), bits + 1), np.full(len(who), clear + 2)
    last, last_n, done = np.full(len(who), -1), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    starts, spans = np.zeros((n, 4097), np.int32), np.ones((n, 4097), np.int32)
    notes: list[tuple[np.ndarray, ...]] = []  # stream, where, from where (-1 - byte for a literal), how long
    while len(who):
        if (at + width > 8 * lengths[who]).any():
            raise ValueError("an LZW stream ends early")
        byte = who * wide + (at >> 3)
        word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        code = (word >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)
        at = at + width
        is_clear, is_end = code == clear, code == clear + 1
        plain = code < clear
        fresh = last < 0
        told = ~is_clear & ~is_end
        if (told & ((code > free) | (fresh & ~plain) | ((code == free) & (free > 4095)))).any():
            raise ValueError("an LZW code is not in its table")
        new = code == free
        slot = np.where(told & ~plain, code, 0)
        start = np.where(plain, -1 - code, np.where(new, last, starts[who, slot]))
        span = np.where(plain, 1, np.where(new, last_n + 1, spans[who, slot]))
        grow = told & ~fresh & (free < 4096)
        entry = np.where(grow, free, 4096)
        starts[who, entry], spans[who, entry] = last, last_n + 1
        free = np.where(is_clear, clear + 2, free + grow)
        width = np.where(is_clear, bits + 1, np.minimum(12, width + (free >= 1 << width)))
        notes.append((who[told], done[told], start[told], span[told]))
        last, last_n = np.where(told, done, -1), np.where(told, span, 0)
        done = done + np.where(told, span, 0)
        if (is_end & (done < sizes[who])).any():
            raise ValueError("an LZW stream ends early")
        live = (done < sizes[who]) & ~is_end
        if not live.all():
            who, at, width, free, last, last_n, done = (x[live] for x in (who, at, width, free, last, last_n, done))
    if not notes:
        return [np.empty(0, np.uint8) for _ in streams]
    stream, where, start, span = (np.concatenate([x[i] for x in notes]) for i in range(4))
    room = np.bincount(stream, span, n).astype(np.int64)
    base = np.cumsum(room) - room
    target = ranges(base[stream] + where, span)
    literal = start < 0
    link = np.empty(int(room.sum()), np.int64)
    link[target] = ranges(np.where(literal, base[stream] + where, base[stream] + start), span)
    value = np.zeros(len(link), np.uint8)
    value[(base[stream] + where)[literal]] = (-1 - start[literal]).astype(np.uint8)
    while True:
        further = link[link]
        if np.array_equal(further, link):
            break
        link = further
    found = value[link]
    return [found[b : b + s] for b, s in zip(base.tolist(), sizes.tolist(), strict=True)]


@dataclass
class Image:
    """One image block: place, colours, indices; delay in hundredths of a second, disposal 0 to 3, transparent index or -1."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    indices: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int = -1


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


def gif_bytes(packed: list[bytes], width: int, height: int, palette: np.ndarray, delay: int = DELAY, disposal: int = 1) -> bytes:
    """An endless animation of full frames, whose LZW streams are `packed`."""
    head = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\xf7\0\0" + palette.tobytes()
    head += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    control = b"\x21\xf9\x04" + bytes([disposal << 2]) + delay.to_bytes(2, "little") + b"\0\0"
    image = b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\0\x08"
    return head + b"".join(control + image + _blocks(p) for p in packed) + b";"


def encode_gifs(payloads: list[bytes], side: int = SIDE) -> list[bytes]:
    """Each payload, a positive multiple of side * side bytes, as indices of full frames."""
    size = side * side
    counts = [len(p) // size for p in payloads]
    codes = (lzw_codes(p[i : i + size]) for p in payloads for i in range(0, len(p), size))
    packed: list[bytes] = []
    while some := list(islice(codes, PACKED)):
        packed += lzw_pack(some)
    ends = np.cumsum(counts).tolist()
    return [gif_bytes(packed[e - n : e], side, side, palette_332()) for n, e in zip(counts, ends, strict=True)]


def encode_gif(payload: bytes, side: int = SIDE) -> bytes:
    return encode_gifs([payload], side)[0]


def parse_gif(data: bytes) -> tuple[int, int, list[tuple[Image, bytes, int, bool]]]:
    """(width, height, images with their LZW streams, code sizes and interlacing). ValueError where it isn't a whole GIF of a
    sane size: code sizes are 2 to 8 bits, and screens and images have MOST_PIXELS at most."""
    try:
        return _parse(data)
    except IndexError:
        raise ValueError("a GIF ends early") from None


def _parse(data: bytes) -> tuple[int, int, list[tuple[Image, bytes, int, bool]]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    two = lambda i: data[i] | data[i + 1] << 8
    width, height, flags, at = two(6), two(8), data[10], 13
    if width * height > MOST_PIXELS:
        raise ValueError("a GIF's screen is too large")

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 3 * (2 << (flags & 7))
        if at + n > len(data):
            raise IndexError
        table = np.zeros((256, 3), np.uint8)
        table[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        return table, at + n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    common = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        common, at = colours(flags, at)
    found, delay, disposal, transparent = [], 0, 0, -1
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            block, end = sub_blocks(at + 2)
            if label == 0xF9:
                delay, disposal, transparent = block[1] | block[2] << 8, block[0] >> 2 & 7, block[3] if block[0] & 1 else -1
            at = end
        elif kind == 0x2C:
            flags, own = data[at + 9], common
            image = Image(two(at + 1), two(at + 3), two(at + 5), two(at + 7), own, np.empty(0, np.uint8), delay, disposal, transparent)
            at += 10
            if flags & 0x80:
                image.palette, at = colours(flags, at)
            bits = data[at]
            if not 2 <= bits <= 8 or image.width * image.height > MOST_PIXELS:
                raise ValueError("a GIF's image has an impossible size")
            stream, at = sub_blocks(at + 1)
            found.append((image, stream, bits, bool(flags & 0x40)))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("a GIF holds an unknown block")
    return width, height, found


def read_each(files: list[bytes]) -> list[tuple[int, int, list[Image]] | None]:
    """read_gifs(), with None for what isn't a whole GIF."""
    try:
        return list(read_gifs(files))
    except ValueError:
        if len(files) == 1:
            return [None]
        return [x for f in files for x in read_each([f])]


def read_gifs(files: list[bytes]) -> list[tuple[int, int, list[Image]]]:
    """All files' images with their indices; streams of one code size are decoded together."""
    parsed = [parse_gif(f) for f in files]
    by_bits: dict[int, list[tuple[Image, bytes, bool]]] = {}
    for _, _, images in parsed:
        for image, stream, bits, woven in images:
            by_bits.setdefault(bits, []).append((image, stream, woven))
    for bits, some in by_bits.items():
        for (image, _, woven), flat in zip(some, lzw_decode([s for _, s, _ in some], bits, [i.width * i.height for i, _, _ in some]), strict=True):
            rows = flat.reshape(image.height, image.width)
            if woven:
                order = np.concatenate([np.arange(a, image.height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = rows[np.argsort(order, kind="stable")]
            image.indices = rows
    return [(w, h, [x[0] for x in images]) for w, h, images in parsed]


def compose(width: int, height: int, images: list[Image]) -> Iterator[tuple[np.ndarray, int]]:
    """(height x width x RGBA, delay in ms) of each frame as shown. Nothing drawn: transparent black.

    Disposal, after the frame is shown: 0, 1 leave it; 2 clears its area; 3 puts back what was there. A transparent index
    leaves the pixel under it. What lies outside of the screen isn't drawn.
    """
    canvas = np.zeros((height, width, 4), np.uint8)
    for image in images:
        before = canvas.copy() if image.disposal == 3 else None
        area = canvas[image.top : image.top + image.height, image.left : image.left + image.width]
        indices = image.indices[: area.shape[0], : area.shape[1]]
        drawn = indices != image.transparent
        area[drawn] = np.concatenate([image.palette, np.full((256, 1), 255, np.uint8)], axis=1)[indices[drawn]]
        yield canvas.copy(), 10 * image.delay
        if image.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Pixels of each of 64 colours: the top two bits of red, green, blue."""
    bins = (rgb[..., 0] >> 6).astype(np.int64) << 4 | (rgb[..., 1] >> 6).astype(np.int64) << 2 | rgb[..., 2] >> 6
    return np.bincount(bins.ravel(), minlength=64)


def frames(media: DataFrame) -> DataFrame:
    """(doc_id, frame, start_ms, delay_ms, width, height, histogram array<long>, rgba binary) of (doc_id, media): GIFs to frames.

    Null media and bytes that aren't a whole GIF give no rows. An empty table gives no rows.
    """
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (whole := read_each([data.as_py() or b""])[0]) is None:
                    continue
                width, height, images = whole
                start, rows = 0, []
                for n, (rgba, delay) in enumerate(compose(width, height, images)):
                    rows.append((key, n, start, delay, width, height, histogram(rgba[rgba[..., 3] > 0]).tolist(), rgba.tobytes()))
                    start += delay
                    if len(rows) * max(1, rgba.nbytes) > GROUP_BYTES:
                        yield _frame_batch(rows)
                        rows = []
                if rows:
                    yield _frame_batch(rows)

    schema = "doc_id long, frame int, start_ms long, delay_ms int, width int, height int, histogram array<long>, rgba binary"
    return over_arrow(with_columns_of(media, ["doc_id", "media"]).select(F.col("doc_id").cast("long"), "media"), run, schema)


def _frame_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64())), ("rgba", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], schema=pa.schema(types))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % PIECE if text else PIECE)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_py() or b"" for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(encode_gifs([padded(x) for x in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _told(data: bytes, gif: tuple[int, int, list[Image]]) -> tuple:
    width, height, images = gif
    payload, counts, shown = hashlib.sha256(), np.zeros(64, np.int64), 0
    size, tail = 0, b""
    whole = all(i.disposal < 2 and i.transparent < 0 and i.indices.shape == (height, width) and not i.left and not i.top for i in images)
    # Full opaque frames show their own colours only, so that many are coloured at once.
    if whole and len({i.palette.tobytes() for i in images}) == 1:
        groups = (images[a : a + 64] for a in range(0, len(images), 64))
        pictures = ((images[0].palette[np.stack([i.indices for i in g])], sum(10 * i.delay for i in g)) for g in groups)
    else:
        pictures = ((x[..., :3], ms) for x, ms in compose(width, height, images))
    for rgb, ms in pictures:
        part = index_332(rgb).tobytes()
        payload.update(part)
        size, tail, shown = size + len(part), (tail + part[-32:])[-32:], shown + ms
        counts += histogram(rgb)
    feature = f"{len(images)}x{width}x{height}@{shown}ms:{','.join(map(str, counts.tolist()))}"
    return size, payload.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, group, size = [], [], 0
        values = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        for n, (key, n_bytes, data) in enumerate(values):
            group.append((key, n_bytes, data.as_py()))
            size += len(group[-1][2] or b"")
            if size > GROUP_BYTES or n == len(values) - 1:
                rows += [(k, m, *(_told(x, g) if g else (None,) * 6)) for (k, m, x), g in zip(group, read_each([x or b"" for _, _, x in group]), strict=True)]
                group, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGEST)], schema=_DIGEST)


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession, 2)
    return with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, filled up with bytes 255 to whole frames, as a GIF. Null is empty."""
    return over_arrow(_texts(docs), _store, "doc_id long, n_bytes long, media binary")


def digest(media: DataFrame) -> DataFrame:
    """Digests of (doc_id, n_bytes, media), from the GIFs' bytes alone: payload by palette from the frames as shown, and a feature.

    feature: number of frames, size, time in ms and the pixels of each of 64 colours over all frames. A row for each row;
    repeated rows and null doc_ids are rows like others. Null media, and bytes that aren't a whole GIF: those columns are null.
    """
    bounded_batches(media.sparkSession)
    return over_arrow(with_columns_of(media, ["doc_id", "n_bytes", "media"]), _digest, DIGEST)


def stored_digest(docs: DataFrame) -> DataFrame:
    """digest(stored(docs)) in one pass: the GIFs' bytes are made and read back without going through the JVM between."""
    return over_arrow(_texts(docs), lambda batches: _digest(_store(batches)), DIGEST)
