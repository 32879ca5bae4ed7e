"""Images before and after a segmentation network: resizing, channels, masks, prompts, overlays.

The network is given as a callable; arrays are numpy, and frames go through mapInPandas.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned; x is (batch, height, width, channels)."""

    def places(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    x = x.astype(np.float32)
    a, b, f = places(x.shape[1], height)
    x = x[:, a] * (1 - f)[None, :, None, None] + x[:, b] * f[None, :, None, None]
    a, b, f = places(x.shape[2], width)
    return (x[:, :, a] * (1 - f)[None, None, :, None] + x[:, :, b] * f[None, None, :, None]).astype(np.float32)


def preprocess(x: np.ndarray, height: int, width: int, mean: list[float], std: list[float]) -> np.ndarray:
    """(height, width, channels) or a batch of these to (batch, channels, height, width), less mean, over std. Integers count from 0 to 255."""
    x = np.asarray(x)
    x = x[None] if x.ndim == 3 else x
    scale = 255.0 if np.issubdtype(x.dtype, np.integer) else 1.0
    x = x if x.shape[1:3] == (height, width) else resized(x, height, width)
    x = np.moveaxis(x.astype(np.float32) / np.float32(scale), -1, 1)
    return (x - np.asarray(mean, np.float32).reshape(1, -1, 1, 1)) / np.asarray(std, np.float32).reshape(1, -1, 1, 1)


SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type of a PNG by its number of channels, and the other way round (fixed values).
COLOURS, CHANNELS = {1: 0, 2: 4, 3: 2, 4: 6}, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def write_png(pixels: np.ndarray) -> bytes:
    """(height, width) or (height, width, channels) of bytes as a PNG, unfiltered."""
    x = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width, channels = x.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), x.astype(np.uint8).reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOURS[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG that isn't interlaced; palettes are applied. ValueError for anything else."""
    try:
        return _read_png(data)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"not a whole PNG: {e}") from None


def _read_png(data: bytes) -> np.ndarray:
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, b"", None, None
    while True:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    stride = width * channels
    raw = zlib.decompress(packed)
    if len(raw) != height * (stride + 1):
        raise ValueError("a PNG's pixels don't fill its size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        out[y + 1] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y], channels)
    pixels = out[1:].reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if head[3] == 3 and palette is not None else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line's bytes, by the bytes to their left and above them."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # running sums of each channel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError(f"unknown PNG filter {kind}")
    out, up = [0] * step, [0] * step + above.tolist()
    for i, x in enumerate(line.tolist()):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            near = a + b >> 1
        else:
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out.append(x + near & 255)
    return np.array(out[step:], np.uint8)


def prompt_points(points: list[tuple[int, int, int]], boxes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(1, 1, n, 2) places and (1, 1, n) labels: points, then of each box its corners (2, 3) and a filler (-1); nothing: a filler."""
    rows = [*points, *(r for a, b, c, d in boxes for r in ((a, b, 2), (c, d, 3), (0, 0, -1)))] or [(0, 0, -1)]
    table = np.array(rows, np.float32)
    return table[None, None, :, :2], table[None, None, :, 2].astype(np.int32)


def mask_of(logits: np.ndarray, width: int, height: int) -> np.ndarray:
    """255 where the nearest logit is above 0."""
    h, w = logits.shape
    near = logits[np.arange(height)[:, None] * h // height, np.arange(width)[None, :] * w // width]
    return np.where(near > 0, 255, 0).astype(np.uint8)


def overlay(image: np.ndarray, mask: np.ndarray, color: tuple[int, int, int]) -> np.ndarray:
    """RGBA with the colour half over the masked pixels; alpha stays."""
    out = image.copy()
    on = mask > 0
    out[on, :3] = ((image[on, :3].astype(np.uint16) + np.array(color, np.uint16)) // 2).astype(np.uint8)
    return out


def transposed(x: np.ndarray) -> np.ndarray:
    if x.ndim != 2:
        raise ValueError("only matrices are transposed")
    return np.ascontiguousarray(x.T)


def decoded(images: DataFrame) -> DataFrame:
    """(key, height, width, pixels, error) of rows (key, png): RGB as segment() takes it. What can't be read has an error instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, png in zip(frame["key"], frame["png"], strict=True):
                try:
                    x = read_png(png or b"")
                    x = x[:, :, :3] if x.shape[2] > 2 else np.repeat(x[:, :, :1], 3, axis=2)
                    rows.append((key, x.shape[0], x.shape[1], np.ascontiguousarray(x).tobytes(), None))
                except ValueError as e:
                    rows.append((key, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "height", "width", "pixels", "error"]).astype({"height": "Int32", "width": "Int32"})

    return images.select("key", "png").mapInPandas(run, "key long, height int, width int, pixels binary, error string")


def saved(masks: DataFrame) -> DataFrame:
    """(key, place, iou_score, png) of segment()'s rows: each mask as a grey PNG, in their order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(png=[write_png(np.frombuffer(m, np.uint8).reshape(h, w)) for m, h, w in zip(frame["mask"], frame["height"], frame["width"], strict=True)])[["key", "place", "iou_score", "png"]]

    each = masks.select("key", "width", "height", F.posexplode("masks").alias("place", "m")).select("key", "place", "m.iou_score", "m.mask", "width", "height")
    return each.mapInPandas(run, "key long, place int, iou_score double, png binary")


def segment(images: DataFrame, network: Callable, size: int = 1024, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> DataFrame:
    """(key, masks: array<struct<mask, iou_score>>, width, height) of rows (key, height, width, pixels, points, boxes).

    network(pixels, points, labels) gives logits (n, h, w) and scores (n). Best score first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                pixels = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                points, labels = prompt_points([tuple(p) for p in r.points], [tuple(b) for b in r.boxes])
                scale = np.array([size / r.width, size / r.height], np.float32)
                logits, scores = network(preprocess(pixels, size, size, list(mean), list(std)), points * scale, labels)
                order = np.argsort(-np.asarray(scores), kind="stable")
                rows.append((r.key, [{"mask": mask_of(logits[i], r.width, r.height).tobytes(), "iou_score": float(scores[i])} for i in order], r.width, r.height))
            yield pd.DataFrame(rows, columns=["key", "masks", "width", "height"])

    return images.select("key", "height", "width", "pixels", "points", "boxes").mapInPandas(run, "key long, masks array<struct<mask:binary,iou_score:double>>, width int, height int")
