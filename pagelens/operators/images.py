"""Landed screenshots and brand images: grey values, the small grid that hashes are made of, and codes in them.

A screenshot is (width, height, channels, pixels): rows of 8-bit values, 1 channel for grey, 2 for grey and alpha, 3 for
colour, 4 for colour and alpha. One that is null, has no pixels or not as many as it says is unusable: null, or no codes."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .landed import difference_hash
from .symbols import read_codes

GRID = (9, 8)
#: The parts of colours in grey, of 2**16; how far the kernel reaches; bits of its weights.
GREY = (19595, 38470, 7471)
REACH, BITS = 3.0, 22


def grey_of(width: int, height: int, channels: int, pixels: bytes) -> np.ndarray | None:
    if None in (width, height, channels, pixels) or min(width, height) < 1 or channels not in (1, 2, 3, 4) or len(pixels) != width * height * channels:
        return None
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return x[:, :, 0]
    return ((x[:, :, :3].astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


@lru_cache(maxsize=4096)
def weights(size: int, wanted: int) -> tuple[tuple[int, np.ndarray], ...]:
    """For each of the wanted places along a side of that size: the first value that counts, and whole weights of those from it on."""
    scale = size / wanted
    wide = max(1.0, scale)
    out = []
    for i in range(wanted):
        centre = (i + 0.5) * scale
        first, stop = max(0, int(centre - REACH * wide + 0.5)), min(size, int(centre + REACH * wide + 0.5))
        x = (np.arange(first, stop) - centre + 0.5) / wide
        w = np.where(np.abs(x) < REACH, np.sinc(x) * np.sinc(x / REACH), 0)
        w = w / w.sum() * (1 << BITS)
        out.append((first, np.where(w < 0, w - 0.5, w + 0.5).astype(np.int64)))
    return tuple(out)


def shrunk(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled with a three-lobed windowed sinc, wider where it shrinks; along rows, then along columns, rounded after each."""
    for size, axis in ((width, 1), (height, 0)):
        if grey.shape[axis] == size:
            continue
        lines = grey if axis == 1 else grey.T
        sums = [(lines[:, first : first + len(w)].astype(np.int64) @ w + (1 << BITS - 1)) >> BITS for first, w in weights(lines.shape[1], size)]
        lines = np.clip(np.column_stack(sums), 0, 255).astype(np.uint8)
        grey = lines if axis == 1 else lines.T
    return grey


def _each(image: pa.Array):
    for one in image.to_pylist():
        yield grey_of(*(one[c] for c in ("width", "height", "channels", "pixels"))) if one else None


def _grids(image: pa.Array) -> pa.Array:
    return pa.array([None if g is None else shrunk(g, *GRID).ravel().tolist() for g in _each(image)], pa.list_(pa.int32()))


def _texts(image: pa.Array) -> pa.Array:
    return pa.array([[] if g is None else read_codes(g) for g in _each(image)], pa.list_(pa.string()))


def _image() -> Column:
    return F.struct("width", "height", "channels", "pixels")


def hashed(shots: DataFrame) -> DataFrame:
    """shots (with width, height, channels, pixels) with hash: that of their grid of 9 by 8 grey values."""
    df = shots.withColumn("grid", F.arrow_udf(_grids, "array<int>")(_image()))
    return df.withColumn("hash", F.when(F.col("grid").isNotNull(), difference_hash("grid"))).drop("grid")


def decoded(shots: DataFrame) -> DataFrame:
    """(scan_id, code_type, payload) of the codes in shots (scan_id, width, height, channels, pixels), one row for each."""
    texts = F.arrow_udf(_texts, "array<string>")(_image())
    return shots.select("scan_id", F.lit("QRCODE").alias("code_type"), F.explode(texts).alias("payload"))


def png_pixels(content: bytes | None) -> dict | None:
    """(width, height, channels, pixels) of a PNG of 8 bits that isn't interlaced; None for others and for what is damaged."""
    if not content or content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, head, palette = 8, b"", None, b""
    while at + 8 <= len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        part = content[at + 8 : at + 8 + n]
        if len(part) < n:
            break
        head = part if kind == b"IHDR" else head
        palette = part if kind == b"PLTE" else palette
        data += part if kind == b"IDAT" else b""
        at += 12 + n
    if head is None or len(head) != 13 or head[8] != 8 or head[12] != 0 or head[9] not in (0, 2, 3, 4, 6):
        return None
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    try:
        raw = zlib.decompress(data)
    except zlib.error:
        return None
    line = width * channels
    if min(width, height) < 1 or len(raw) != height * (line + 1):
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        out[y + 1] = _unfiltered(rows[y, 0], rows[y, 1:], out[y], channels)
    x = out[1:]
    if head[9] == 3:
        colours = np.zeros((256, 3), np.uint8)
        colours[: len(palette) // 3] = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        x, channels = colours[x], 3
    return {"width": width, "height": height, "channels": channels, "pixels": x.tobytes()}


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of pixels of what was stored: differences to the left, above, or to what both predict."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up, said = [0] * step, [0] * step + above.tolist(), line.tolist()
    for i, v in enumerate(said):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v + guess) & 255)
    return np.array(out[step:], np.uint8)


def reference_hashes(images: DataFrame) -> DataFrame:
    """(brand, hash) of brand images (brand, content), for visual_matches; images that can't be read are left out."""
    kind = "struct<width:int,height:int,channels:int,pixels:binary>"
    arrow = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])

    def run(contents: pa.Array) -> pa.Array:
        return pa.array([png_pixels(c) for c in contents.to_pylist()], arrow)

    read = images.select("brand", F.arrow_udf(run, kind)("content").alias("i")).select("brand", "i.*")
    return hashed(read).where("hash is not null").select("brand", "hash")
