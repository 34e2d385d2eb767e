"""Page images: sizes, PNG in and out, resampling and the four views, in numpy.

Pixels are arrays of rows, columns and channels. The header checks run before any
pixel is decoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_EDGE = 2048
MIN_SIDE, MAX_SIDE = 640, 1600


def png_size(content: Column) -> Column:
    """Struct (width, height) from a PNG's header, null if it isn't one."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def within_ceiling(size: Column, max_pixels: int) -> Column:
    return size.width * size.height <= max_pixels


def capped(size: Column, edge: int = LONG_EDGE) -> Column:
    """The size with its long edge cut to ``edge``, fractions dropped."""
    long = F.greatest(size.width, size.height)
    cut = lambda n: F.greatest(F.lit(1), F.floor(n * (edge / long))).cast("long")
    return F.when(long <= edge, size).otherwise(F.struct(cut(size.width).alias("width"), cut(size.height).alias("height")))


def fitted(size: Column, min_side: int = MIN_SIDE, max_side: int = MAX_SIDE) -> Column:
    """The size scaled so that its long side lies within the two bounds, rounded half to even."""
    long = F.greatest(size.width, size.height)
    f = F.when(long > max_side, max_side / long).when(long < min_side, min_side / long).otherwise(1.0)
    scale = lambda n: F.greatest(F.lit(1), F.rint(n * f)).cast("long")
    return F.struct(scale(size.width).alias("width"), scale(size.height).alias("height"))


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG without interlacing: 8 or 16 bits, any color type."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, palette, trns = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trns = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            idat += body
    if interlace or bits not in (1, 2, 4, 8, 16):
        raise ValueError("unsupported PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = max(1, channels * bits // 8)
    stride = (width * channels * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    if bits == 16:
        px = out.reshape(height, width, channels, 2)
        return (px[..., 0].astype(np.uint16) << 8) | px[..., 1]
    if bits < 8:
        px = np.unpackbits(out, axis=1).reshape(height, -1, bits)
        px = px.dot(1 << np.arange(bits)[::-1])[:, :width].astype(np.uint8)[..., None]
        px = px if color == 3 else px * (255 // ((1 << bits) - 1))
    else:
        px = out.reshape(height, width, channels)
    if color == 3:
        index = px[..., 0]
        px = palette[index]
        if trns is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(trns)] = trns
            px = np.dstack([px, alpha[index]])
    return px


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    out = np.zeros(len(row) + step, np.int32)
    up = np.concatenate([np.zeros(step, np.int32), above.astype(np.int32)])
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 1:
            p = a
        elif kind == 3:
            p = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (int(row[i - step]) + p) & 255
    return out[step:].astype(np.uint8)


def encode_png(px: np.ndarray) -> bytes:
    """A lossless PNG of 8-bit gray, RGB or RGBA pixels."""
    px = px[..., None] if px.ndim == 2 else px
    height, width, channels = px.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), px.reshape(height, -1)])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def to_rgb(px: np.ndarray) -> np.ndarray:
    """8-bit RGB: wider pixels are stretched between their least and greatest, alpha is laid over white."""
    if px.dtype != np.uint8:
        x = px.astype(np.float64)
        low, high = x.min(), x.max()
        px = np.zeros(px.shape, np.uint8) if high <= low else ((x - low) * (255.0 / (high - low))).astype(np.uint8)
    px = px[..., None] if px.ndim == 2 else px
    if px.shape[2] in (2, 4):
        alpha = px[..., -1:].astype(np.float64) / 255
        px = np.rint(px[..., :-1] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px


def _axis(n: int, m: int) -> np.ndarray:
    """The weights (m, n) of a windowed-sinc resampling of n samples to m."""
    scale = max(1.0, n / m)
    at = (np.arange(m) + 0.5) * n / m - 0.5
    x = (np.arange(n)[None, :] - at[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    if (px.shape[1], px.shape[0]) == (width, height):
        return px
    x = np.tensordot(_axis(px.shape[0], height), px.astype(np.float64), axes=(1, 0))
    x = np.einsum("wn,hnc->hwc", _axis(px.shape[1], width), x)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def crop(px: np.ndarray, box: tuple[float, float, float, float], padding: float = 0.01) -> np.ndarray:
    """The part of a page in a box of shares, with padding, within the page."""
    h, w = px.shape[:2]
    x0, y0, x1, y1 = box
    cut = lambda v, n: int(min(max(v, 0.0), 1.0) * n)
    return px[cut(y0 - padding, h) : max(cut(y1 + padding, h), cut(y0 - padding, h) + 1), cut(x0 - padding, w) : max(cut(x1 + padding, w), cut(x0 - padding, w) + 1)]


def _around(px: np.ndarray) -> np.ndarray:
    """The nine shifted copies of an image, edges repeated."""
    p = np.pad(px, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return np.stack([p[i : i + px.shape[0], j : j + px.shape[1]] for i in range(3) for j in range(3)])


def sharpen(px: np.ndarray, amount: float = 1.0) -> np.ndarray:
    x = px.astype(np.float64)
    return np.clip(x + amount * (x - _around(px).mean(axis=0)), 0, 255).astype(np.uint8)


def contrast(px: np.ndarray, cutoff: float = 1.0, gamma: float = 0.85) -> np.ndarray:
    """Each channel stretched between its cutoff percentiles, then gamma, then sharpened."""
    low, high = np.percentile(px, (cutoff, 100 - cutoff), axis=(0, 1))
    x = np.clip((px - low) / np.maximum(high - low, 1e-9), 0, 1)
    return sharpen((255 * x**gamma).astype(np.uint8))


def denoised(px: np.ndarray) -> np.ndarray:
    return sharpen(np.median(_around(px), axis=0).astype(np.uint8))


def equalized(px: np.ndarray) -> np.ndarray:
    """Gray by luma, its histogram made even."""
    gray = np.rint(px @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    cdf = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    first = cdf[gray.min()]
    table = np.clip(np.rint((cdf - first) * 255.0 / max(1, gray.size - first)), 0, 255).astype(np.uint8)
    return to_rgb(table[gray])


_VIEWS = {"original": lambda px: px, "contrast": contrast, "denoised": denoised, "equalized": equalized}


@F.pandas_udf(T.BinaryType())
def view_png(content: pd.Series, view: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The PNG of one view of a PNG page at a size; null for what can't be decoded."""

    def one(data, name, w, h):
        try:
            return encode_png(_VIEWS[name](resize(to_rgb(decode_png(data)), int(w), int(h))))
        except (ValueError, KeyError, TypeError, struct.error, zlib.error, UnboundLocalError):
            return None

    return pd.Series([one(*x) for x in zip(content, view, width, height, strict=True)])


def nearest_aspect(images, known, tolerance: float = 0.03):
    """The known image (known_id, width, height) whose aspect ratio, of two places, is nearest within the tolerance.

    Both sides meet on the ratio in steps of the tolerance, and those beside it.
    """
    ratio = lambda w, h: F.round(F.col(w) / F.col(h), 2)
    step = lambda r: F.floor(r / tolerance).cast("long")
    i = images.select("image_id", ratio("width", "height").alias("r"))
    k = known.select("known_id", ratio("width", "height").alias("kr"))
    k = k.withColumn("cell", F.explode(F.array(step(F.col("kr")) - 1, step(F.col("kr")), step(F.col("kr")) + 1)))
    j = i.withColumn("cell", step(F.col("r"))).join(k, "cell").where(F.abs(F.col("r") - F.col("kr")) <= tolerance + 1e-9)
    return j.groupBy("image_id").agg(F.min_by("known_id", F.struct(F.abs(F.col("r") - F.col("kr")), F.col("known_id"))).alias("known_id"))
