"""Pixel kernels over packed images; numpy inside Arrow batches, one image a row.

An image is a row (w, h, data) with 8-bit RGB bytes. Scaling is bilinear.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "w int, h int, data binary"


def luminance(image: np.ndarray) -> np.ndarray:
    """0.299 r + 0.587 g + 0.114 b, summed in this order."""
    r, g, b = (image[..., i].astype(np.float64) for i in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance in all three channels, rounded half to even as clamped bytes are."""
    lum = np.rint(luminance(image))
    return np.repeat(np.clip(lum, 0, 255).astype(np.uint8)[..., None], 3, axis=2)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[max(0, y) : y + h, max(0, x) : x + w]


def scale(image: np.ndarray, factor: float) -> np.ndarray:
    h, w = image.shape[:2]
    nh, nw = max(1, int(h * factor + 0.5)), max(1, int(w * factor + 0.5))
    ys, xs = (np.clip((np.arange(n) + 0.5) / f - 0.5, 0, m - 1) for n, f, m in ((nh, nh / h, h), (nw, nw / w, w)))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def pad(image: np.ndarray, margin: int) -> np.ndarray:
    """A margin in the mean colour of the border, whose corners count twice."""
    edge = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]]).astype(np.float64)
    colour = np.floor(edge.mean(axis=0) + 0.5).astype(np.uint8)
    out = np.empty((image.shape[0] + 2 * margin, image.shape[1] + 2 * margin, 3), np.uint8)
    out[:] = colour
    out[margin:-margin or None, margin:-margin or None] = image
    return out


def otsu(lum: np.ndarray, default: int = 127) -> int:
    n = np.bincount(lum.ravel(), minlength=256).astype(np.float64)
    back, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    front = back[-1] - back
    with np.errstate(divide="ignore", invalid="ignore"):
        between = back * front * (sums / back - (sums[-1] - sums) / front) ** 2
    between = np.where((back > 0) & (front > 0), between, 0)
    return int(between.argmax()) if between.max() > 0 else default


def binarize(image: np.ndarray, most: float = 8.4e6) -> np.ndarray:
    """Black ink on white at the Otsu threshold, doubled if that stays small; too little or too much ink leaves the image."""
    big = scale(image, 2.0) if 4 * image.shape[0] * image.shape[1] <= most else image
    lum = np.floor(luminance(big)).astype(np.int64)
    dark = lum < otsu(lum)
    ink = dark if 2 * dark.sum() <= dark.size else ~dark
    if not 0.002 <= ink.mean() <= 0.4:
        return image
    return np.repeat(np.where(ink, 0, 255).astype(np.uint8)[..., None], 3, axis=2)


def bands(profile: np.ndarray) -> tuple[int, int, int]:
    """Runs of ink in a profile: how many, the largest thickness, and the upper median of the gaps between their starts (0 without)."""
    on = np.diff(np.concatenate([[0], (profile > 0).astype(int), [0]]))
    start, end = np.nonzero(on == 1)[0], np.nonzero(on == -1)[0]
    pitch = np.sort(np.diff(start))
    return len(start), int((end - start).max(initial=0)), int(pitch[len(pitch) // 2]) if len(pitch) else 0


def orientation(image: np.ndarray) -> tuple[str, bool]:
    """horizontal or vertical, and whether that is certain, from the ink profiles of rows and columns.

    The sides decide alone if there is one line: if the side with fewer bands, rows if as many, is
    no thicker than three of the other side's pitches. Else the fill of the fullest rows and columns does.
    """
    plain = image.astype(np.float64).mean(axis=2)
    mean = plain.mean()
    ink = plain < mean - 30 if mean >= 128 else plain > mean + 30
    rows, cols = ink.sum(axis=1), ink.sum(axis=0)
    h, w = ink.shape
    (n_rows, thick_rows, pitch_rows), (n_cols, thick_cols, pitch_cols) = bands(rows), bands(cols)
    thick, pitch = (thick_rows, pitch_cols) if n_rows <= n_cols else (thick_cols, pitch_rows)
    if 0 < pitch and thick <= 3 * pitch:
        if h > 1.8 * w:
            return "vertical", True
        if w > 1.8 * h:
            return "horizontal", True
    peak = lambda profile, length: (np.sort(profile)[::-1][int(len(profile) * 0.05)] if len(profile) else 0) / length
    ratio = peak(cols, h) / (peak(rows, w) or 1e-9)
    if ratio <= 1.15:
        return "horizontal", True
    return ("vertical", True) if ratio >= 1.8 else ("vertical" if ratio > 1.5 else "horizontal", False)


def square_icon(image: np.ndarray, side: int = 64) -> np.ndarray:
    """The image fitted into a square on white."""
    fitted = scale(image, side / max(image.shape[:2]))[:side, :side]
    out = np.full((side, side, 3), 255, np.uint8)
    y, x = (side - fitted.shape[0]) // 2, (side - fitted.shape[1]) // 2
    out[y : y + fitted.shape[0], x : x + fitted.shape[1]] = fitted
    return out


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """An RGB image as PNG bytes. Each row is stored as it is, as differences to the left, or to the row above: whichever is least."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = image.shape[:2]
    flat = np.ascontiguousarray(image, np.uint8).reshape(h, w * 3)
    left = flat - np.concatenate([np.zeros((h, 3), np.uint8), flat[:, :-3]], axis=1)
    above = flat - np.concatenate([np.zeros((1, w * 3), np.uint8), flat[:-1]])
    ways = np.stack([flat, left, above])
    size = np.abs(ways.astype(np.int8).astype(np.int64)).sum(axis=2)  # small differences pack well
    best = size.argmin(axis=0)
    rows = np.concatenate([best.astype(np.uint8)[:, None], ways[best, np.arange(h)]], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def data_url_size(content: bytes, kind: str = "image/png") -> int:
    """Characters of the data URL of some bytes."""
    return len(f"data:{kind};base64,") + -(-len(content) // 3) * 4


def encode_within(image: np.ndarray, most: int, tries: int = 4) -> tuple[np.ndarray, bytes] | None:
    """The image and its PNG, scaled down until the data URL has at most `most` characters; none after `tries`.

    Each time the scale shrinks with the square root of the excess, and by 15 % more.
    """
    factor = 1.0
    for _ in range(tries):
        out = scale(image, factor) if factor < 1 else image
        content = encode_png(out)
        if data_url_size(content) <= most:
            return out, content
        factor *= (most / data_url_size(content)) ** 0.5 * 0.85
    return None


def reencoded(images: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, w, h, data: each image (w, h and data, RGB bytes) as PNG whose data URL has at most `most` characters.

    An image without data or area, or that stays too large after four tries, has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for w, h, data in zip(*(batch.column(n).to_pylist() for n in ("w", "h", "data")), strict=True):
                made = encode_within(np.frombuffer(data, np.uint8).reshape(h, w, 3), most) if data and w and h else None
                done.append((None, None, None) if made is None else (made[0].shape[1], made[0].shape[0], made[1]))
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, "w", "h", "data"])

    own = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "w", "h", "data").mapInArrow(run, f"{own}, {IMAGE}")


def apply(images: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys and the image that kernel makes of each; a row without data or area keeps null data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for w, h, data in zip(*(batch.column(n).to_pylist() for n in ("w", "h", "data")), strict=True):
                made = kernel(np.frombuffer(data, np.uint8).reshape(h, w, 3)) if data and w and h else None
                done.append((None, None, None) if made is None else (made.shape[1], made.shape[0], made.tobytes()))
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, "w", "h", "data"])

    own = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "w", "h", "data").mapInArrow(run, f"{own}, {IMAGE}")


def byte_sums(images: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, w and the sum of the bytes of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [None if d is None else int(np.frombuffer(d, np.uint8).sum(dtype=np.int64)) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "w")), pa.array(total, pa.int64())], names=[*keys, "w", name])

    own = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "w", "data").mapInArrow(run, f"{own}, w int, {name} bigint")


def pack(pixels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Images of bounded size from pixel rows (x, y, r, g, b); missing pixels are white.

    A pixel is at most width x height entries of its image, so a group is bounded by the picture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, made = batch.column("cells"), []
            flat = cells.flatten()
            at, colour = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            bounds = np.asarray(cells.offsets) - cells.offsets[0].as_py()
            for first, last in zip(bounds, bounds[1:], strict=False):
                image = np.full((width * height, 3), 255, np.uint8)
                rgb = colour[first:last]
                image[at[first:last]] = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=1)
                made.append(image.tobytes())
            n = len(made)
            columns = [pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, "w", "h", "data"])

    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("i"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("c"))
    sparse = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    own = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return sparse.mapInArrow(run, f"{own}, {IMAGE}")
