"""Pixel measurements, batch by batch in numpy: sharpness, exposure and a perceptual hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from .triage import exposure_category, sharpness_score

HASH_EDGE, HASH_LOW = 32, 8
#: Bytes of pictures of one size that are measured together, each taken for as large as its hash's at least; a larger picture is measured alone.
STACK = 1 << 20
_COLUMNS = "peak_tile_var double, global_var double, blown_fraction double, crushed_fraction double, mean_level double, contrast double, phash_hi long, phash_lo long"


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey levels of BGR, BGRA or grey pixels, as unsigned bytes; a stack of pictures has its number first."""
    if pixels.ndim == 2 or pixels.shape[-1] == 1:
        return pixels if pixels.ndim == 2 else pixels[..., 0]
    b, g, r = (pixels[..., i].astype(np.float32) for i in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def _block_sums(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Sums of the blocks that begin at these rows and columns, of a picture or of each of a stack."""
    return np.add.reduceat(np.add.reduceat(x, ys, axis=-2), xs, axis=-1)


def shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the blocks that a smaller picture's pixels cover."""
    h, w = grey.shape[-2:]
    ys, xs = np.arange(height) * h // height, np.arange(width) * w // width
    return _block_sums(grey.astype(np.float64), ys, xs) / (np.diff(ys, append=h)[:, None] * np.diff(xs, append=w)[None, :])


def fitted(grey: np.ndarray, edge: int) -> np.ndarray:
    """The picture, or each of a stack, with its long edge at most ``edge``."""
    long = max(grey.shape[-2:])
    if long <= edge:
        return grey.astype(np.float64)
    return shrink(grey, *(max(1, round(n * edge / long)) for n in grey.shape[-2:]))


def _tile_variances(grey: np.ndarray, tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """For a stack: the variances of each picture's tiles, a row a picture, and of each whole."""
    h, w = grey.shape[-2:]
    p = np.pad(grey, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(h, w) > 1 else "edge")
    lap = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * grey
    ys, xs = (np.arange(tiles) * (n // tiles) if n >= tiles else np.zeros(1, int) for n in (h, w))
    hs, ws = np.diff(ys, append=h), np.diff(xs, append=w)
    size = hs[:, None] * ws[None, :]
    off = lap - np.repeat(np.repeat(_block_sums(lap, ys, xs) / size, hs, axis=1), ws, axis=2)
    return (_block_sums(off * off, ys, xs) / size).reshape(len(lap), -1), lap.reshape(len(lap), -1).var(axis=1)


def tile_variances(grey: np.ndarray, tiles: int = S.TILES) -> tuple[list[float], float]:
    """Variances of the second derivative in a grid of tiles, the last of which take the remainder, and over the whole."""
    parts, whole = _tile_variances(grey[None], tiles)
    return parts[0].tolist(), float(whole[0])


def _hashes(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = grey.shape[-2:]
    if min(h, w) >= HASH_EDGE:
        small = shrink(grey, HASH_EDGE, HASH_EDGE)
    else:
        ys, xs = (np.arange(HASH_EDGE) * n // HASH_EDGE for n in (h, w))
        small = grey[:, ys[:, None], xs].astype(np.float64)
    k = np.arange(HASH_EDGE)
    basis = np.cos(np.pi * np.outer(np.arange(HASH_LOW), 2 * k + 1) / (2 * HASH_EDGE))
    low = (basis @ small @ basis.T).reshape(len(small), -1)
    halves = np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1).view(">u4").astype(np.int64)
    return halves[:, 0], halves[:, 1]


def perceptual_hash(grey: np.ndarray) -> tuple[int, int]:
    """Two halves of 64 bits: which of the 8 x 8 lowest cosine coefficients of a 32 x 32 picture lie over their median."""
    high, low = _hashes(grey[None])
    return int(high[0]), int(low[0])


def measured_stack(pixels: np.ndarray) -> list[np.ndarray]:
    """The measurements of pictures of one size, (number, height, width, channels): an array for each column."""
    grey = luma(pixels)
    tiles, whole = _tile_variances(fitted(grey, S.SHARP_EDGE), S.TILES)
    peak = np.sort(tiles, axis=1)[:, -S.TOP_TILES :].mean(axis=1)
    light = fitted(grey, S.EXPOSURE_EDGE).reshape(len(grey), -1)
    return [peak, whole, (light >= S.HIGHLIGHT).mean(axis=1), (light <= S.SHADOW).mean(axis=1), light.mean(axis=1) / 255, light.std(axis=1) / 255, *_hashes(grey)]


def measured(pixels: np.ndarray) -> tuple:
    """The measurements of one picture."""
    return tuple(x[0].item() for x in measured_stack((pixels[..., None] if pixels.ndim == 2 else pixels)[None]))


def _whole(b: pa.RecordBatch) -> dict[tuple[int, int, int], list[int]]:
    """Size to the rows of a batch that hold a picture of it."""
    h, w, c, n = (x.to_pylist() for x in (*(b.column(k) for k in ("height", "width", "channels")), pc.binary_length(b.column("data"))))
    out = {}
    for i, size in enumerate(zip(h, w, c)):
        if n[i] and all(size) and n[i] == size[0] * size[1] * size[2]:
            out.setdefault(size, []).append(i)
    return out


def _measured_batch(b: pa.RecordBatch) -> list[pa.Array]:
    cols, known = [np.zeros(b.num_rows, t) for t in [np.float64] * 6 + [np.int64] * 2], np.zeros(b.num_rows, bool)
    data = b.column("data")
    for size, rows in _whole(b).items():
        step = max(1, STACK // max(size[0] * size[1] * size[2], HASH_EDGE * HASH_EDGE))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            # views of Arrow's buffers: a batch of large pictures would be gigabytes as Python objects
            stack = [np.frombuffer(data[i].as_buffer(), np.uint8) for i in at]
            pixels = (stack[0] if len(at) == 1 else np.concatenate(stack)).reshape(len(at), *size)
            for col, x in zip(cols, measured_stack(pixels)):
                col[at] = x
            known[at] = True
    return [pa.array(x, mask=~known) for x in cols]


def measure(images: DataFrame) -> DataFrame:
    """Adds to (path, height, width, channels, data: BGR bytes) the measurements, cv_sharpness and exposure; no pixels go on.

    A picture that could not be decoded (data null or empty) has null measurements and good exposure, as the decision expects.
    """
    rest = [f for f in images.schema.fields if f.name not in ("height", "width", "channels", "data")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in rest] + _measured_batch(b), [f.name for f in rest] + [x.split()[0] for x in _COLUMNS.split(", ")])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [_COLUMNS])
    df = images.mapInArrow(of, schema)
    return df.withColumns({"cv_sharpness": F.when(F.col("peak_tile_var").isNotNull(), sharpness_score(F.col("peak_tile_var"))),
                           "exposure": exposure_category(F.col("blown_fraction"), F.col("crushed_fraction"), F.col("mean_level")), "exposure_available": F.col("mean_level").isNotNull()})
