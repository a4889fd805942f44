"""What a model or a reader is shown of a photograph: a fitted overview, a crop at full size, a thumbnail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import png
from .measure import fitted

OVERVIEW_EDGE, CROP_EDGE, THUMB_EDGE = 1280, 768, 360


def crop_box(height: Column, width: Column, size: int = CROP_EDGE) -> Column:
    """(top, left, size) of the middle square; null unless both edges are longer than ``size``."""
    half = lambda n: F.floor((n - size) / 2).cast("int")
    return F.when((height > size) & (width > size), F.struct(half(height).alias("top"), half(width).alias("left"), F.lit(size).alias("size")))


def centre(pixels: np.ndarray, size: int = CROP_EDGE) -> np.ndarray | None:
    h, w = pixels.shape[:2]
    if min(h, w) <= size:
        return None
    top, left = (h - size) // 2, (w - size) // 2
    return pixels[top : top + size, left : left + size]


def fit(pixels: np.ndarray, edge: int) -> np.ndarray:
    """The pixels with their long edge at most ``edge``; never enlarged."""
    if max(pixels.shape[:2]) <= edge:
        return pixels
    one = lambda x: np.rint(fitted(x, edge)).astype(np.uint8)
    return one(pixels) if pixels.ndim == 2 else np.stack([one(pixels[..., i]) for i in range(pixels.shape[2])], axis=-1)


def shown(pixels: np.ndarray, crop: bool = True) -> list[bytes]:
    """PNG files of the overview and, where the picture is large enough, of its middle at full size."""
    detail = centre(pixels) if crop else None
    return [png.encode(fit(pixels, OVERVIEW_EDGE))] + ([] if detail is None else [png.encode(detail)])


def rows(images: DataFrame, of, out: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """images (path, height, width, channels, data) with the pixels replaced by ``of(pixels)`` as column ``out``; null where there are none. One picture at a time."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, h, w, c, data = (x[k].as_py() for x in b.columns)
                ok = bool(data) and bool(h) and bool(w) and len(data) == h * w * c
                p = np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c)) if ok else None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([None if p is None else of(p)], arrow)], ["path", out])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(step, f"path string, {out} {kind}")


def views(images: DataFrame, crop: bool = True) -> DataFrame:
    """path and views, the files that a model is sent for each picture."""
    return rows(images, lambda p: shown(p, crop), "views", "array<binary>", pa.list_(pa.binary()))


def thumbnails(images: DataFrame, edge: int = THUMB_EDGE) -> DataFrame:
    """path and thumb, a small PNG of each picture."""
    return rows(images, lambda p: png.encode(fit(p, edge)), "thumb", "binary", pa.binary())
