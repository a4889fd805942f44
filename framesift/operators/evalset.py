"""Ground truth made from good photographs: each as it is, defocused, under- and overexposed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schema as S
from ..functions import png
from ..sources.files import put

BLUR_RADIUS, UNDER, OVER = 14, 0.13, 3.2


def blurred(p: np.ndarray, radius: float = BLUR_RADIUS) -> np.ndarray:
    """A Gaussian blur, rows then columns, with the edges repeated."""
    n = int(3 * radius)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    k /= k.sum()
    out = p.astype(np.float32)
    for axis in (0, 1):
        wide = np.pad(out, [(n, n) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        out = sum(w * np.take(wide, range(i, i + p.shape[axis]), axis=axis) for i, w in enumerate(k.astype(np.float32)))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def variant(p: np.ndarray, kind: str) -> np.ndarray:
    if kind == "defocus":
        return blurred(p)
    factor = {"original": 1.0, "underexposed": UNDER, "overexposed": OVER}[kind]
    return np.clip(np.rint(p * factor), 0, 255).astype(np.uint8)


def variants(images: DataFrame) -> DataFrame:
    """Four rows for each decoded picture: path with ``__kind`` before its suffix, kind, and the changed pixels. Only data is made; no file is written."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, h, w, c, data in zip(*(x.to_pylist() for x in b.columns)):
                p = np.frombuffer(data, np.uint8).reshape(h, w, c)
                stem, dot, suffix = path.rpartition(".")
                for kind in S.VARIANTS:
                    row = (f"{stem}__{kind}{dot}{suffix}", kind, h, w, c, variant(p, kind).tobytes())
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["path", "kind", "height", "width", "channels", "data"])

    return images.where("height > 0").select("path", "height", "width", "channels", "data").mapInArrow(of, "path string, kind string, height int, width int, channels int, data binary")


def write(images: DataFrame, folder: str) -> DataFrame:
    """(filename, kind) of the variants of each picture, written as PNG files to ``folder``, which the executors have mounted: a set whose right decisions are known.

    Files are named ``<stem>__<kind>.png``; a task that runs twice writes the same again. Writing happens as the result is read.
    """
    folder = folder.removeprefix("file:").rstrip("/")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for k in range(b.num_rows):
                path, kind, h, w, c, data = (x[k].as_py() for x in b.columns)
                name = f"{os.path.splitext(os.path.basename(path))[0]}.png"
                put(f"{folder}/{name}", png.encode(np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c))))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([kind], pa.string())], ["filename", "kind"])

    return variants(images).mapInArrow(of, "filename string, kind string")
