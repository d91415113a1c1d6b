"""Invented pictures for the tables, which hold none: one for each page, with edited copies of known kinds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 96
POSTER, EVERY = 1_000_003, 32  # seed of the picture that pages 32 k + 5 show, each edited in its own way


@lru_cache(maxsize=8)
def falling(side: int) -> np.ndarray:
    """Strength of each frequency."""
    f = np.hypot(np.fft.fftfreq(side)[:, None], np.fft.rfftfreq(side)[None, :])
    f[0, 0] = 1
    return (f**-1.1).astype(np.float32)


def scene(seed: int, side: int = SIDE) -> np.ndarray:
    """A picture with detail of all sizes, as photographs have: noise whose strength falls with its frequency, and a few plain shapes."""
    r = np.random.default_rng(seed)
    wave = np.fft.rfft2(r.standard_normal((side, side), np.float32)) * falling(side)
    img = np.fft.irfft2(wave, (side, side))
    img = 120 + img * (38 / img.std())
    for top, left, high, wide, grey in r.integers((0, 0, 8, 8, 20), (side, side, 28, 28, 230), (4, 5)).tolist():
        img[top : top + high, left : left + wide] = 0.5 * img[top : top + high, left : left + wide] + 0.5 * grey
    return np.clip(img, 0, 255).astype(np.uint8)


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling between cell centres."""
    out = img.astype(np.float32)
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * out.shape[axis] / n - 0.5, 0, out.shape[axis] - 1)
        low = np.minimum(at.astype(int), out.shape[axis] - 2)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1)).astype(np.float32)
        out = out.take(low, axis) * (1 - part) + out.take(low + 1, axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def edited(img: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A copy: 0 cropped to two thirds of its sides, 1 brightened with new grain, 2 turned by a quarter, 3 at three quarters of its size, 4 cropped, turned and brightened."""
    r = np.random.default_rng(seed)
    h, w = img.shape
    if kind in (0, 4):
        high, wide = (2 * h + 2) // 3, (2 * w + 2) // 3
        top, left = int(r.integers(0, h - high + 1)), int(r.integers(0, w - wide + 1))
        img = img[top : top + high, left : left + wide]
    if kind in (2, 4):
        img = np.rot90(img, int(r.integers(1, 4)))
    if kind == 3:
        img = resized(img, 3 * h // 4, 3 * w // 4)
    if kind in (1, 4):
        img = np.clip(img * 0.88 + 14 + r.integers(-2, 3, img.shape), 0, 255)
    return np.ascontiguousarray(img, np.uint8)


def picture(page: int) -> np.ndarray:
    """The picture of a page. Pages 8 k + 3 show an edited copy of that of the page before, pages 32 k + 5 of one poster."""
    if page % EVERY == 5:
        return edited(scene(POSTER), page // EVERY % 5, page)
    if page % 8 == 3:
        return edited(scene(page - 1), page // 8 % 5, page)
    return scene(page)


def page_pictures(pages: DataFrame) -> DataFrame:
    """A picture for each page: (image_id, width, height, nChannels, data)."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                made = [picture(page) for page in ids]
                arrays = [pa.array(ids, pa.int64()), *[pa.array([m.shape[k] for m in made], pa.int32()) for k in (1, 0)], pa.array([1] * len(ids), pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["image_id", "width", "height", "nChannels", "data"])

    return pages.select("page_id").where("page_id is not null").mapInArrow(run, "image_id bigint, width int, height int, nChannels int, data binary")
