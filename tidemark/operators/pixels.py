"""Signatures of raw frames: small grey pictures that tell whether a frame has changed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Luma of blue, green and red.
_LUMA = (0.114, 0.587, 0.299)


@lru_cache(maxsize=64)
def area_weights(n: int, cells: int) -> np.ndarray:
    """cells x n: the share of each of n pixels in the mean of each of the cells that cut them evenly."""
    edges = np.arange(cells + 1) * (n / cells)
    overlap = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(overlap, 0) * (cells / n)


def signature_of(pixels: bytes, width: int, height: int, cells: tuple[int, int] = (48, 24)) -> list[float]:
    """The area-averaged grey picture of cells (columns, rows) of a frame of 3 bytes a pixel (blue, green, red), row by row; ValueError for another number of bytes."""
    wanted = 3 * width * height
    if len(pixels) != wanted or not wanted:
        raise ValueError(f"incomplete frame: {len(pixels)}/{wanted} bytes")
    image = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3)
    grey = np.rint(image @ np.array(_LUMA))
    return np.rint(area_weights(height, cells[1]) @ grey @ area_weights(width, cells[0]).T).ravel().tolist()


def signatures(frames: DataFrame, *, cells: tuple[int, int] = (48, 24), pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """frames without their pixels, with ok, error and signature: array<double>; a frame of too few or too many bytes has an error and no signature.

    The kernel runs on Arrow batches; only signatures leave it, so a shuffle for the differences moves about a kilobyte a frame.
    """

    @F.pandas_udf("struct<error: string, signature: array<double>>")
    def kernel(data: pd.Series, wide: pd.Series, high: pd.Series) -> pd.DataFrame:
        out = []
        for raw, w, h in zip(data, wide, high, strict=True):
            try:
                if raw is None or pd.isna(w) or pd.isna(h):
                    raise ValueError("no frame")
                out.append((None, signature_of(raw, int(w), int(h), cells)))
            except ValueError as e:
                out.append((str(e), None))
        return pd.DataFrame(out, columns=["error", "signature"])

    kept = [c for c in frames.columns if c != pixels]
    done = frames.withColumn("_s", kernel(pixels, width, height))
    return done.select(*kept, F.col("_s.error").isNull().alias("ok"), F.col("_s.error").alias("error"), F.col("_s.signature").alias("signature"))
