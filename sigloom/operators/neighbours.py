"""Causal neighbourhoods: one window per image row order, or NumPy kernels over whole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(pixels: DataFrame, key: str = "vec_id", width: int = 8, border: int = 128) -> DataFrame:
    """pixels (key, p, y, x, v) with left, above, ul, ur, left2, above2; what lies outside is `border`.

    One exchange: all six shifts share the window of the key, ordered by position.
    """
    w = Window.partitionBy(key).orderBy("p")
    at = lambda n, there: F.when(there, F.lag("v", n).over(w)).otherwise(F.lit(border))
    x, y = F.col("x"), F.col("y")
    return pixels.withColumns(
        {
            "left": at(1, x > 0), "above": at(width, y > 0), "ul": at(width + 1, (x > 0) & (y > 0)), "ur": at(width - 1, (y > 0) & (x < width - 1)),
            "left2": at(2, x > 1), "above2": at(2 * width, y > 1),
        }
    )


def map_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, side: int = 8) -> DataFrame:
    """Apply a NumPy kernel (ids, blocks as n x side x side) to batches of blocks (vec_id, vec): no exchange, Arrow in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                out = kernel(batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(-1, side, side))
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    return blocks.select("vec_id", "vec").mapInArrow(run, schema)


def shifted(v: np.ndarray, dy: int, dx: int, border: int) -> np.ndarray:
    """Planes moved down by dy and right by dx, filled with border."""
    out = np.full_like(v, border)
    h, w = v.shape[1:]
    out[:, dy:, max(0, dx) : w + min(0, dx)] = v[:, : h - dy, max(0, -dx) : w - max(0, dx)]
    return out


def block_predictions(v: np.ndarray, border: int = 128) -> list[np.ndarray]:
    """The nine modes over n x h x w integers at once, in the order of functions.predictors.block_modes."""
    left, above, ul = (shifted(v, dy, dx, border) for dy, dx in ((0, 1), (1, 0), (1, 1)))
    left2, above2 = shifted(v, 0, 2, border), shifted(v, 2, 0, border)
    gradient = left + above - ul
    across, down = abs(above - ul), abs(left - ul)
    near = np.select([(across <= down) & (across <= abs(gradient - ul)), down <= abs(gradient - ul)], [left, above], ul)
    wl, wa = 1.0 / (down + 1), 1.0 / (across + 1)
    return [
        left, above, gradient, near, (left + above + 1) >> 1,
        np.select([across > down + 4, down > across + 4], [above, left], gradient),
        np.maximum(np.minimum(left, above), np.minimum(np.maximum(left, above), gradient)),
        np.where(abs(left - left2) < abs(above - above2), 2 * left - left2, 2 * above - above2),
        np.rint((left * wl + above * wa) / (wl + wa)).astype(v.dtype),
    ]


def haar(v: np.ndarray) -> np.ndarray:
    """One level of the orthonormal Haar transform over n x h x w, averages first."""
    s = np.sqrt(0.5)
    rows = np.concatenate([(v[:, ::2] + v[:, 1::2]) * s, (v[:, ::2] - v[:, 1::2]) * s], 1)
    return np.concatenate([(rows[:, :, ::2] + rows[:, :, 1::2]) * s, (rows[:, :, ::2] - rows[:, :, 1::2]) * s], 2)
