"""Frames as arrays: sharpness, motion, the sharpest of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sharpness(height: int, width: int):
    """A column function: population variance of the Laplacian of a frame given as an array of its rows.

    Edges are mirrored without the edge itself, and a frame of another size gives null.
    """

    @F.pandas_udf("double")
    def variance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            good = frames.map(lambda f: f is not None and len(f) == height * width)
            out = pd.Series(np.nan, index=frames.index, dtype="float64")
            if good.any():
                pixels = np.stack(frames[good].to_numpy()).reshape(-1, height, width).astype(float)
                wide = np.pad(pixels, ((0, 0), (1, 1), (1, 1)), mode="reflect")
                laplacian = wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] + wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] - 4 * pixels
                out[good] = laplacian.var(axis=(1, 2))
            yield out.where(good, None)

    return variance


def block_mean(frame: Column, height: int, width: int, factor: int) -> Column:
    """A frame scaled down by a whole factor, each pixel the mean of its block, in expressions only."""
    rows, cols = height // factor, width // factor

    def pixel(i: Column) -> Column:
        r, c = F.floor(i / cols) * factor, (i % cols) * factor
        block = F.transform(F.sequence(F.lit(0), F.lit(factor * factor - 1)), lambda k: F.get(frame, ((r + F.floor(k / factor)) * width + c + k % factor).cast("int")))
        return F.aggregate(block, F.lit(0.0), lambda a, x: a + x) / (factor * factor)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), pixel)


def sharpest(frames: DataFrame, group: str, index: str, score: str) -> DataFrame:
    """(group, index, score) of the best frame of each group; the first of equals. Frames without a score don't count."""
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score), (-F.col(index)).alias("back")))).alias("best")
    return frames.groupBy(group).agg(best).where("best IS NOT NULL").select(group, (-F.col("best.back")).alias(index), F.col(f"best.{score}").alias(score))


def motion(frames: DataFrame, clip: str, order: str, pixels: str) -> DataFrame:
    """(clip, motion): the mean over consecutive readable frames of the mean absolute difference of their pixels; 0 if
    there are no two. Unreadable frames (null) are left out first, so their neighbours meet."""
    before = F.lag(pixels).over(Window.partitionBy(clip).orderBy(order))
    pairs = frames.where(F.col(pixels).isNotNull()).withColumn("__before", before)
    change = F.aggregate(F.zip_with(pixels, "__before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    moved = pairs.where("__before IS NOT NULL").withColumn("__change", change).groupBy(clip).agg(F.avg("__change").alias("__motion"))
    return frames.select(clip).distinct().join(moved, clip, "left").select(clip, F.coalesce("__motion", F.lit(0.0)).alias("motion"))


def area_weights(size: int, parts: int) -> np.ndarray:
    """How much of each of `size` pixels lies in each of `parts` equal stretches of them, as shares of a stretch: [part, pixel]."""
    edges = np.arange(parts + 1) * (size / parts)
    inside = np.minimum(edges[1:, None], np.arange(1, size + 1)) - np.maximum(edges[:-1, None], np.arange(size))
    return np.maximum(inside, 0.0) * (parts / size)


def scaled_height(height: int, width: int, to_width: int) -> int:
    """Rows of a frame scaled to a width: rounded half to even, one at least."""
    return max(1, round(height * (to_width / width)))


def area_resized(height: int, width: int, to_height: int, to_width: int):
    """A column function: a frame, an array of its rows, at another size. A pixel is the mean of the area it covers, parts of pixels
    counted by their share, so sizes need not divide. A null frame or one of another size gives null."""
    down, across = area_weights(height, to_height), area_weights(width, to_width)

    @F.pandas_udf("array<double>")
    def resized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            good = frames.map(lambda f: f is not None and len(f) == height * width)
            out = pd.Series([None] * len(frames), index=frames.index, dtype=object)
            if good.any():
                pixels = np.stack(frames[good].to_numpy()).reshape(-1, height, width).astype(float)
                out[good] = pd.Series(list((down @ pixels @ across.T).reshape(len(pixels), -1)), index=frames.index[good], dtype=object)
            yield out

    return resized


#: Of the dense flow: the weight of smoothness against brightness (images have a spread of 1), steps of a solution, solutions of a level, and the least side of one.
SMOOTHNESS, STEPS, WARPS, LEAST_SIDE = 0.5, 40, 4, 8


def _halved(images: np.ndarray) -> np.ndarray:
    """Every other pixel of the images blurred by 1 4 6 4 1 either way."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        p = np.pad(images, pad, mode="edge")
        part = lambda i: np.take(p, np.arange(i, i + images.shape[axis], 2), axis)  # noqa: B023, E731
        images = (part(0) + 4 * part(1) + 6 * part(2) + 4 * part(3) + part(4)) / 16
    return images


def _doubled(flow: np.ndarray, height: int, width: int) -> np.ndarray:
    return 2 * flow.repeat(2, axis=1).repeat(2, axis=2)[:, :height, :width]


def _around(field: np.ndarray) -> np.ndarray:
    """The mean of the eight neighbours, those at the sides twice as heavy as those at the corners."""
    p = np.pad(field, ((0, 0), (1, 1), (1, 1)), mode="edge")
    sides = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]
    return sides / 6 + (p[:, :-2, :-2] + p[:, :-2, 2:] + p[:, 2:, :-2] + p[:, 2:, 2:]) / 12


def _moved(images: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The images seen from where each pixel has gone, between pixels by bilinear weights, at the border by its pixels."""
    n, height, width = images.shape
    y, x = np.clip(np.arange(height)[None, :, None] + v, 0, height - 1), np.clip(np.arange(width)[None, None, :] + u, 0, width - 1)
    top, left = np.minimum(y.astype(int), max(height - 2, 0)), np.minimum(x.astype(int), max(width - 2, 0))
    below, right = np.minimum(top + 1, height - 1), np.minimum(left + 1, width - 1)
    fy, fx, each = y - top, x - left, np.arange(n)[:, None, None]
    upper = images[each, top, left] * (1 - fx) + images[each, top, right] * fx
    return upper * (1 - fy) + (images[each, below, left] * (1 - fx) + images[each, below, right] * fx) * fy


def dense_flow(before: np.ndarray, after: np.ndarray, smoothness: float = SMOOTHNESS, steps: int = STEPS, warps: int = WARPS) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): how far each pixel moves to the right and down from each image of `before` to that of `after`, [pair, row, column].

    Horn and Schunck (1981), from coarse to fine: brightness stays where a pixel goes, and neighbours move alike. Each level
    halves the images until a side is under twice LEAST_SIDE; its flow is the start of the next, towards which the second
    image is moved before the remaining motion is solved for. All pairs go through together.
    """
    spread = np.maximum(before.std(axis=(1, 2)), after.std(axis=(1, 2)))[:, None, None]
    levels = [(before / np.where(spread > 0, spread, 1), after / np.where(spread > 0, spread, 1))]
    while min(levels[-1][0].shape[1:]) >= 2 * LEAST_SIDE:
        levels.append(tuple(map(_halved, levels[-1])))
    u = v = np.zeros_like(levels[-1][0])
    for a, b in reversed(levels):
        if a.shape != u.shape:
            u, v = _doubled(u, *a.shape[1:]), _doubled(v, *a.shape[1:])
        for _ in range(warps):
            seen = _moved(b, u, v)
            between = np.pad((a + seen) / 2, ((0, 0), (1, 1), (1, 1)), mode="edge")
            gx, gy = (between[:, 1:-1, 2:] - between[:, 1:-1, :-2]) / 2, (between[:, 2:, 1:-1] - between[:, :-2, 1:-1]) / 2
            rest = seen - a - gx * u - gy * v
            weight = 1 / (smoothness + gx**2 + gy**2)
            for _ in range(steps):
                mu, mv = _around(u), _around(v)
                off = (gx * mu + gy * mv + rest) * weight
                u, v = mu - gx * off, mv - gy * off
    return u, v


def flow_motion(frames: DataFrame, clip: str, order: str, pixels: str, height: int, width: int) -> DataFrame:
    """(clip, motion): the mean over consecutive readable frames of the mean length of the dense flow between them; 0 if there are no
    two. Unreadable frames, null or of another size, are left out first, so their neighbours meet. Pairs are solved in Arrow
    batches; a clip's frames meet in a window and are not gathered."""

    @F.pandas_udf("double")
    def length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in batches:
            found = []
            for first in range(0, len(before), 256):
                a, b = (np.stack(s[first : first + 256].to_numpy()).reshape(-1, height, width).astype(float) for s in (before, after))
                found.append(np.hypot(*dense_flow(a, b)).mean(axis=(1, 2)))
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    before = F.lag(pixels).over(Window.partitionBy(clip).orderBy(order))
    pairs = frames.where(F.size(pixels) == height * width).withColumn("__before", before).where("__before IS NOT NULL")
    moved = pairs.select(clip, length("__before", pixels).alias("__length")).groupBy(clip).agg(F.avg("__length").alias("__motion"))
    named = moved.withColumnRenamed(clip, "__clip")
    return frames.select(clip).distinct().join(named, F.col(clip).eqNullSafe(F.col("__clip")), "left").select(clip, F.coalesce("__motion", F.lit(0.0)).alias("motion"))
