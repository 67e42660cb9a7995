"""Operators over gray images in long form (img_id, r, c, v) or as arrays (img_id, h, w, px)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def gray(b: Column, g: Column, r: Column) -> Column:
    """Gray value of blue, green and red: 0.114, 0.587 and 0.299, rounded half to even."""
    return F.rint((114 * b + 587 * g + 299 * r) / 1000.0).cast("long")


def _moments(pixels: DataFrame) -> DataFrame:
    own = Window.partitionBy("img_id")
    n, s, q = F.count("v").over(own), F.sum("v").over(own), F.sum(F.col("v") * F.col("v")).over(own)
    return pixels.withColumn("mean", s / n).withColumn("var", F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))


def normalise_or_zero(pixels: DataFrame, least_std: float = 1e-6) -> DataFrame:
    """(v - mean) / std for each image; 0 throughout where the deviation is below least_std."""
    m = _moments(pixels)
    return m.select("img_id", "r", "c", F.when(F.sqrt("var") < least_std, F.lit(0.0)).otherwise(F.try_divide(F.col("v") - F.col("mean"), F.sqrt("var"))).alias("z"))


def normalise_or_drop(pixels: DataFrame, least_var: float = 1e-4) -> DataFrame:
    """The same, but images with a variance below least_var are dropped."""
    m = _moments(pixels).where(F.col("var") >= least_var)
    return m.select("img_id", "r", "c", ((F.col("v") - F.col("mean")) / F.sqrt("var")).alias("z"))


def quantise(pixels: DataFrame, value: str = "v", least_range: float = 1e-6) -> DataFrame:
    """Values stretched to 0..255 and truncated; 0 throughout where the range is below least_range."""
    own = Window.partitionBy("img_id")
    lo, hi = F.min(value).over(own), F.max(value).over(own)
    marked = pixels.withColumn("lo", lo).withColumn("hi", hi)
    stretched = F.try_divide(F.col(value) - F.col("lo"), (F.col("hi") - F.col("lo")).cast("double")) * 255
    return marked.select("img_id", "r", "c", F.when(F.col("hi") - F.col("lo") < least_range, F.lit(0)).otherwise(stretched.cast("int")).alias("q"))


def downscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor blocks."""
    block = lambda c: (F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy("img_id", block("r"), block("c")).agg(F.avg("v").alias("v"))


def _edges(size: int, into: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the into parts of size pixels begin and end: whole pixels and the fraction beyond."""
    at = np.arange(into + 1) * (size / into)
    whole = np.minimum(at.astype(np.int64), size)
    return whole, at - whole


def area_resized(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source pixels that each target pixel covers, parts of pixels counting by their share.

    The covered sums come from a summed-area table, read between its entries where a part of a pixel is covered.
    """
    table = np.zeros((px.shape[0] + 1, px.shape[1] + 1))
    table[1:, 1:] = px.cumsum(0).cumsum(1)
    down, y = _edges(px.shape[0], height)
    across, x = _edges(px.shape[1], width)
    rows = table[down] + (table[np.minimum(down + 1, px.shape[0])] - table[down]) * y[:, None]
    both = rows[:, across] + (rows[:, np.minimum(across + 1, px.shape[1])] - rows[:, across]) * x
    return np.diff(np.diff(both, axis=0), axis=1) / ((px.shape[0] / height) * (px.shape[1] / width))


def _taps(size: int, into: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two source pixels around each target pixel's centre, held at the edges, and the weight of the second."""
    at = np.clip((np.arange(into) + 0.5) * (size / into) - 0.5, 0, size - 1)
    low = at.astype(np.int64)
    return low, np.minimum(low + 1, size - 1), at - low


def bilinear_resized(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Weighted means of the four pixels around the centre of each target pixel."""
    a, b, down = _taps(px.shape[0], height)
    c, d, across = _taps(px.shape[1], width)
    rows = px[a] * (1 - down)[:, None] + px[b] * down[:, None]
    return rows[:, c] * (1 - across) + rows[:, d] * across


RESIZES = {"area": area_resized, "bilinear": bilinear_resized}


def resize(images: DataFrame, height: int, width: int, method: str = "area", rounded: bool = True) -> DataFrame:
    """Images (img_id, h, w, px, more columns) in another size; px is array<int>, half to even, or not rounded array<double>.

    Method area weighs the pixels that a target pixel covers and suits smaller targets; bilinear interpolates. Images
    are resized where they are, whatever their sizes. A null px stays null; an image without pixels is an error.
    """
    if method not in RESIZES or min(height, width) < 1:
        raise ValueError("method must be area or bilinear, height and width at least 1")
    solve = RESIZES[method]
    rest = [c for c in images.columns if c not in ("h", "w", "px")]
    kinds = "".join(f"`{c}` {images.schema[c].dataType.simpleString()}, " for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.schema.names, []
            for h, w, px in zip(batch.column(names.index("h")).to_pylist(), batch.column(names.index("w")).to_pylist(), batch.column(names.index("px"))):
                if px.values is None:
                    out.append(None)
                    continue
                made = solve(np.asarray(px.values, np.float64).reshape(h, w), height, width).ravel()
                out.append(np.rint(made).astype(np.int32) if rounded else made)
            size = [pa.array([n] * len(out), pa.int32()) for n in (height, width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *size, pa.array(out, pa.list_(pa.int32() if rounded else pa.float64()))], names=[*rest, "h", "w", "px"])

    return images.select(*rest, "h", "w", "px").mapInArrow(run, f"{kinds}h int, w int, px array<{'int' if rounded else 'double'}>")


def fit(px: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """An image with its longer side at most `most`, by area, and the factor; a smaller image stays as it is."""
    height, width = px.shape
    if not most or max(height, width) <= most:
        return px, 1.0
    factor = most / max(height, width)
    return np.rint(area_resized(px, max(1, int(height * factor)), max(1, int(width * factor)))), factor


def equalise(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation to 0..255, rounded half to even; an image of one value keeps it."""
    counts = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("img_id")
    summed = counts.withColumn("below", F.sum("n").over(order)).withColumn("total", F.sum("n").over(own)).withColumn("first", F.min("below").over(own))
    lut = summed.select("img_id", "v", F.when(F.col("total") == F.col("first"), F.col("v")).otherwise(F.rint(F.try_divide((F.col("below") - F.col("first")) * 255.0, (F.col("total") - F.col("first")).cast("double"))).cast("long")).alias("e"))
    return pixels.join(lut, ["img_id", "v"]).select("img_id", "r", "c", "e")


def integral(pixels: DataFrame) -> DataFrame:
    """Padded summed-area tables of values and squares, long form: (img_id, r, c, ii, ii_sq), first row and column 0."""
    along = Window.partitionBy("img_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.select("img_id", "r", "c", F.sum("v").over(along).alias("a"), F.sum(F.col("v") * F.col("v")).over(along).alias("b"))
    inner = rows.select("img_id", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), F.sum("a").over(down).alias("ii"), F.sum("b").over(down).alias("ii_sq"))
    size = pixels.groupBy("img_id").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    edge = lambda r, c: size.select("img_id", r, c, F.lit(0).cast("long").alias("ii"), F.lit(0).cast("long").alias("ii_sq"))
    top = edge(F.lit(0).alias("r"), F.explode(F.sequence(F.lit(0), F.col("w") + 1)).alias("c"))
    left = edge(F.explode(F.sequence(F.lit(1), F.col("h") + 1)).alias("r"), F.lit(0).alias("c"))
    return inner.unionByName(top).unionByName(left)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        sums, squares = [], []
        for h, w, px in zip(batch.column(names.index("h")).to_pylist(), batch.column(names.index("w")).to_pylist(), batch.column(names.index("px"))):
            v = np.asarray(px.values, np.float64)
            if len(v) != h * w:
                raise ValueError(f"an image of {h} x {w} has {len(v)} pixels")
            for out, x in ((sums, v.reshape(h, w)), (squares, v.reshape(h, w) ** 2)):
                padded = np.zeros((h + 1, w + 1))
                padded[1:, 1:] = x.cumsum(0).cumsum(1)
                out.append(padded.ravel())
        kept = [k for k, n in enumerate(names) if n != "px"]
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sums, kind), pa.array(squares, kind)], names=[*(names[k] for k in kept), "ii", "ii_sq"])


def integral_arrays(images: DataFrame) -> DataFrame:
    """Images (img_id, h, w, px, more columns) with px replaced by padded row-major tables ii and ii_sq."""
    rest = [c for c in images.columns if c != "px"]
    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in rest)
    return images.select(*rest, "px").mapInArrow(_tables, f"{kinds}, ii array<double>, ii_sq array<double>")
