"""Scale ladders, window grids and rectangle-contrast features as generated rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumigrid.functions.geometry import RECTANGLES, contrast_at_scale

BASE = 24
#: Rectangles across and down of each feature type.
EXTENTS = ((2, 1), (1, 2), (3, 1), (1, 3), (2, 2))


def enumerate_features(spark: SparkSession, win: int = BASE, stride: int = 1) -> DataFrame:
    """All features of a window: feature_id, ftype, r, c, h, w; ids follow type, r, c, h, w."""
    steps = lambda first, last: F.when(last >= first, F.sequence(F.lit(first), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    kinds = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("ftype"), F.lit(x).alias("across"), F.lit(y).alias("down")) for k, (x, y) in enumerate(EXTENTS)))).alias("t")).select("t.*")
    out = kinds.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(win - 1), F.lit(stride)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(win - 1), F.lit(stride))))
    out = out.withColumn("h", F.explode(steps(1, ((win - F.col("r")) / F.col("down")).cast("int")))).withColumn("w", F.explode(steps(1, ((win - F.col("c")) / F.col("across")).cast("int"))))
    # the table is bounded by the window's size, so one sort numbers it
    from pyspark.sql import Window

    order = Window.orderBy("ftype", "r", "c", "h", "w")
    return out.select((F.row_number().over(order) - 1).alias("feature_id"), "ftype", "r", "c", "h", "w")


def features_by_stride(rows: DataFrame, win: int = BASE) -> DataFrame:
    """rows (stride, more columns) with all features of a window at their stride, which is 1, 2 or 3."""
    every = None
    for stride in (1, 2, 3):
        own = enumerate_features(rows.sparkSession, win, stride).select(F.lit(stride).alias("stride"), "feature_id", "ftype", "r", "c", "h", "w")
        every = own if every is None else every.unionByName(own)
    return rows.join(F.broadcast(every), "stride")  # bounded by the window's size


def adaptive_stride(n_positive: Column) -> Column:
    """3 up to 1,000 positive samples, 2 up to 3,000, else 1."""
    return F.when(n_positive <= 1000, 3).when(n_positive <= 3000, 2).otherwise(1)


def scale_ladder(height: int, width: int, factor: float = 1.25, least: int = BASE, most: int | None = None) -> list[tuple[int, float, int]]:
    """(scale_idx, scale, win): windows from least pixels up, while they fit the image and most."""
    most = min(height, width) if most is None else most
    out, scale = [], least / BASE
    while (win := round(BASE * scale)) <= min(most, height, width):
        out.append((len(out), scale, win))
        scale *= factor
    return out


def image_ladders(images: DataFrame, factor: float = 1.25, least: int = BASE, most: int | None = None, largest: int = 1 << 14) -> DataFrame:
    """images (h, w, more columns) with a row for each scale of each: scale_idx, scale, win.

    The scales do not depend on the image; how many there are does. largest: the side that no image exceeds. Images
    without a size have no scale.
    """
    rungs = F.array(*(F.struct(F.lit(k).alias("scale_idx"), F.lit(scale).alias("scale"), F.lit(win).alias("win")) for k, scale, win in scale_ladder(largest, largest, factor, least)))
    side = F.least("h", "w") if most is None else F.least("h", "w", F.lit(most))
    fit = F.when(F.greatest("h", "w") > largest, F.raise_error(F.lit(f"an image of more than {largest} pixels across")).cast("array<struct<scale_idx:int,scale:double,win:int>>")).otherwise(F.filter(rungs, lambda x: x["win"] <= side))
    return images.dropna(subset=["h", "w"]).withColumn("_rung", F.explode(fit)).select("*", "_rung.*").drop("_rung")


def window_grid(ladder: DataFrame, delta: float = 1.0) -> DataFrame:
    """All windows of ladder (h, w, scale, win, more columns) that fit, the far edges included: step, r, c.

    The step is scale * delta, rounded, at least 1.
    """
    stepped = ladder.withColumn("step", _step(delta))
    return stepped.withColumn("r", F.explode(_places("h"))).withColumn("c", F.explode(_places("w")))


def _step(delta: float) -> Column:
    return F.greatest(F.lit(1), F.rint(F.col("scale") * delta).cast("int"))


def _places(size: str) -> Column:
    """Where windows begin along one side."""
    return F.sequence(F.lit(0), F.col(size) - F.col("win"), F.col("step"))


def grid_extents(ladder: DataFrame, delta: float = 1.0) -> DataFrame:
    """ladder with the windows that window_grid gives for each row: step, their number n, and last_r and last_c, the last places.

    A row's windows are all pairs of a place down and a place across, so the two lists tell of them all.
    """
    placed = ladder.withColumn("step", _step(delta)).withColumn("_down", _places("h")).withColumn("_across", _places("w"))
    ends = placed.withColumn("n", F.size("_down").cast("long") * F.size("_across")).withColumn("last_r", F.element_at("_down", -1)).withColumn("last_c", F.element_at("_across", -1))
    return ends.drop("_down", "_across")


def detector_windows(ladder: DataFrame, step_factor: float = 3.0) -> DataFrame:
    """window_grid without the windows that lie within 3 pixels of the right or lower edge."""
    inside = (F.col("r") + F.col("win") + 3 < F.col("h")) & (F.col("c") + F.col("win") + 3 < F.col("w"))
    return window_grid(ladder, step_factor).where(inside)


#: Features of a window; at a side of 24 there are 162,336.
_MOST_FEATURES = 1 << 20
#: Values that a task computes at a time.
_CELLS = 1 << 21


def corner_weights(features: DataFrame, width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ids, places, weights) of features in the order of their ids: where in a table of images width wide, and how often.

    A feature is a weighted sum of up to 16 entries of the padded table. The features are bounded by their window.
    """
    rows = features.select("feature_id", "ftype", "r", "c", "h", "w").orderBy("feature_id").limit(_MOST_FEATURES + 1).collect()
    if len(rows) > _MOST_FEATURES:
        raise ValueError(f"more than {_MOST_FEATURES} features")
    at, weight = np.zeros((len(rows), 16), np.int32), np.zeros((len(rows), 16))
    for k, (_, ftype, r, c, h, w) in enumerate(rows):
        if ftype not in RECTANGLES:
            raise ValueError(f"unknown feature type {ftype}")
        n = 0
        for sign, down, across in RECTANGLES[ftype]:
            top, left = r + down * h, c + across * w
            for y, x, corner in ((top + h, left + w, 1), (top, left, 1), (top, left + w, -1), (top + h, left, -1)):
                at[k, n], weight[k, n], n = y * (width + 1) + x, sign * corner, n + 1
    return [r["feature_id"] for r in rows], at, weight


def _gathered(tables: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n, features) of n flat tables."""
    out = np.zeros((len(tables), len(at)))
    for k in range(at.shape[1]):
        if weight[:, k].any():
            out += tables[:, at[:, k]] * weight[:, k]
    return out


def feature_values(tables: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """(img_id, feature_id, val) of each image (img_id, w, ii) and each feature, val as float.

    width: that of all images, the first row's if it is not given; another one is an error. A task gathers all features
    of an image at once from its table; nothing is joined or moved.
    """
    if width is None:
        first = tables.select("w").first()
        width = first["w"] if first else BASE
    ids, at, weight = corner_weights(features, width)
    shared = tables.sparkSession.sparkContext.broadcast((at, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        for batch in batches:
            if any(w != width for w in batch.column(1).to_pylist()):
                raise ValueError(f"an image is not {width} wide")
            step = max(1, _CELLS // max(1, len(at)))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                values = _gathered(np.stack([x.values.to_numpy(zero_copy_only=False) for x in some.column(2)]), at, weight).astype(np.float32)
                ends = pa.array(np.arange(0, values.size + 1, max(1, len(at)), dtype=np.int32)) if len(at) else pa.array([0] * (len(values) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["img_id", "vals"])

    kind = tables.schema["img_id"].dataType.simpleString()
    wide = tables.select("img_id", "w", "ii").mapInArrow(run, f"img_id {kind}, vals array<float>")
    long = wide.select("img_id", F.posexplode("vals").alias("feature_id", "val"))
    if ids == list(range(len(ids))):
        return long
    return long.withColumn("feature_id", F.get(F.array(*map(F.lit, ids)), F.col("feature_id")))


def patch_features(patches: DataFrame, features: DataFrame, size: int = BASE) -> DataFrame:
    """patches with z (size x size pixels) replaced by x (array<double>): all features, in the order of their ids."""
    _, at, weight = corner_weights(features, size)
    shared = patches.sparkSession.sparkContext.broadcast((at, weight))
    rest = [c for c in patches.columns if c != "z"]
    kinds = "".join(f"`{c}` {patches.schema[c].dataType.simpleString()}, " for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        for batch in batches:
            step = max(1, _CELLS // max(1, len(at)))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                z = some.column(some.schema.names.index("z")).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
                tables = np.zeros((len(z), size + 1, size + 1))
                tables[:, 1:, 1:] = z.cumsum(1).cumsum(2)
                values = _gathered(tables.reshape(len(z), -1), at, weight)
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * len(at)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), x], names=[*rest, "x"])

    return patches.select(*rest, "z").mapInArrow(run, f"{kinds}x array<double>")


def feature_values_at_scale(tables: DataFrame, features: DataFrame, scale: float, win_r: int, win_c: int) -> DataFrame:
    """The same for a window of an image at a scale."""
    own = tables.select("img_id", F.col("w").alias("_w"), "ii").crossJoin(F.broadcast(features))
    value = contrast_at_scale(F.col("ii"), F.col("_w"), F.struct("ftype", "r", "c", "h", "w"), F.lit(scale), F.lit(win_r), F.lit(win_c))
    return own.select("img_id", "feature_id", value.alias("val"))
