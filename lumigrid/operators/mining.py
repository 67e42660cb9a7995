"""Patches out of images: windows in a seeded order of images, judged inside the task, up to a quota over all images."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumigrid.operators.cascade import Stage, _corners, judge, moments, rectangles, tables_of
from lumigrid.operators.dataset import seeded_order
from lumigrid.session import Scratch, materialize

#: Images that the first round of a search reads about.
FIRST = 256
#: Parts of the seeded order of images, by the first two digits of their hash.
BUCKETS = 256
#: Windows that a task judges at a time.
_BLOCK = 1 << 16
_PRIME = 2147483647


@dataclass(frozen=True)
class Windows:
    """Square windows of one image, none of them flat, and what a predicate may ask about them."""

    px: np.ndarray
    table: np.ndarray
    r: np.ndarray
    c: np.ndarray
    size: int
    mean: np.ndarray
    std: np.ndarray

    def __len__(self) -> int:
        return len(self.r)

    def at(self, own) -> Windows:
        return Windows(self.px, self.table, self.r[own], self.c[own], self.size, self.mean[own], self.std[own])

    def patches(self) -> np.ndarray:
        """(n, size, size): the windows' pixels, each less its mean and over its deviation."""
        views = np.lib.stride_tricks.sliding_window_view(self.px, (self.size, self.size))
        return (views[self.r, self.c] - self.mean[:, None, None]) / self.std[:, None, None]

    def contrasts(self, weak, own=slice(None)) -> np.ndarray:
        """A feature of the normalised patches, from the image's table: their mean goes with the rectangles' net area."""
        own_rectangles = rectangles(weak.ftype)
        r, c = self.r[own] + weak.r, self.c[own] + weak.c
        raw = sum(sign * _corners(self.table, r + down * weak.h, c + across * weak.w, weak.h, weak.w) for sign, down, across in own_rectangles)
        net = sum(sign for sign, _, _ in own_rectangles) * weak.h * weak.w
        return (raw - net * self.mean[own]) / self.std[own]


#: What decides on windows: a condition on the columns r, c, mean, var and z of a patch, or a function of many windows.
Predicate = Column | Callable[[Windows], np.ndarray]


def accepts(stages: list[Stage]) -> Predicate:
    """The windows that a cascade accepts, each stage seeing what the stages before it left."""

    def accept(windows: Windows) -> np.ndarray:
        mask = np.zeros(len(windows), bool)
        mask[judge(stages, len(windows), windows.contrasts)] = True
        return mask

    return accept


def places(height: int, width: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(r, c) of the windows of a grid, by row and column; none in a smaller image."""
    r, c = np.meshgrid(np.arange(0, height - size + 1, step), np.arange(0, width - size + 1, step), indexing="ij")
    return r.ravel(), c.ravel()


def shuffled(n: int, img_id: int, seed: int) -> np.ndarray:
    """The numbers below n in an order that depends on image and seed only."""
    x = (np.arange(n, dtype=np.int64) + 1 + (img_id % _PRIME) * 7919 % _PRIME + seed) % _PRIME
    x = x * 48271 % _PRIME
    return np.lexsort((np.arange(n), x * x % _PRIME))


def _windows(px: np.ndarray, r: np.ndarray, c: np.ndarray, size: int, least_var: float) -> Windows:
    tables = tables_of(px)
    mean, var = moments(tables, r, c, size)
    keep = var >= least_var
    return Windows(px, tables[0], r[keep], c[keep], size, mean[keep], np.sqrt(var[keep]))


def _bucket(key: str, seed: int) -> Column:
    return F.conv(F.substring(seeded_order(key, seed), 1, 2), 16, 10).cast("int")


def store_shuffled(images: DataFrame, path: str, seed: int = 42) -> None:
    """Write images in parts of their seeded order, so that a search reads the parts of its rounds only."""
    images.withColumn("bucket", _bucket("img_id", seed)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _rounds(n: int, first: int) -> Iterator[tuple[int, int]]:
    """Ranges of buckets, each twice as wide as all before, the first with about first of n images."""
    low, high = 0, min(BUCKETS, max(1, -(-BUCKETS * first // max(n, 1))))
    while low < BUCKETS:
        yield low, high
        low, high = high, min(BUCKETS, 3 * high)


def collect_patches(images: DataFrame, most: int, mode: str = "scan", accept: Predicate | None = None, size: int = 24, step: int = 4, least_var: float = 1e-4, one_per_image: bool = False, seed: int = 42, first: int = FIRST) -> DataFrame:
    """The first most patches (k, img_id, r, c, z) of images (img_id, h, w, px), by the seeded order of images.

    z has the window's pixels less their mean over their deviation, row by row; windows of a variance below least_var
    do not count. Mode scan takes the windows of a grid that accept accepts, by row and column; without accept all.
    Mode random takes, in a seeded order, one window of each image or as many as let half the images fill the quota.

    Images are read in rounds of growing ranges of their order, which end when the quota is full; each task judges the
    windows of an image where it is. Only places are kept at first; the patches chosen, at most `most`, go back to their
    images by broadcast and are cut out there. A column bucket, as store_shuffled writes it, lets rounds skip the rest.
    Images without pixels, or smaller than a window, have none; img_id must be unique; no images give no rows.
    """
    if mode not in ("scan", "random"):
        raise ValueError("mode must be scan or random")
    if mode == "random" and accept is not None:
        raise ValueError("random patches are not judged")
    if most < 1 or size < 1 or step < 1:
        raise ValueError("most, size and step must be positive")
    stored = "bucket" in images.columns
    bucket = F.col("bucket") if stored else _bucket("img_id", seed)
    own = images.select(F.col("img_id").cast("long").alias("img_id"), "h", "w", "px", seeded_order("img_id", seed).alias("place"), bucket.alias("bucket")).where("px is not null")
    n = images.where("px is not null").count()
    per_image = 1 if one_per_image else max(1, most // max(1, n // 2)) if mode == "random" else most
    hook = accept if callable(accept) and not isinstance(accept, Column) else None
    condition = accept if isinstance(accept, Column) else None
    whole = condition is not None  # tasks hand on the pixels of all windows, as the condition may ask for them
    names = ["place", "img_id", "at", "r", "c", *["mean", "var", "z"][: 3 * whole]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, img_id, h, w, px in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                image = np.asarray(px.values, np.float64).reshape(h, w)
                r, c = places(h, w, size, step if mode == "scan" else 1)
                if mode == "random":
                    order = shuffled(len(r), img_id, seed)
                    r, c = r[order], c[order]
                yield from _found(place, img_id, _windows(image, r, c, size, least_var))

    def _found(place: str, img_id: int, all_windows: Windows) -> Iterator[pa.RecordBatch]:
        left = per_image
        for at in range(0, len(all_windows), _BLOCK):
            kept = np.arange(at, min(at + _BLOCK, len(all_windows)))
            if hook is not None:
                kept = kept[np.asarray(hook(all_windows.at(kept)), bool)]
            if not whole:
                kept = kept[:left]
                left -= len(kept)
            found = all_windows.at(kept)
            columns = [pa.array([place] * len(kept), pa.string()), pa.array([img_id] * len(kept), pa.int64()), *(pa.array(x.astype(np.int32)) for x in (kept, found.r, found.c))]
            if whole:
                z = found.patches().reshape(-1)
                ends = pa.array(np.arange(0, len(z) + 1, size * size, dtype=np.int32))
                columns += [pa.array(found.mean), pa.array(found.std**2), pa.ListArray.from_arrays(ends, pa.array(z))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if left <= 0:
                return

    schema = "place string, img_id long, at int, r int, c int" + ", mean double, var double, z array<double>" * whole
    spark, scratch, rounds, count = images.sparkSession, Scratch(images.sparkSession), [], 0
    for low, high in _rounds(n, first):
        part = own.where((F.col("bucket") >= low) & (F.col("bucket") < high)).select("place", "img_id", "h", "w", "px")
        found = part.mapInArrow(search, schema)
        if whole:
            found = found.where(condition)
        rounds.append(scratch.table(found.select("place", "img_id", "at", "r", "c"), "mined"))
        count += rounds[-1].count()
        if count >= most:
            break
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    chosen = [(k, x["img_id"], x["r"], x["c"]) for k, x in enumerate(found.orderBy("place", "img_id", "at").limit(most).collect())]
    scratch.clear()
    wanted = spark.createDataFrame(chosen, "k int, img_id long, r int, c int")
    return materialize(patches_at(own, F.broadcast(wanted), size), "patches")  # at most `most` places


def patches_at(images: DataFrame, wanted: DataFrame, size: int = 24, least_var: float = 1e-4) -> DataFrame:
    """(k, img_id, r, c, z) of the windows of images (img_id, h, w, px) that wanted (img_id, r, c, perhaps k) names.

    Places of an image are brought to it together. Windows of a variance below least_var have no patch, nor have images
    without pixels; a place outside of its image is an error. Without k, patches are numbered by row and column.
    """
    hinted = wanted
    if "k" not in wanted.columns:
        hinted = wanted.withColumn("k", F.lit(0))
    cuts = hinted.groupBy(F.col("img_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("k", "r", "c"))).alias("cuts"))
    own = images.where("px is not null")
    met = own.join(cuts, own["img_id"] == cuts["_id"]).select(F.col("img_id").cast("long").alias("img_id"), "h", "w", "px", "cuts")
    return met.mapInArrow(_crop(size, least_var), "k int, img_id long, r int, c int, z array<double>")


def _crop(size: int, least_var: float):
    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img_id, h, w, px, cuts in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4).to_pylist()):
                k, r, c = (np.array([x[n] for x in cuts], np.int64) for n in ("k", "r", "c"))
                if (r < 0).any() or (c < 0).any() or (r > h - size).any() or (c > w - size).any():
                    raise ValueError(f"a place outside of image {img_id}")
                image = np.asarray(px.values, np.float64).reshape(h, w)
                _, var = moments(tables_of(image), r, c, size)
                k, r, c = (x[var >= least_var] for x in (k, r, c))
                z = _windows(image, r, c, size, least_var).patches().reshape(-1)
                ends = pa.array(np.arange(0, len(z) + 1, size * size, dtype=np.int32))
                columns = [pa.array(k.astype(np.int32)), pa.array([img_id] * len(k), pa.int64()), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(z))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "img_id", "r", "c", "z"])

    return crop


def mine_negatives(images: DataFrame, stages: list[Stage], most: int = 2400, **options) -> DataFrame:
    """Patches that a cascade takes for faces, among images without any."""
    return collect_patches(images, most, "scan", accepts(stages), **options)


class _Groups:
    """Boxes added one by one; each joins the group of the boxes that are similar to it."""

    def __init__(self, eps: float):
        self.eps, self.parent, self.size, self.boxes, self.cells = eps, [], [], [], {}

    def _root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def add(self, x: int, y: int, win: int) -> int:
        """The number of boxes in the box's group."""
        k = len(self.boxes)
        self.boxes.append((x, y, win))
        self.parent.append(k)
        self.size.append(1)
        cell = max(1, int(self.eps * win) + 1)
        # similar boxes differ by eps of the smaller side at most, so they lie in the cells around, for each width met
        for other, grid in self.cells.items():
            if abs(other - win) > 2 * self.eps * min(other, win):
                continue
            wide = max(1, int(self.eps * other) + 1)
            gx, gy = x // wide, y // wide
            reach = self.eps * min(win, other)
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    for j in grid.get((gx + dx, gy + dy), ()):
                        a, b, w = self.boxes[j]
                        if abs(a - x) <= reach and abs(b - y) <= reach and abs(a + w - x - win) <= reach and abs(b + w - y - win) <= reach:
                            one, two = self._root(j), self._root(k)
                            if one != two:
                                self.parent[two] = one
                                self.size[one] += self.size[two]
        self.cells.setdefault(win, {}).setdefault((x // cell, y // cell), []).append(k)
        return self.size[self._root(k)]


def equalised(px: np.ndarray) -> np.ndarray:
    """Histogram equalisation of gray values 0 to 255, as lumigrid.operators.images.equalise does it."""
    values, inverse, counts = np.unique(px, return_inverse=True, return_counts=True)
    below = np.cumsum(counts)
    if len(values) == 1:
        return px
    return np.rint((below - below[0]) * 255.0 / (below[-1] - below[0]))[inverse].reshape(px.shape)


def without_faces(images: DataFrame, stages: list[Stage], cfg, neighbours: int = 2, least_side: int = 50, eps: float = 0.2) -> DataFrame:
    """The rows of images (img_id, h, w, px, more columns) in which the detector meets no face, unchanged.

    An image has a face as soon as more than neighbours accepted windows of its equalised pixels form a group of similar
    boxes; the scan of the image ends there. Images without pixels, with another number of them than h * w, or with a
    side below least_side count as faces: in doubt an image is not taken for a negative one.
    """
    from lumigrid.operators.cascade import scan_scales

    def has_face(h: int | None, w: int | None, px) -> bool:
        if px is None or h is None or w is None or min(h, w) < least_side or len(px) != h * w:
            return True
        groups = _Groups(eps)
        image = equalised(np.asarray(px, np.float64).reshape(h, w))
        return any(groups.add(x, y, win) > neighbours for win, r, c in scan_scales(image, stages, cfg) for y, x in zip(r.tolist(), c.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, px = (batch.column(batch.schema.names.index(n)) for n in ("h", "w", "px"))
            keep = [not has_face(a, b, None if p.values is None else p.values.to_numpy(zero_copy_only=False)) for a, b, p in zip(h.to_pylist(), w.to_pylist(), px)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return images.mapInArrow(run, images.schema)

