"""Summed-area tables of images that no task should hold: tiles, with sums carried from the tiles before them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumigrid.session import Scratch, materialize

_TILE = ["img_id", "tr", "tc"]
_SUMS = ("rows", "columns", "rows_sq", "columns_sq")


def _pixels(batch: pa.RecordBatch, at: int) -> np.ndarray:
    names = batch.schema.names
    h, w = (batch.column(names.index(n))[at].as_py() for n in ("h", "w"))
    v = np.asarray(batch.column(names.index("px"))[at].values, np.float64)
    if len(v) != h * w:
        raise ValueError(f"a tile of {h} x {w} has {len(v)} pixels")
    return v.reshape(h, w)


def _edge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[list] = [[] for _ in _SUMS]
        for k in range(batch.num_rows):
            v = _pixels(batch, k)
            for out, x in zip(made, (v.sum(1), v.sum(0), (v * v).sum(1), (v * v).sum(0))):
                out.append(x)
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _TILE), *(pa.array(x, kind) for x in made)], names=[*_TILE, *_SUMS])


def _carried(sums: DataFrame, across: str, along: str, names: tuple[str, str], out: str) -> DataFrame:
    """For each tile and line the sums of the same line in the tiles before it; a row of tiles is summed line by line."""
    value, square = names
    lines = sums.select(*_TILE, F.posexplode(F.arrays_zip(value, square)).alias("line", "s"))
    before = Window.partitionBy("img_id", across, "line").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    summed = lines.select(*_TILE, "line", *(F.coalesce(F.sum(f"s.{n}").over(before), F.lit(0.0)).alias(n) for n in names))
    ordered = F.array_sort(F.collect_list(F.struct("line", *names)))
    pick = lambda n: F.transform("own", lambda x: x[n])
    return summed.groupBy(*_TILE).agg(ordered.alias("own")).select(*_TILE, pick(value).alias(out), pick(square).alias(f"{out}_sq"))


def integral_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles (img_id, tr, tc, h, w, px) with px replaced by ii and ii_sq, the whole image's sums up to each pixel, row-major.

    tr and tc number the tiles of an image down and across, without gaps before a tile; tiles of a row are equally high,
    those of a column equally wide. A pixel's sum is that within its tile, the rows to the left of the tile, the columns
    above it and the corner between: what a tile needs of others is one number for each of its rows and columns. A null
    px is an error; images of one tile are as integral_arrays has them, without the row and column of zeros.
    """
    scratch = Scratch(tiles.sparkSession)
    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in _TILE)
    sums = scratch.table(tiles.select(*_TILE, "h", "w", "px").mapInArrow(_edge_sums, f"{kinds}, " + ", ".join(f"{n} array<double>" for n in _SUMS)), "edge-sums")
    left = _carried(sums, "tr", "tc", ("rows", "rows_sq"), "left")
    above = _carried(sums, "tc", "tr", ("columns", "columns_sq"), "above")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # the corner is what stands above the rows to the left: the sums to the left of each tile row, summed downwards
    down = Window.partitionBy("img_id", "tc").orderBy("tr").rowsBetween(Window.unboundedPreceding, -1)
    totals = left.select(*_TILE, add("left").alias("t"), add("left_sq").alias("t_sq"))
    corner = totals.select(*_TILE, *(F.coalesce(F.sum(n).over(down), F.lit(0.0)).alias(f"corner{n[1:]}") for n in ("t", "t_sq")))
    carried = scratch.table(left.join(above, _TILE).join(corner, _TILE), "carried-sums")
    rest = [c for c in tiles.columns if c != "px"]
    schema = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in rest)
    joined = tiles.select(*rest, "px").join(carried, _TILE).select(*rest, "px", "left", "above", "corner", "left_sq", "above_sq", "corner_sq")
    out = materialize(joined.mapInArrow(_whole(rest), f"{schema}, ii array<double>, ii_sq array<double>"), "integral-tiles")
    scratch.clear()
    return out


def _whole(rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, made = batch.schema.names, ([], [])
            for k in range(batch.num_rows):
                v = _pixels(batch, k)
                for out, x, end in ((made[0], v, ""), (made[1], v * v, "_sq")):
                    left, above, corner = (batch.column(names.index(n + end))[k] for n in ("left", "above", "corner"))
                    left, above = np.asarray(left.values, np.float64), np.asarray(above.values, np.float64)
                    out.append((x.cumsum(0).cumsum(1) + left.cumsum()[:, None] + above.cumsum() + corner.as_py()).ravel())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(x, kind) for x in made)], names=[*rest, "ii", "ii_sq"])

    return run
