"""Box post-processing per image: votes, suppression, grouping.

boxes: img_id, box_id and x, y, w, h; box_id gives the input order and is unique within an image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumigrid.functions.geometry import iom, iou

#: Pairs of boxes that a task compares at a time.
_CELLS = 1 << 18
#: Boxes of an image up to which all are compared at once; more are met by grid cells.
_FEW = 256
#: Width of the grid cells in which boxes meet.
CELL = 64


def _check(threshold: float, min_votes: int = 1) -> None:
    if not 0 <= threshold <= 1 or min_votes < 1:
        raise ValueError("threshold must be in [0, 1] and min_votes at least 1")


def _pairs(boxes: DataFrame, cell: int) -> DataFrame:
    """Boxes a and b of an image that overlap, and some that do not, itself included.

    Boxes are put into all grid cells that they touch, and a pair is kept in the cell of its intersection's corner only.
    """
    own = boxes.select("img_id", F.struct("box_id", "x", "y", "w", "h").alias("a"))
    span = lambda lo, size: F.sequence(F.floor(lo / cell), F.floor((lo + F.greatest(size - 1, F.lit(0))) / cell))
    cells = own.withColumn("gx", F.explode(span(F.col("a.x"), F.col("a.w")))).withColumn("gy", F.explode(span(F.col("a.y"), F.col("a.h"))))
    both = cells.join(cells.withColumnRenamed("a", "b"), ["img_id", "gx", "gy"])
    corner = (F.floor(F.greatest("a.x", "b.x") / cell) == F.col("gx")) & (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("gy"))
    return both.where(corner)


def iou_pairs(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """(img_id, a_id, b_id, iou) of the overlapping pairs a_id < b_id."""
    near = _pairs(boxes, cell).where("a.box_id < b.box_id").withColumn("iou", iou(F.col("a"), F.col("b")))
    return near.where("iou > 0").select("img_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), "iou")


def votes(boxes: DataFrame, threshold: float = 0.3, cell: int = CELL) -> DataFrame:
    """(img_id, box_id, votes): how many boxes, itself included, overlap it by more than threshold of the smaller area."""
    counted = _pairs(boxes, cell).where(iom(F.col("a"), F.col("b")) > threshold).groupBy("img_id", F.col("a.box_id").alias("box_id")).agg(F.count("*").alias("votes"))
    return boxes.select("img_id", "box_id").join(counted, ["img_id", "box_id"], "left").select("img_id", "box_id", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def _overlap(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    wide = np.minimum(one[..., 0] + one[..., 2], other[..., 0] + other[..., 2]) - np.maximum(one[..., 0], other[..., 0])
    high = np.minimum(one[..., 1] + one[..., 3], other[..., 1] + other[..., 3]) - np.maximum(one[..., 1], other[..., 1])
    return (np.maximum(wide, 0) * np.maximum(high, 0)).astype(float)


def _of_smaller(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return _overlap(one, other) / np.minimum(one[..., 2] * one[..., 3], other[..., 2] * other[..., 3])


def _of_union(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    both = _overlap(one, other)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both == 0, 0.0, both / (one[..., 2] * one[..., 3] + other[..., 2] * other[..., 3] - both))


def _near(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rectangles of one image that meet, and some that do not, each once; low and high are (n, 2) corners.

    Rectangles are put into grids whose cells are powers of two: one of a size lies in at most four cells of the grid of
    its size and of each coarser grid, and a pair is sought in the grid of the larger one. A pair is kept in the cell
    of its intersection's corner. No more than _CELLS pairs are held at a time.
    """
    level = np.ceil(np.log2(np.maximum((high - low).max(1), 1.0))).astype(np.int64)
    for k in np.unique(level):
        own = np.nonzero(level <= k)[0]
        cell = float(2**k)
        first, last = np.floor(low[own] / cell).astype(np.int64), np.floor(high[own] / cell).astype(np.int64)
        entries, cells = [], []
        for right in (0, 1):
            for down in (0, 1):
                there = (first[:, 0] + right <= last[:, 0]) & (first[:, 1] + down <= last[:, 1])
                entries.append(own[there])
                cells.append(first[there] + (right, down))
        i, at = np.concatenate(entries), np.concatenate(cells)
        order = np.lexsort((level[i] < k, at[:, 1], at[:, 0], place[i]))  # those of the size first within a cell
        i, at = i[order], at[order]
        fresh = np.concatenate(([True], (np.diff(place[i]) != 0) | (np.diff(at, axis=0) != 0).any(1)))
        starts = np.nonzero(fresh)[0]
        ends = np.append(starts[1:], len(i))[np.cumsum(fresh) - 1]
        counts = np.where(level[i] == k, ends - np.arange(len(i)) - 1, 0)
        sums, start = np.cumsum(counts), 0
        while start < len(i):
            base = sums[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sums, base + _CELLS, "right")))
            some = counts[start:stop]
            one = np.repeat(np.arange(start, stop), some)
            other = one + 1 + np.arange(len(one)) - np.repeat(sums[start:stop] - some - base, some)
            a, b = i[one], i[other]
            corner = np.floor(np.maximum(low[a], low[b]) / cell).astype(np.int64)
            kept = (corner == at[one]).all(1)
            yield a[kept], b[kept]
            start = stop


def _counted(place: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For each box the boxes of its image, itself included, that it overlaps by more than threshold of the smaller area."""
    order = np.lexsort((b[:, 3], b[:, 2], b[:, 1], b[:, 0], place))
    fresh = np.concatenate(([True], (np.diff(place[order]) != 0) | (np.diff(b[order], axis=0) != 0).any(1)))
    number = np.empty(len(b), np.int64)
    number[order] = np.cumsum(fresh) - 1  # equal boxes count as one with a weight
    first = order[fresh]
    text, weight = b[first], np.bincount(number)
    votes = np.where(_of_smaller(text, text) > threshold, weight, 0).astype(np.int64)
    for i, j in _near(place[first], text[:, :2], text[:, :2] + text[:, 2:]):
        met = _of_smaller(text[i], text[j]) > threshold
        i, j = i[met], j[met]
        votes += np.bincount(i, weight[j], len(text)).astype(np.int64) + np.bincount(j, weight[i], len(text)).astype(np.int64)
    return votes[number]


class _Leaders:
    """Boxes by the grid cells of their size and of each larger size, so that a box meets only leaders near it."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.own, self.upto = sizes, {}, {}

    @staticmethod
    def _cells(box: tuple[int, int, int, int], cell: int) -> Iterator[tuple[int, int]]:
        x, y, w, h = box
        return ((gx, gy) for gx in range(x // cell, (x + w) // cell + 1) for gy in range(y // cell, (y + h) // cell + 1))

    def add(self, number: int, box: tuple[int, int, int, int], size: int) -> None:
        for s in self.sizes:
            if s >= size:
                for at in self._cells(box, s):
                    self.upto.setdefault((s, *at), []).append(number)
                    if s == size:
                        self.own.setdefault((s, *at), []).append(number)

    def near(self, box: tuple[int, int, int, int], size: int) -> set[int]:
        """Leaders up to a size by the cells of that size, larger ones by the cells of theirs."""
        found: set[int] = set()
        for s in self.sizes:
            if s >= size:
                held = self.upto if s == size else self.own
                for at in self._cells(box, s):
                    found.update(held.get((s, *at), ()))
        return found


def _leading(b: np.ndarray, measure, threshold: float) -> tuple[list[int], np.ndarray]:
    """Boxes that no earlier leader overlaps, and for each box the number of the first leader that overlaps it, its own for a leader."""
    leaders, owner = [], np.empty(len(b), np.int64)
    if len(b) <= _FEW:
        for k, row in enumerate(measure(b[:, None], b[None]) > threshold):
            met = row[leaders]
            owner[k] = at = int(met.argmax()) if met.any() else len(leaders)
            if at == len(leaders):
                leaders.append(k)
        return leaders, owner
    sizes = (2 ** np.ceil(np.log2(np.maximum(b[:, 2:].max(1), 1)))).astype(np.int64)
    index, rows = _Leaders(sorted(set(sizes.tolist()))), b.tolist()
    for k, (box, size) in enumerate(zip(rows, sizes.tolist())):
        near = np.fromiter(near, np.int64) if (near := index.near(box, size)) else np.empty(0, np.int64)
        met = near[measure(b[[leaders[n] for n in near.tolist()]], b[k]) > threshold] if len(near) else near
        owner[k] = at = int(met.min()) if len(met) else len(leaders)
        if at == len(leaders):
            leaders.append(k)
            index.add(at, box, size)
    return leaders, owner


def merge_boxes(b: np.ndarray, votes: np.ndarray, threshold: float, min_votes: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(x, y, w, h, n): truncated means of the groups of an image's boxes, in the order of their leaders."""
    order = np.lexsort((-np.arange(len(b)), -votes))
    kept = b[order[votes[order] >= min_votes]]
    leaders, owner = _leading(kept, _of_smaller, threshold)
    n = np.bincount(owner, minlength=len(leaders))
    sums = np.zeros((len(leaders), 4), np.int64)
    np.add.at(sums, owner, kept)
    for total, count in zip(sums.tolist(), n.tolist()):
        yield *(int(v / count) for v in total), count


def _whole_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, ordered by image in the first column, cut between images only."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if held and (cut or ids[0] != last):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(img_id, (n, 4) of x, y, w, h) of rows, whose first columns these are."""
    return rows.column(0).to_numpy(), np.stack([rows.column(k).to_numpy() for k in range(1, 5)], axis=1)


def _each_image(ids: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, image, its boxes) of the images, whose rows stand together."""
    starts = np.concatenate(([0], np.nonzero(np.diff(ids))[0] + 1))
    for at, own in zip(starts, np.split(b, starts[1:])):
        yield int(at), int(ids[at]), own


def _per_image(boxes: DataFrame, order: list, columns: list, solve, schema: str) -> DataFrame:
    """solve over whole images (img_id, x, y, w, h and columns) in order; one exchange by image, and a task streams its images.

    Rows with a null among the first five are left out, as they are of no pair either.
    """
    names = ("img_id", "x", "y", "w", "h")
    width = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = boxes.select(*(F.col(c).cast("long").alias(c) for c in names), *columns).dropna(subset=names)
    placed = long.repartition(width, "img_id").sortWithinPartitions("img_id", *order)
    return placed.mapInArrow(lambda batches: (out for rows in _whole_images(batches) for out in solve(rows)), schema)


_MEANS = ("img_id", "group_id", "x", "y", "w", "h", "n")


def _means(columns: list, group_type: pa.DataType) -> pa.RecordBatch:
    types = {"img_id": pa.int64(), "group_id": group_type, "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int32())) for n, c in zip(_MEANS, columns)], names=_MEANS)


def vote_merge(boxes: DataFrame, threshold: float = 0.3, min_votes: int = 3) -> DataFrame:
    """Means, truncated, of groups of boxes: (img_id, group_id, x, y, w, h, n).

    Boxes with fewer than min_votes votes go. By votes, then box_id, both descending, a box leads a group if no leader
    before it overlaps it by more than threshold of the smaller area; else it joins the first that does. One exchange by
    image; the images of a partition are streamed, and boxes meet by grid cells. group_id follows the order of leaders.
    """
    _check(threshold, min_votes)

    return _merged(boxes, threshold, min_votes)


def _merged(boxes: DataFrame, threshold: float, min_votes: int, keep_single: bool = False) -> DataFrame:
    def merge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out = []
        ids, b = _matrix(rows)
        votes = _counted(ids, b, threshold)
        for at, image, own in _each_image(ids, b):
            if keep_single and len(own) == 1:
                out.append((image, 0, *own[0].tolist(), 1))
                continue
            found = merge_boxes(own, votes[at : at + len(own)], threshold, min_votes)
            out += [(image, k, *group) for k, group in enumerate(found)]
        yield _means(list(zip(*out)) or [[]] * 7, pa.int32())

    return _per_image(boxes, ["box_id"], ["box_id"], merge, "img_id long, group_id int, x int, y int, w int, h int, n long")


def suppress_by_score(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The boxes that no kept box of a higher score overlaps by an IoU above threshold; ties go to the lower box_id.

    boxes also has score, null being the lowest; the kept rows come as (img_id, box_id, x, y, w, h, score).
    """
    _check(threshold)

    def keep(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kept = [at + k for at, _, b in _each_image(*_matrix(rows)) for k in _leading(b, _of_union, threshold)[0]]
        yield from rows.take(pa.array(kept, pa.int64())).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = f"img_id long, x long, y long, w long, h long, box_id {kinds['box_id']}, score {kinds['score']}"
    kept = _per_image(boxes, [F.desc_nulls_last("score"), "box_id"], ["box_id", "score"], keep, schema)
    return kept.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("img_id", "box_id", "x", "y", "w", "h", "score")))


def _components(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of size nodes reaches by the edges a, b."""
    least = np.arange(size)
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while not np.array_equal(jumped := least[least], least):
            least = jumped
        differ = least[a] != least[b]
        a, b = a[differ], b[differ]
    return least


def _similar_edges(place: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar boxes of an image. Left upper corners of similar boxes lie within eps of the smaller side, so the parts of that size meet."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i, j in _near(place, b[:, :2], b[:, :2] + eps * b[:, 2:]):
        near = eps * np.minimum(b[i, 2:], b[j, 2:])
        first, last = np.abs(b[i, :2] - b[j, :2]), np.abs(b[i, :2] + b[i, 2:] - b[j, :2] - b[j, 2:])
        same = ((first <= near) & (last <= near)).all(1)
        found.append((i[same], j[same]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def group_boxes(ids: np.ndarray, b: np.ndarray, box_id: np.ndarray, least: int, eps: float) -> list[np.ndarray]:
    """Columns img_id, group_id, x, y, w, h, n of the groups of at least least boxes; rows are ordered by image and box."""
    place = np.concatenate(([0], np.cumsum(np.diff(ids) != 0)))
    fresh = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(b, axis=0) != 0).any(1)))  # equal boxes stand together
    text, own = np.nonzero(fresh)[0], np.cumsum(fresh) - 1
    group = _components(len(text), *_similar_edges(place[text], b[text], eps))[own]
    n = np.bincount(group, minlength=len(text))
    wide = n >= least
    means = [np.rint(np.bincount(group, b[:, k], len(text))[wide] / n[wide]).astype(np.int32) for k in range(4)]
    first = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(first, group, box_id)
    return [ids[text][wide], first[wide], *means, n[wide]]


def group_similar(boxes: DataFrame, least: int = 3, eps: float = 0.2) -> DataFrame:
    """Means, rounded half to even, of connected components of similar boxes with at least least boxes.

    (img_id, group_id, x, y, w, h, n), group_id being the smallest box_id. Components never leave an image, so there is
    one exchange by image; equal boxes of an image count as one with a weight while links are sought.
    """

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, b = _matrix(rows)
        yield _means(group_boxes(ids, b, rows.column(5).to_numpy(), least, eps), pa.int64())

    least = max(least, 1)
    return _per_image(boxes, ["x", "y", "w", "h"], [F.col("box_id").cast("long").alias("box_id")], group, "img_id long, group_id long, x int, y int, w int, h int, n long")


def merge_overlapping(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """vote_merge with three votes, but the only box of an image stays as it is."""
    _check(threshold)
    return _merged(boxes, threshold, 3, keep_single=True)


def merge_in_image(b: np.ndarray, mode: int, threshold: float, min_votes: int) -> list[tuple[int, ...]]:
    """(group_id, x, y, w, h, n) as post_process gives them for the boxes of one image, whose ids are 1, 2, ..."""
    if not len(b):
        return []
    one = np.zeros(len(b), np.int64)
    if mode == 0:
        return [(k, *group) for k, group in enumerate(merge_boxes(b, _counted(one, b, threshold), threshold, min_votes))]
    order = np.lexsort((b[:, 3], b[:, 2], b[:, 1], b[:, 0]))
    columns = group_boxes(one, b[order], order + 1, max(min_votes, 1), 0.2)
    return sorted(zip(*(c.tolist() for c in columns[1:])))


def post_process(boxes: DataFrame, mode: int = 0, threshold: float = 0.3, min_votes: int = 3) -> DataFrame:
    """Mode 0: vote_merge; mode 1: group_similar."""
    if mode not in (0, 1):
        raise ValueError("mode must be 0 or 1")
    return vote_merge(boxes, threshold, min_votes) if mode == 0 else group_similar(boxes, min_votes)


def expand_and_clip(boxes: DataFrame, height: int, width: int, ratio: float = 1.5, least: int = 4) -> DataFrame:
    """Boxes grown about their centres, edges rounded half to even and clipped; without those below least pixels."""
    edge = lambda lo, size, sign: F.rint(F.col(lo) + F.col(size) / 2.0 + sign * F.col(size) * ratio / 2.0).cast("int")
    grown = boxes.select("img_id", "box_id", F.greatest(F.lit(0), edge("x", "w", -1)).alias("x1"), F.greatest(F.lit(0), edge("y", "h", -1)).alias("y1"), F.least(F.lit(width), edge("x", "w", 1)).alias("x2"), F.least(F.lit(height), edge("y", "h", 1)).alias("y2"))
    return grown.where(f"x2 - x1 >= {least} and y2 - y1 >= {least}")


def restore(boxes: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Coordinates times the scales, truncated."""
    scaled = {"x": scale_x, "y": scale_y, "w": scale_x, "h": scale_y}
    return boxes.select("img_id", "box_id", *((F.col(c) * s).cast("int").alias(c) for c, s in scaled.items()))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int = 32) -> DataFrame:
    """(img_id, point_id, box_id) of each point (img_id, point_id, px, py) in a box, edges included, by grid cells."""
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    cells = boxes.select("img_id", "box_id", "x", "y", "w", "h").withColumn("gx", F.explode(span("x", "w"))).withColumn("gy", F.explode(span("y", "h")))
    placed = points.withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell))
    return placed.join(cells, ["img_id", "gx", "gy"]).where("px between x and x + w and py between y and y + h").select("img_id", "point_id", "box_id")
