"""Cascades of boosted stages: staged filters over samples, windows and frames, and mining of hard negatives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumigrid.functions.geometry import RECTANGLES
from lumigrid.operators import boxes as box_ops
from lumigrid.operators.boost import Strong, classify, confusion
from lumigrid.operators.images import fit
from lumigrid.operators.windows import scale_ladder


@dataclass(frozen=True)
class Weak:
    """A stump over a feature that is given by its descriptor."""

    ftype: int
    r: int
    c: int
    h: int
    w: int
    threshold: float
    polarity: int
    alpha: float


@dataclass(frozen=True)
class Stage:
    weak: tuple[Weak, ...]
    threshold: float


@dataclass(frozen=True)
class DetectorConfig:
    """Parameters of a detection, with their bounds."""

    scale_factor: float = 1.25
    step_factor: float = 3.0
    min_face: int = 24
    max_face: int | None = None
    flat_variance: float = 10.0
    threshold: float = 0.3
    min_votes: int = 3
    mode: int = 0
    step_delta: float = 1.5
    max_dim: int = 640

    def __post_init__(self):
        """step_delta is checked and not used, as step_factor took its place; max_dim 0 leaves all images as they are."""
        bounds = {"scale_factor": (1.01, 3), "step_factor": (0.5, 5), "step_delta": (1, 2), "threshold": (0, 1), "min_votes": (1, 3000), "min_face": (10, 500), "max_face": (10, 2000), "mode": (0, 1), "max_dim": (0, 1 << 20)}
        for name, (low, high) in bounds.items():
            value = getattr(self, name)
            if not (name == "max_face" and value is None) and not low <= value <= high:
                raise ValueError(f"{name} must be within {low} and {high}")


#: Bounds within which settings may be changed while a stream runs; fixed values.
LIVE = {"threshold": (0.0, 1.0), "min_face": (10, 500), "max_face": (50, 2000), "min_votes": (1, 300), "scale_factor": (1.01, 3.0), "step_delta": (1.0, 2.0), "step_factor": (0.5, 5.0)}


def adjusted(cfg: DetectorConfig, **changes) -> DetectorConfig:
    """cfg with changes, each held within its bounds of LIVE; a max_face of None lifts that limit."""
    held = {n: v if v is None or n not in LIVE else min(max(v, LIVE[n][0]), LIVE[n][1]) for n, v in changes.items()}
    return replace(cfg, **held)


def survivors(samples: DataFrame, stages: list[Strong]) -> DataFrame:
    """(sample_id, y, passed): how many stages in a row accept a sample; later stages are not evaluated."""
    passed = F.lit(len(stages))
    for k, stage in reversed(list(enumerate(stages))):
        passed = F.when(classify(F.col("x"), stage) == 0, k).otherwise(passed)
    return samples.select("sample_id", "y", passed.cast("int").alias("passed"))


def evaluate(samples: DataFrame, stages: list[Strong]) -> tuple[float, float]:
    """Detection and false positive rate of the whole cascade."""
    row = confusion(survivors(samples, stages).select("y", (F.col("passed") == len(stages)).cast("int").alias("predicted"))).first()
    return row["dr"], row["fpr"]


def _corners(ii: np.ndarray, r: np.ndarray, c: np.ndarray, h: int, w: int) -> np.ndarray:
    return ii[r + h, c + w] + ii[r, c] - ii[r, c + w] - ii[r + h, c]


def _contrasts(ii: np.ndarray, weak: Weak, scale: float, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The value of one feature in many windows of a scale."""
    r, c = r + round(weak.r * scale), c + round(weak.c * scale)
    h, w = max(1, round(weak.h * scale)), max(1, round(weak.w * scale))
    return sum(sign * _corners(ii, r + down * h, c + across * w, h, w) for sign, down, across in rectangles(weak.ftype))


def rectangles(ftype: int) -> tuple:
    if ftype not in RECTANGLES:
        raise ValueError(f"unknown feature type {ftype}")
    return RECTANGLES[ftype]


def tables_of(px: np.ndarray) -> np.ndarray:
    """Padded summed-area tables of the values and of their squares."""
    tables = np.zeros((2, px.shape[0] + 1, px.shape[1] + 1))
    tables[0, 1:, 1:], tables[1, 1:, 1:] = px.cumsum(0).cumsum(1), (px * px).cumsum(0).cumsum(1)
    return tables


def moments(tables: np.ndarray, r: np.ndarray, c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of square windows."""
    mean = _corners(tables[0], r, c, size, size) / (size * size)
    return mean, np.maximum(0.0, _corners(tables[1], r, c, size, size) / (size * size) - mean * mean)


def judge(stages: list[Stage], n: int, values) -> np.ndarray:
    """Which of n windows all stages accept; values(weak, own) gives a feature for the windows own, those still accepted."""
    own = np.arange(n)
    for stage in stages:
        total = np.zeros(len(own))
        for weak in stage.weak:
            total += np.where(weak.polarity * values(weak, own) < weak.polarity * weak.threshold, weak.alpha, 0.0)
        own = own[total >= stage.threshold]
    return own


def scan_scales(px: np.ndarray, stages: list[Stage], cfg: DetectorConfig) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(win, r, c) for each scale: the windows that are not flat and that all stages accept, by row and column."""
    height, width = px.shape
    tables = tables_of(px)
    for _, scale, win in scale_ladder(height, width, cfg.scale_factor, cfg.min_face, cfg.max_face):
        step = max(1, round(scale * cfg.step_factor))
        r, c = np.meshgrid(np.arange(0, height - win - 3, step), np.arange(0, width - win - 3, step), indexing="ij")
        r, c = r.ravel(), c.ravel()
        _, var = moments(tables, r, c, win)
        alive = (var >= cfg.flat_variance) & (var >= 1e-4)
        r, c, norm = r[alive], c[alive], 1.0 / (scale * scale * np.sqrt(var[alive]))
        kept = judge(stages, len(r), lambda weak, own: _contrasts(tables[0], weak, scale, r[own], c[own]) * norm[own])  # noqa: B023
        yield win, r[kept], c[kept]


def scan_image(px: np.ndarray, stages: list[Stage], cfg: DetectorConfig) -> list[tuple[int, int, int]]:
    """(r, c, win) of the windows that are not flat and that all stages accept, by scale, row, column.

    Each stage sees only the windows that the stages before it accepted.
    """
    return [(int(y), int(x), win) for win, r, c in scan_scales(px, stages, cfg) for y, x in zip(r, c)]


def accepted_windows(images: DataFrame, stages: list[Stage], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The windows of images (img_id, h, w, px) that the cascade accepts, as boxes with ids in the order of scan_image.

    An image is scanned where it is: nothing is joined or shuffled, and images may differ in size.
    """
    names = ("img_id", "box_id", "x", "y", "w", "h")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img_id, h, w, px in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if px.values is None:
                    continue
                found = scan_image(np.asarray(px.values, np.float64).reshape(h, w), stages, cfg)
                rows += [(img_id, k, c, r, win, win) for k, (r, c, win) in enumerate(found, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), schema=schema)

    return images.select(F.col("img_id").cast("long"), "h", "w", "px").mapInArrow(scan, ", ".join(f"{n} long" for n in names))


def detect(images: DataFrame, stages: list[Stage], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(img_id, group_id, x, y, w, h, n): merged boxes of the windows that the cascade accepts.

    An image is scanned, and its boxes are merged, where it is: there is no join and no exchange. Images with a side
    above cfg.max_dim are made smaller first, and their boxes are given in the original's coordinates, truncated. Images
    without pixels have no boxes.
    """
    schema = pa.schema([("img_id", pa.int64()), ("group_id", pa.int64() if cfg.mode else pa.int32()), *((n, pa.int32()) for n in "xywh"), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img_id, h, w, px in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if px.values is None:
                    continue
                small, factor = fit(np.asarray(px.values, np.float64).reshape(h, w), cfg.max_dim)
                b = np.array([(c, r, win, win) for r, c, win in scan_image(small, stages, cfg)], np.int64).reshape(-1, 4)
                for group_id, *box, n in box_ops.merge_in_image(b, cfg.mode, cfg.threshold, cfg.min_votes):
                    rows.append((img_id, group_id, *(int(v / factor) for v in box), n))
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    group = "long" if cfg.mode else "int"
    return images.select(F.col("img_id").cast("long"), "h", "w", "px").mapInArrow(run, f"img_id long, group_id {group}, x int, y int, w int, h int, n long")


def growth_schedule(most: int, start: int = 2) -> list[int]:
    """Numbers of stumps that a stage tries: twice below 10, half more below 30, 25 more below 100, then 50 more.

    A number that reaches most ends the schedule and is not tried.
    """
    out, n = [], start
    while n < most:
        out.append(n)
        n = min(n * 2 if n < 10 else int(n * 1.5) if n < 30 else n + 25 if n < 100 else n + 50, most)
    return out


def growth_schedules(limits: DataFrame, largest: int = 1 << 20) -> DataFrame:
    """limits (most, more columns) with attempt and n for each size that a stage tries below most.

    The sizes are the same for all limits; most bounds how many there are. largest: what no limit exceeds.
    """
    sizes = F.array(*map(F.lit, growth_schedule(min(largest, limits.agg(F.max("most")).first()[0] or 0)))).cast("array<int>")
    return limits.select("*", F.posexplode(F.filter(sizes, lambda n: n < F.col("most"))).alias("attempt", "n"))


def hard_negatives(samples: DataFrame, stages: list[Strong], most: int | None = 2400) -> DataFrame:
    """Negative samples that all stages accept: at most most, by hash of sample_id, or all of them for None."""
    passed = survivors(samples.where("y = 0"), stages).where(F.col("passed") == len(stages)).select("sample_id")
    return passed if most is None else passed.orderBy(F.xxhash64("sample_id"), "sample_id").limit(most)


def refill_negatives(negatives: DataFrame, stages: list[Strong], least: int = 200, upto: int = 500, seed: int = 42) -> DataFrame:
    """The negatives that all stages accept; below least of them, sampled negatives are added up to upto.

    (sample_id, origin); added rows may repeat accepted ones, as each is drawn from all negatives.
    """
    hard = survivors(negatives, stages).where(F.col("passed") == len(stages)).select("sample_id", F.lit("hard").alias("origin"))
    n = hard.count()
    if n >= least:
        return hard
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("sample_id").cast("string")))
    drawn = negatives.select("sample_id").orderBy(order, "sample_id").limit(upto - n)
    return hard.unionByName(drawn.withColumn("origin", F.lit("refill")))
