"""Decision stumps, boosting, scores and thresholds.

Samples are wide: sample_id, y (1 or 0), x (array<double>, a number for each feature). A stump votes 1 where
polarity * value < polarity * threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumigrid.operators.dataset import numbered
from lumigrid.session import Scratch


@dataclass(frozen=True)
class Stump:
    feature_id: int
    threshold: float
    polarity: int
    alpha: float = 0.0
    error: float = 0.0


@dataclass(frozen=True)
class Strong:
    stumps: tuple[Stump, ...]
    threshold: float


def initial_weights(samples: DataFrame) -> DataFrame:
    """(sample_id, y, weight): half of all weight for either class."""
    return _start(samples.select("sample_id", "y"), "weight")


def _start(samples: DataFrame, name: str) -> DataFrame:
    """samples with the first weight; the classes are counted apart, so no sample is moved."""
    sizes = samples.groupBy(F.col("y").alias("_y")).agg((1.0 / (2.0 * F.count("*"))).alias(name))
    return samples.join(F.broadcast(sizes), samples["y"].eqNullSafe(sizes["_y"])).drop("_y")


def stumps(weighted: DataFrame) -> DataFrame:
    """The best stump (feature_id, threshold, polarity, error) of each feature, from samples with a weight.

    Values are sorted once for each feature, ties by sample_id; running sums give the error of a cut behind each row.
    The first row of least error wins. All windows share one exchange and one sort.
    """
    long = weighted.select("sample_id", "y", "weight", F.posexplode("x").alias("feature_id", "v"))
    own = Window.partitionBy("feature_id")
    order = own.orderBy("v", "sample_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    positive, negative = F.when(F.col("y") == 1, F.col("weight")).otherwise(0.0), F.when(F.col("y") == 1, 0.0).otherwise(F.col("weight"))
    cut = long.select(
        "feature_id", "v", F.lead("v").over(order).alias("next"), F.row_number().over(order).alias("at"),
        F.sum(positive).over(upto).alias("sp"), F.sum(negative).over(upto).alias("sn"), F.sum(positive).over(every).alias("tp"), F.sum(negative).over(every).alias("tn"),
    )
    e1, e2 = F.round(F.col("sp") + (F.col("tn") - F.col("sn")), 12), F.round(F.col("sn") + (F.col("tp") - F.col("sp")), 12)
    judged = cut.select("feature_id", F.least(e1, e2).alias("error"), "at", F.when(e1 < e2, -1).otherwise(1).alias("polarity"), F.when(F.col("next").isNull(), F.col("v") + 0.5).otherwise(0.5 * (F.col("v") + F.col("next"))).alias("threshold"))
    best = judged.groupBy("feature_id").agg(F.min_by(F.struct("threshold", "polarity", "error"), F.struct("error", "at")).alias("best"))
    return best.select("feature_id", "best.threshold", "best.polarity", "best.error")


def best_stump(found: DataFrame) -> DataFrame:
    """The row of least error; of equal ones the lowest feature_id."""
    return found.groupBy().agg(F.min_by(F.struct("feature_id", "threshold", "polarity", "error"), F.struct("error", "feature_id")).alias("best")).select("best.*").where("feature_id is not null")


def vote(x: Column, stump: Stump) -> Column:
    return stump.polarity * F.get(x, F.lit(stump.feature_id)) < stump.polarity * stump.threshold


#: Samples up to which their weights are broadcast to the sorted features; more are joined and sorted in each round.
_SAMPLES = 1 << 22
#: Values of a feature that one row of the sorted store holds.
_CHUNK = 1 << 16
#: Rows of the store up to which what precedes each is broadcast.
_ROWS = 200_000


def _pack(chunk: int):
    """Rows (feature_id, v, position) that come in order, as rows of up to chunk values of one feature."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, now, part = TaskContext.get().partitionId(), [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                v, s = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([task], pa.int32()), pa.array([part], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (v, s))], names=["feature_id", "range", "part", "v", "s"])
                held.clear()

        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a feature without a value")
            feature, v, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            start = 0
            while start < len(feature):
                if feature[start] != now or sum(len(h[0]) for h in held) >= chunk:
                    yield from flush()
                    part, now = part + 1, int(feature[start])
                room = chunk - sum(len(h[0]) for h in held)
                stop = min(start + room, start + int(np.searchsorted(feature[start:], now, "right")))
                held.append((v[start:stop].astype(np.float64), s[start:stop].astype(np.int32)))
                start = stop
        yield from flush()

    return pack


class SortedFeatures:
    """The features of samples (sample_id, y, x), each sorted once and stored, for many rounds of boosting.

    A row of the store holds a run of a feature's values in order and the numbers of their samples. A round brings the
    weights to the store: no value is moved or sorted again. Features with more values than a row holds are cut into
    ranges, whose weights are summed first so that each range knows what precedes it. Ties are in the order of
    sample_id; a null value or sample_id is an error. Samples may repeat.
    """

    def __init__(self, samples: DataFrame):
        self.spark, self.scratch = samples.sparkSession, Scratch(samples.sparkSession)
        # the row number is stored, so it stays if a task runs again
        own = self.scratch.table(samples.select("sample_id", "y", "x").withColumn("row", F.monotonically_increasing_id()), "samples")
        ids = self.scratch.table(numbered(own.select("row", "y"), "row").select("row", "y", F.col("position").cast("int").alias("position")), "numbered")
        arrays = ids.select("position", "y").toArrow()  # no more than _SAMPLES rows
        self.y = np.zeros(arrays.num_rows, bool)
        self.y[arrays["position"].to_numpy()] = arrays["y"].to_numpy() == 1
        long = own.join(F.broadcast(ids.select("row", "position")), "row").select("sample_id", "position", F.posexplode("x").alias("feature_id", "v"))
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.cut = len(self.y) > _CHUNK
        dealt = long.repartitionByRange(width, "feature_id", "v", "sample_id", "position") if self.cut else long.repartition(width, "feature_id")
        ordered = dealt.sortWithinPartitions("feature_id", "v", "sample_id", "position").select("feature_id", "v", "position")
        self.rows = self.scratch.table(ordered.mapInArrow(_pack(_CHUNK), "feature_id int, range int, part int, v array<double>, s array<int>"), "sorted-features")

    def clear(self) -> None:
        self.scratch.clear()

    def first_weights(self) -> np.ndarray:
        """Half of all weight for either class."""
        n = np.bincount(self.y, minlength=2)
        return np.where(self.y, 0.5 / max(n[1], 1), 0.5 / max(n[0], 1))

    def votes(self, stump: Stump) -> np.ndarray:
        """Whether the stump votes for each sample, by its number; only the rows of its feature are read."""
        own = self.rows.where(F.col("feature_id") == stump.feature_id).select("v", "s")
        hit = F.filter(F.arrays_zip("v", "s"), lambda p: stump.polarity * p["v"] < stump.polarity * stump.threshold)
        found = own.select(F.explode(F.transform(hit, lambda p: p["s"])).alias("s")).toArrow()["s"]
        out = np.zeros(len(self.y), bool)
        out[found.to_numpy()] = True
        return out

    def judged(self, weights: np.ndarray) -> DataFrame:
        """The best cut of each row of the store: feature_id, error, range, part, at, threshold, polarity."""
        shared, totals = self.spark.sparkContext.broadcast((weights, self.y)), (float(weights[self.y].sum()), float(weights[~self.y].sum()))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, y = shared.value
            for batch in batches:
                s = [x.values.to_numpy() for x in batch.column(4)]
                made = [pa.array([float(x.values[0].as_py()) for x in batch.column(3)]), pa.array([float(w[x][y[x]].sum()) for x in s]), pa.array([float(w[x][~y[x]].sum()) for x in s])]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + made, names=["feature_id", "range", "part", "first", "p", "n"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (w, y), out = shared.value, []
            for batch in batches:
                for feature, rng, part, v, s, p0, n0, after in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), *(batch.column(k).to_pylist() for k in (5, 6, 7))):
                    v, s = v.values.to_numpy(), s.values.to_numpy()
                    sp, sn = p0 + np.cumsum(np.where(y[s], w[s], 0.0)), n0 + np.cumsum(np.where(y[s], 0.0, w[s]))
                    e1, e2 = np.round(sp + (totals[1] - sn), 12), np.round(sn + (totals[0] - sp), 12)
                    at = int(np.minimum(e1, e2).argmin())
                    following = v[at + 1] if at + 1 < len(v) else after
                    out.append((feature, float(min(e1[at], e2[at])), rng, part, at, float(v[at] + 0.5 if following is None else 0.5 * (v[at] + following)), -1 if e1[at] < e2[at] else 1))
                kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=["feature_id", "error", "range", "part", "at", "threshold", "polarity"])
                out = []

        self.shared = shared
        if self.cut:
            each = self.scratch.table(self.rows.mapInArrow(sums, "feature_id int, range int, part int, first double, p double, n double"), "range-sums")
            order = Window.partitionBy("feature_id").orderBy("range", "part")
            upto = order.rowsBetween(Window.unboundedPreceding, -1)
            before = each.select("feature_id", "range", "part", F.coalesce(F.sum("p").over(upto), F.lit(0.0)).alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0.0)).alias("n"), F.lead("first").over(order).alias("after"))
            rows = self.rows.join(F.broadcast(before) if each.count() <= _ROWS else before, ["feature_id", "range", "part"])
        else:
            rows = self.rows.select("*", F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("after"))
        return rows.select("feature_id", "range", "part", "v", "s", "p", "n", "after").mapInArrow(scan, "feature_id int, error double, range int, part int, at int, threshold double, polarity int")

    def stumps(self, weights: np.ndarray) -> DataFrame:
        """As stumps gives them, for normalised weights by the samples' numbers."""
        best = self.judged(weights).groupBy("feature_id").agg(F.min_by(F.struct("threshold", "polarity", "error"), F.struct("error", "range", "part", "at")).alias("best"))
        return best.select("feature_id", "best.threshold", "best.polarity", "best.error")

    def train(self, rounds: int, found: tuple[Stump, ...] = ()) -> Strong:
        """Boosted stumps; found are those of an earlier training on the same samples, which goes on from there."""
        found, weights = list(found), self.first_weights()

        def reweigh(s: Stump) -> None:
            np.multiply(weights, math.exp(-s.alpha), out=weights, where=self.votes(s) == self.y)

        for s in found if len(found) < rounds else ():
            reweigh(s)
        while len(found) < rounds and weights.sum() > 0:
            weights /= weights.sum()
            names = ("feature_id", "threshold", "polarity", "error")
            first = F.struct("error", "feature_id", "range", "part", "at")
            best = self.judged(weights).groupBy().agg(F.min_by(F.struct(*names), first).alias("best")).select("best.*").first()
            self.shared.destroy()
            if best is None or best["feature_id"] is None:
                break
            found.append(_weighed(best))
            if len(found) < rounds:
                reweigh(found[-1])
        return Strong(tuple(found), 0.5 * sum(s.alpha for s in found))


def _weighed(best) -> Stump:
    error = min(max(best["error"], 1e-10), 1 - 1e-10)
    return Stump(best["feature_id"], best["threshold"], best["polarity"], math.log((1 - error) / error), error)


def train(samples: DataFrame, rounds: int, found: tuple[Stump, ...] = ()) -> Strong:
    """Boosted stumps of samples (sample_id, y, x); the threshold is half the sum of the alphas.

    found: stumps of an earlier training on the same samples, which goes on from there. Features are sorted once, see
    SortedFeatures; beyond _SAMPLES samples, whose weights no task should hold, each round sorts them again.
    """
    with booster(samples) as own:
        return own(rounds, found)


@contextmanager
def booster(samples: DataFrame) -> Iterator[Callable[[int, tuple[Stump, ...]], Strong]]:
    """A function (rounds, found) that trains on samples as train does; what it stores goes at the end."""
    if samples.limit(_SAMPLES + 1).count() <= _SAMPLES:
        store = SortedFeatures(samples)
        try:
            yield store.train
        finally:
            store.clear()
    else:
        yield lambda rounds, found=(): _train_by_sorting(samples, rounds, found)


def _train_by_sorting(samples: DataFrame, rounds: int, found: tuple[Stump, ...] = ()) -> Strong:
    """Weights after a round follow from the stumps so far, so each round reads the samples as they are; no lineage grows."""
    start = _start(samples.select("sample_id", "y", "x"), "w0").persist()
    try:
        found = list(found)
        while len(found) < rounds:
            weight = F.col("w0")
            for s in found:
                weight = weight * F.when(vote(F.col("x"), s) == (F.col("y") == 1), math.exp(-s.alpha)).otherwise(1.0)
            total = start.agg(F.sum(weight)).first()[0]
            if not total:
                break
            best = best_stump(stumps(start.select("sample_id", "y", "x", (weight / total).alias("weight")))).first()
            if best is None:
                break
            found.append(_weighed(best))
    finally:
        start.unpersist()
    return Strong(tuple(found), 0.5 * sum(s.alpha for s in found))


def score(x: Column, strong: Strong) -> Column:
    """The sum of the alphas that vote."""
    return sum((F.when(vote(x, s), s.alpha).otherwise(0.0) for s in strong.stumps), F.lit(0.0))


def classify(x: Column, strong: Strong) -> Column:
    return (score(x, strong) >= strong.threshold).cast("int")


def confusion(predicted: DataFrame) -> DataFrame:
    """Counts and rates of predicted (y, predicted): tp, fp, fn, tn, dr, fpr; a rate of nothing is 0."""
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("predicted") == p))
    counts = predicted.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    return counts.select("*", rate("tp", "fn").alias("dr"), rate("fp", "tn").alias("fpr"))


def tune_threshold(scored: DataFrame, target: float = 0.99) -> DataFrame:
    """The highest positive score as threshold whose detection rate reaches target: (threshold, dr, fpr).

    scored: y, score. Equal scores count together. Where none reaches the target, the highest positive score; no row
    where no sample is positive. Rows without a score count for nothing.

    Scores are counted first and dealt by ranges; the ranges' totals, one row each, give what stands above each range,
    so every task sums only its own scores.
    """
    spark, scratch = scored.sparkSession, Scratch(scored.sparkSession)
    counts = scored.where("score is not null").groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number of a task is stored, as ranges may differ if they are drawn again
    dealt = scratch.table(counts.repartitionByRange(width, F.desc("score")).withColumn("range", F.spark_partition_id()), "scores")
    totals = dealt.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("range").collect()
    offsets, p, n = [], 0, 0
    for r in totals:
        offsets.append((r["range"], p, n))
        p, n = p + r["p"], n + r["n"]
    above = F.broadcast(spark.createDataFrame(offsets, "range int, p0 long, n0 long"))
    upto = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("range", "score", "p", F.sum("p").over(upto).alias("sp"), F.sum("n").over(upto).alias("sn")).where("p > 0").join(above, "range")
    share = lambda own, before, total: ((F.col(own) + F.col(before)) / float(total) if total else F.lit(0.0))
    rated = summed.select("score", share("sp", "p0", p).alias("dr"), share("sn", "n0", n).alias("fpr"))
    best = rated.agg(F.max_by(F.struct("score", "dr", "fpr"), F.struct(F.col("dr") >= target, "score")).alias("b")).select("b.*").first()
    scratch.clear()
    return spark.createDataFrame([tuple(best)] if best["score"] is not None else [], "threshold double, dr double, fpr double")
