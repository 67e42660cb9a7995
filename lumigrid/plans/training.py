"""Training of a cascade, stage by stage."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from lumigrid.operators.boost import Strong, booster, score
from lumigrid.operators.cascade import Stage, Weak, evaluate, growth_schedule, refill_negatives, survivors
from lumigrid.operators.mining import mine_negatives
from lumigrid.operators.windows import patch_features
from lumigrid.session import materialize


@dataclass(frozen=True)
class CascadeTrainConfig:
    """Targets of the whole cascade and of a stage; what to do where a stage stalls: continue, rollback or stop."""

    target_fpr: float = 0.01
    stage_fpr: float = 0.60
    stage_dr: float = 0.99
    most_stumps: int = 400
    most_stages: int = 20
    step: float = 0.05
    least_threshold: float = -100.0
    on_stall: str = "continue"

    def __post_init__(self):
        if self.on_stall not in ("continue", "rollback", "stop"):
            raise ValueError("on_stall must be continue, rollback or stop")


@dataclass(frozen=True)
class Trial:
    model: Strong
    dr: float
    fpr: float


def train_cascade(positives: DataFrame, negatives: DataFrame, validation: DataFrame, cfg: CascadeTrainConfig = CascadeTrainConfig(), mine: Callable[[list[Strong]], DataFrame] | None = None, done: Sequence[Strong] = (), keep: Callable[[list[Strong]], None] | None = None) -> list[Strong]:
    """Stages over samples (sample_id, y, x).

    A stage starts with the size of the one before, at least 2, and grows until the cascade on the validation samples
    keeps stage_dr of its detection rate and at most stage_fpr of its false positive rate; its threshold is lowered
    first. A second try that is worse, or a third that is no better, brings back the first. A stage that would reach
    most_stumps is given up and training ends. After a stage, negatives are mined, or refilled where mine finds none.

    keep gets the stages after each stage, to store them; done are stages of an earlier training on the same samples,
    which goes on after them as if it had not ended, if mine finds the same for the same stages.
    """

    def harder(pool: DataFrame, stages: list[Strong]) -> DataFrame:
        mined = mine(stages) if mine else None
        if mined is not None and not mined.isEmpty():
            return mined
        ids = refill_negatives(pool, stages).select(F.col("sample_id").alias("_id"))
        return pool.join(ids, pool["sample_id"] == ids["_id"]).drop("_id")

    stages, pool = list(done), negatives
    for k in range(len(stages)):
        pool = harder(pool, stages[: k + 1])
    dr, fpr = evaluate(validation, stages) if stages else (1.0, 1.0)
    while fpr > cfg.target_fpr and len(stages) < cfg.most_stages:
        goal_dr, goal_fpr = cfg.stage_dr * dr, cfg.stage_fpr * fpr
        history: list[Trial] = []
        chosen: Trial | None = None
        n = max(2, len(stages[-1].stumps)) if stages else 2
        rows = positives.select("sample_id", "y", "x").unionByName(pool.select("sample_id", "y", "x"))
        with booster(rows) as train:
            while chosen is None:
                model = train(n, model.stumps if history else ())
                trial = _lower(model, stages, validation, goal_dr, cfg)
                history.append(trial)
                if trial.fpr <= goal_fpr and trial.dr >= goal_dr:
                    chosen = trial
                elif len(history) == 2 and trial.fpr > history[0].fpr or len(history) == 3 and trial.fpr >= history[1].fpr:
                    chosen = history[0]
                else:
                    after = growth_schedule(cfg.most_stumps, n)[1:2]
                    if not after:
                        return stages
                    n = after[0]
                    if cfg.on_stall != "continue":
                        chosen = min(history, key=lambda t: t.fpr)
        stages.append(chosen.model)
        dr, fpr = chosen.dr, chosen.fpr
        if keep:
            keep(stages)
        if cfg.on_stall == "stop" and fpr > goal_fpr:
            return stages
        pool = harder(pool, stages)
    return stages


def _lower(model: Strong, stages: list[Strong], validation: DataFrame, goal_dr: float, cfg: CascadeTrainConfig) -> Trial:
    """The model with its threshold lowered by steps until the cascade's detection rate reaches the goal.

    One job counts the validation samples by the steps that each needs; there are no more steps than the bounds allow.
    """
    steps = F.ceil((F.lit(model.threshold) - score(F.col("x"), model)) / cfg.step - 1e-9)
    reached = survivors(validation, stages).where(F.col("passed") == len(stages)).select("sample_id") if stages else None
    rows = validation.join(reached, "sample_id", "left_semi") if stages else validation
    totals = {r["y"]: r["count"] for r in validation.groupBy("y").count().collect()}
    counts = {(r["y"], r["step"]): r["count"] for r in rows.groupBy("y", F.greatest(F.lit(0), steps).alias("step")).count().collect()}
    most, k, hits = max(0, math.ceil((model.threshold - cfg.least_threshold) / cfg.step)), 0, {0: 0, 1: 0}
    while True:
        for y in (0, 1):
            hits[y] += counts.get((y, k), 0)
        dr, fpr = (hits[y] / totals[y] if totals.get(y) else 0.0 for y in (1, 0))
        if dr >= goal_dr or k >= most:
            return Trial(replace(model, threshold=model.threshold - k * cfg.step), dr, fpr)
        k += 1


def detection_stages(stages: list[Strong], features: DataFrame) -> list[Stage]:
    """Trained stages as detect and write_model take them: each stump with the descriptor of its feature.

    features: feature_id, ftype, r, c, h, w, feature_id being a feature's place in x. Only the rows that stumps name
    reach the driver. A stump of an unknown feature is an error.
    """
    named = sorted({s.feature_id for stage in stages for s in stage.stumps})
    rows = features.where(F.col("feature_id").isin(named)).select("feature_id", "ftype", "r", "c", "h", "w").collect()
    described = {r["feature_id"]: tuple(r)[1:] for r in rows}
    if missing := [k for k in named if k not in described]:
        raise ValueError(f"unknown features {missing}")
    return [Stage(tuple(Weak(*described[s.feature_id], s.threshold, s.polarity, s.alpha) for s in stage.stumps), stage.threshold) for stage in stages]


def patch_samples(patches: DataFrame, features: DataFrame, y: int, size: int = 24) -> DataFrame:
    """Samples (sample_id, y, x) of patches (img_id, r, c, z): x has all features; ids depend on class and place only.

    Positive samples have even ids, negative ones odd ids; places must be unique and below 32,768.
    """
    place = (F.col("img_id") * (1 << 30) + F.col("r") * (1 << 15) + F.col("c")) * 2 + (1 - y)
    return patch_features(patches.select(place.alias("sample_id"), F.lit(y).alias("y"), "z"), features, size)


def patch_miner(images: DataFrame, features: DataFrame, most: int = 2400, size: int = 24, step: int = 4, seed: int = 42) -> Callable[[list[Strong]], DataFrame]:
    """For train_cascade: after each stage, negatives are the first most patches of images without faces that all stages accept."""

    def mine(stages: list[Strong]) -> DataFrame:
        found = mine_negatives(images, detection_stages(stages, features), most, size=size, step=step, seed=seed)
        return materialize(patch_samples(found, features, 0, size), "mined-samples")

    return mine
