"""Cascade models, feature caches and annotation summaries as Parquet and JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.operators.boost import Strong, Stump
from lumigrid.operators.cascade import Stage, Weak

_MODEL = "stage int, seq int, ftype int, r int, c int, h int, w int, threshold double, polarity int, alpha double, stage_threshold double"


def write_model(spark: SparkSession, stages: list[Stage], path: str) -> None:
    """One row for each weak classifier, with its feature's descriptor and its stage's threshold."""
    rows = [(k, n, x.ftype, x.r, x.c, x.h, x.w, x.threshold, x.polarity, x.alpha, s.threshold) for k, s in enumerate(stages) for n, x in enumerate(s.weak)]
    spark.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> list[Stage]:
    rows = spark.read.schema(_MODEL).parquet(path).orderBy("stage", "seq").collect()
    names = ("ftype", "r", "c", "h", "w", "threshold", "polarity", "alpha")
    return [Stage(tuple(Weak(*(r[n] for n in names)) for r in rows if r["stage"] == k), next(r["stage_threshold"] for r in rows if r["stage"] == k)) for k in sorted({r["stage"] for r in rows})]


_STAGE = "seq int, feature_id int, threshold double, polarity int, alpha double, error double, stage_threshold double"


def write_stages(spark: SparkSession, stages: list[Strong], path: str) -> None:
    """Stages of a training that goes on: the last one as a folder of its own; those before are there already."""
    last = stages[-1]
    rows = [(n, s.feature_id, s.threshold, s.polarity, s.alpha, s.error, last.threshold) for n, s in enumerate(last.stumps)]
    spark.createDataFrame(rows, _STAGE).coalesce(1).write.mode("overwrite").parquet(f"{path}/stage={len(stages) - 1}")


def read_stages(spark: SparkSession, path: str) -> list[Strong]:
    """The stages that write_stages stored; none where path does not exist."""
    try:
        rows = spark.read.schema(f"{_STAGE}, stage int").parquet(path).orderBy("stage", "seq").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    by_stage: dict[int, list] = {}
    for r in rows:
        by_stage.setdefault(r["stage"], []).append(r)
    stump = lambda r: Stump(*(r[n] for n in ("feature_id", "threshold", "polarity", "alpha", "error")))
    return [Strong(tuple(map(stump, own)), own[0]["stage_threshold"]) for own in by_stage.values()]


def cache_path(root: str, config: dict) -> str:
    """A folder that depends on the configuration, so a cache of another one is never read."""
    return f"{root}/features-{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"


def cached_features(spark: SparkSession, root: str, config: dict, compute) -> DataFrame:
    """The cached table of this configuration; an absent or unfinished one is computed and written by split and y."""
    path = cache_path(root, config)
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        compute().write.mode("overwrite").partitionBy("split", "y").parquet(path)
    return spark.read.parquet(path)


def write_split(rows: DataFrame, path: str, targets: dict[str, int]) -> bool:
    """Write rows by split unless path already has as many rows of each split as targets; whether it was written."""
    spark = rows.sparkSession
    try:
        have = {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = {}
    if all(have.get(s, 0) >= n for s, n in targets.items()):
        return False
    rows.write.mode("overwrite").partitionBy("split").parquet(path)
    return True


def read_split(spark: SparkSession, path: str, split: str, most: int | None = None) -> DataFrame:
    """Rows of one split, the first most by name."""
    if split not in ("train", "val"):
        raise ValueError("split must be train or val")
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return rows if most is None else rows.orderBy("name").limit(most)


def load_pair(spark: SparkSession, positives: str, negatives: str, split: str, most_positive: int | None = None, most_negative: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The positive and the negative rows of a split, from two folders that write_split wrote."""
    return read_split(spark, positives, split, most_positive), read_split(spark, negatives, split, most_negative)


def envelopes(grouped: DataFrame, folder: str, criterion: str, per: int = 10_000) -> DataFrame:
    """Annotation envelopes as JSON text (value), about per files of grouped (filename, faces) in each.

    Each has the totals over all of them, so a reader of any knows what is there; read_summary reads them all. filename
    must be unique. No files give one envelope without annotations.
    """
    spark = grouped.sparkSession
    images, faces = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size("faces")), F.lit(0))).first()
    head = (F.lit(images).cast("long").alias("total_images"), F.lit(faces).cast("long").alias("total_faces"), F.lit(criterion).alias("eval_criterion"))
    if not images:
        return spark.range(1).select(F.to_json(F.struct(*head, F.create_map().cast("map<string,string>").alias("annotations"))).alias("value"))
    entry = F.struct("filename", F.struct(F.concat(F.lit(folder + "/"), "filename").alias("image_path"), "faces"))
    part = F.pmod(F.xxhash64("filename"), F.lit(-(-images // per)))
    each = grouped.groupBy(part.alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("annotations"))
    return each.select(F.to_json(F.struct(*head, "annotations")).alias("value"))


def summary(grouped: DataFrame, folder: str, criterion: str) -> DataFrame:
    """Counts of (filename, faces) rows and the envelope as JSON text, a row for each file."""
    entry = F.struct(F.concat(F.lit(folder + "/"), "filename").alias("image_path"), "faces")
    return grouped.select("filename", F.size("faces").alias("n_faces"), F.to_json(F.struct(F.lit(criterion).alias("eval_criterion"), entry.alias("annotation"))).alias("json"))
