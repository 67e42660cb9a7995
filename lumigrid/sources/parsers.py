"""Text grammars and files of annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumigrid.operators.dataset import first_paths

KEYPOINT_TOKENS = 13
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")


def parse_keypoints(lines: DataFrame, column: str = "line") -> DataFrame:
    """(filename, lx, ly, rx, ry, cx, cy) of each line with a digit and at least 13 tokens whose first four numbers parse.

    The generator keeps filters on tokens above the split, so a line is split once.
    """
    tokens = F.split(F.btrim(column, F.lit(" \t\n\x0b\f\r")), r"\s+")
    number = lambda k: F.get("t", F.lit(k)).try_cast("double")
    rows = lines.where(F.col(column).rlike("[0-9]")).select(F.explode(F.array(tokens)).alias("t")).where(F.size("t") >= KEYPOINT_TOKENS)
    out = rows.select(F.get("t", F.lit(0)).alias("filename"), *(number(k).alias(n) for k, n in enumerate(("lx", "ly", "rx", "ry"), 1)))
    return out.dropna(subset=["lx", "ly", "rx", "ry"]).withColumn("cx", (F.col("lx") + F.col("rx")) / 2).withColumn("cy", (F.col("ly") + F.col("ry")) / 2)


def group_keypoints(points: DataFrame) -> DataFrame:
    """(filename, faces): the faces of a file in one array, in the order of their numbers."""
    face = F.struct(F.array("lx", "ly").alias("left_eye"), F.array("rx", "ry").alias("right_eye"), F.array("cx", "cy").alias("eye_midpoint"))
    return points.groupBy("filename").agg(F.array_sort(F.collect_list(face)).alias("faces"))


FACE_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("left_eye", "right_eye", "eye_midpoint")]))
SUMMARY = T.StructType([
    T.StructField("total_images", T.LongType()), T.StructField("total_faces", T.LongType()), T.StructField("eval_criterion", T.StringType()),
    T.StructField("annotations", T.MapType(T.StringType(), T.StructType([T.StructField("image_path", T.StringType()), T.StructField("faces", FACE_TYPE)]))),
])


def read_summary(spark: SparkSession, text: DataFrame, column: str = "value") -> DataFrame:
    """The annotation envelope from JSON; without a row an empty one."""
    got = text.select(F.from_json(column, SUMMARY).alias("s")).select("s.*")
    empty = spark.createDataFrame([(0, 0, "", {})], SUMMARY)
    return got if not got.isEmpty() else empty


def flatten_summary(summary: DataFrame) -> DataFrame:
    """(filename, image_path, face_idx, face) of an annotation envelope."""
    each = summary.select(F.explode("annotations").alias("filename", "a"))
    return each.select("filename", "a.image_path", F.posexplode("a.faces").alias("face_idx", "face"))


def coco_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The arrays categories, annotations and images of a multi-line JSON file as tables."""
    whole = spark.read.schema("categories array<struct<id:long,name:string>>, annotations array<struct<image_id:long,category_id:long>>, images array<struct<id:long,file_name:string>>").json(path, multiLine=True)
    return {name: whole.select(F.explode(name).alias("e")).select("e.*") for name in whole.columns}


def image_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files below path with the suffix of an image, as Spark's binaryFile source has them."""
    suffixes = ",".join([*IMAGE_SUFFIXES, *map(str.upper, IMAGE_SUFFIXES)])
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{{{suffixes}}}").load(path)


def read_images(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[int, int, list[int]] | None], least: int = 1, recursive: bool = False, first: int | None = None) -> DataFrame:
    """Gray images (path, h, w, px) below path; decode gives height, width and pixels, or None for what it can't read.

    Files of other suffixes, unreadable ones and those smaller than least are left out. first: only so many files by
    path are read; their paths are found without the contents.
    """
    files = image_files(spark, path, recursive)
    if first is not None:
        # at most `first` paths
        files = files.join(F.broadcast(first_paths(files.select("path"), first)), "path", "left_semi")
    schema = pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("px", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = decode(content.as_py())
                if got and min(got[:2]) >= least:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, *got)))], schema=schema)

    return files.select("path", "content").mapInArrow(read, "path string, h int, w int, px array<int>")


def decode_pgm(data: bytes) -> tuple[int, int, list[int]] | None:
    """Binary portable gray maps of one byte a pixel."""
    parts = data.split(maxsplit=4)
    if len(parts) < 4 or parts[0] != b"P5" or not all(p.isdigit() for p in parts[1:4]) or int(parts[3]) > 255:
        return None
    w, h = int(parts[1]), int(parts[2])
    return (h, w, list(data[-w * h :])) if 0 < w * h <= len(data) else None
