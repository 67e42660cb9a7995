"""Images, frames, samples, boxes and annotations as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumigrid.session import table

SIDE = 8
FRAME_TILES = 8


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray patches (img_id, label, px array<int>, row-major), quantised from the 64 numbers of an embedding."""
    quantised = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "label", quantised.alias("px"))


def pixels(images: DataFrame, width: int = SIDE) -> DataFrame:
    """Long form (img_id, r, c, v) of images (img_id, px)."""
    long = images.select("img_id", F.posexplode("px").alias("at", "v"))
    return long.select("img_id", (F.col("at") / width).cast("int").alias("r"), (F.col("at") % width).alias("c"), F.col("v").cast("long").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 mosaics (img_id, h, w, px) of 64 consecutive patches each; patches that are not there are black."""
    n, side = FRAME_TILES * FRAME_TILES, SIDE * FRAME_TILES
    tile = (F.col("img_id") % n).cast("int")
    grouped = patches(spark, sf_dir).groupBy((F.col("img_id") / n).cast("long").alias("frame_id")).agg(F.collect_list(F.struct(tile.alias("tile"), "px")).alias("own"))
    missing = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: ~F.exists("own", lambda t: t["tile"] == k))
    black = F.transform(missing, lambda k: F.struct(k.alias("tile"), F.array_repeat(F.lit(0), SIDE * SIDE).alias("px")))
    tiles = grouped.select("frame_id", F.array_sort(F.concat("own", black)).alias("tiles"))
    row = lambda r: F.flatten(F.transform(F.slice("tiles", (r / SIDE).cast("int") * FRAME_TILES + 1, FRAME_TILES), lambda t: F.slice(t["px"], r % SIDE * SIDE + 1, SIDE)))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), row))
    return tiles.select(F.col("frame_id").alias("img_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), px.alias("px"))


def samples(spark: SparkSession, sf_dir: str, positive: int = 3) -> DataFrame:
    """Samples (sample_id, y, x array<double>) of which one label is positive."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") == positive).cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (img_id, box_id, x, y, w, h, score) by fixed arithmetic on lineitem."""
    img = (F.col("l_orderkey") / 10).cast("long")
    order = Window.partitionBy("img_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    side = (24 + F.col("l_linenumber") % 5 * 6).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("img_id", img)
    return rows.select("img_id", F.row_number().over(order).cast("long").alias("box_id"), (F.col("l_partkey") * 37 % 160).alias("x"), (F.col("l_suppkey") * 53 % 160).alias("y"), side.alias("w"), side.alias("h"), F.col("l_extendedprice").alias("score"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face annotations: a box and the flags pose, occlusion, blur, invalid, by fixed arithmetic on lineitem."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat((F.col("l_orderkey") % 7).cast("string"), F.lit("/img_"), (F.col("l_orderkey") / 10).cast("long").cast("string"), F.lit(".jpg")).alias("img_rel_path"),
        (F.col("l_partkey") * 37 % 160).alias("x"), (F.col("l_suppkey") * 53 % 160).alias("y"),
        (20 + F.col("l_partkey") % 60).alias("w"), (20 + F.col("l_suppkey") % 70).alias("h"),
        (F.col("l_returnflag") == "R").cast("int").alias("blur"), (F.col("l_linenumber") == 7).cast("int").alias("occlusion"),
        (F.col("l_linenumber") == 6).cast("int").alias("pose"), (F.col("l_discount") > 0.09).cast("int").alias("invalid"),
    )
