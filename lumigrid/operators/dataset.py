"""Dataset preparation: filters, anti-joins, splits, numbering, unions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST_FACE = 40


def rejection(least: int = LEAST_FACE) -> Column:
    """The first reason to reject an annotation: pose, occlusion, blur, invalid, size; null if there is none."""
    return F.when(F.col("pose") != 0, "pose").when(F.col("occlusion") != 0, "occlusion").when(F.col("blur") != 0, "blur").when(F.col("invalid") != 0, "invalid").when((F.col("w") < least) | (F.col("h") < least), "size")


def rejection_counts(annotations: DataFrame, least: int = LEAST_FACE) -> DataFrame:
    """(reason, n), reason `kept` for what passes."""
    return annotations.groupBy(F.coalesce(rejection(least), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def usable(annotations: DataFrame, least: int = LEAST_FACE) -> DataFrame:
    return annotations.where(rejection(least).isNull())


def images_without(images: DataFrame, marks: DataFrame, categories: DataFrame, name: str) -> DataFrame:
    """images (id, ...) without any mark (image_id, category_id) of the named category (id, name).

    The ids of one name are few and go to every task; dealt by category, most marks would meet in one task.
    """
    wanted = categories.where(F.col("name") == name).select(F.col("id").alias("category_id"))
    marked = marks.join(F.broadcast(wanted), "category_id", "left_semi").select(F.col("image_id").alias("id"))
    return images.join(marked, "id", "left_anti")


def reconcile(grouped: DataFrame, images: DataFrame) -> DataFrame:
    """(image, faces) of all images (image), faces (filename, faces) found by stem; an image without any has none."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    left, right = grouped.select(stem("filename").alias("stem"), "faces"), images.select(stem("image").alias("stem"), "image")
    joined = left.join(right, "stem", "right")
    kind = grouped.schema["faces"].dataType.simpleString()
    return joined.select("image", F.coalesce("faces", F.array().cast(kind)).alias("faces"))


def seeded_order(key: str, seed: int = 42) -> Column:
    """A shuffle that depends on key and seed only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def numbered(rows: DataFrame, key: str, seed: int = 42, digits: int = 3) -> DataFrame:
    """rows with position, from 0 in seeded_order; key must be unique.

    Rows are numbered within the 16 ** digits beginnings of their hash; counts of these, bounded, give the offsets, so
    no task sorts all rows.
    """
    marked = rows.withColumn("_order", seeded_order(key, seed)).withColumn("_head", F.substring("_order", 1, digits))
    counts = marked.groupBy("_head").agg(F.count("*").alias("_n"))
    offsets = counts.select("_head", (F.sum("_n").over(Window.orderBy("_head")) - F.col("_n")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_head").orderBy("_order", key)) - 1
    return marked.withColumn("_at", within).join(F.broadcast(offsets), "_head").withColumn("position", F.col("_offset") + F.col("_at")).drop("_order", "_head", "_at", "_offset")


def split_rows(rows: DataFrame, key: str, train: int, validation: int, prefix: str = "face", seed: int = 42) -> DataFrame:
    """The first train rows in seeded order as split `train`, the next validation rows as `val`, with numbered names."""
    at = F.col("position")
    placed = numbered(rows, key, seed).where(at < train + validation)
    own = F.when(at < train, at).otherwise(at - train)
    return placed.withColumn("split", F.when(at < train, "train").otherwise("val")).withColumn("name", F.concat(F.lit(prefix + "_"), F.lpad(own.cast("string"), 5, "0")))


def next_index(names: DataFrame, prefix: str = "neg") -> int:
    """One more than the largest number among names like prefix_00012.jpg; 0 without any."""
    found = names.select(F.regexp_extract("name", rf"^{prefix}_(\d+)\.(?i:jpg|jpeg|png)$", 1).alias("n")).where("n <> ''")
    return int(found.agg(F.coalesce(F.max(F.col("n").cast("long")), F.lit(-1))).first()[0]) + 1


def append_numbered(existing: DataFrame, rows: DataFrame, key: str, prefix: str = "neg", seed: int = 42) -> DataFrame:
    """rows with a name each that goes on after those of existing (name)."""
    number = (F.col("position") + next_index(existing, prefix)).cast("string")
    return numbered(rows, key, seed).withColumn("name", F.concat(F.lit(prefix + "_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number), F.lit(".jpg")))


def category_counts(rows: DataFrame, category: str, split: str) -> DataFrame:
    """Counts for each category and split, each category, and all; level 0, 1 and 3."""
    return rows.rollup(category, split).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def categorised(files: DataFrame, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp"), seed: int = 42) -> DataFrame:
    """files (path, more columns) as split/category/name with such a suffix: with split, category and position.

    split and category are the last two folders of the path; position numbers all of them in seeded order of the path,
    which must be unique. Files elsewhere or with another suffix, and null paths, are left out.
    """
    pattern = r"([^/]+)/([^/]+)/[^/]+\.(?i:" + "|".join(suffixes) + ")$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    own = files.withColumn("split", part(1)).withColumn("category", part(2)).where("split <> ''")
    return numbered(own, "path", seed)


def training_set(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both with y, 1 and 0."""
    return positives.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))


def first_paths(files: DataFrame, k: int) -> DataFrame:
    """The first k rows by path."""
    return files.orderBy("path").limit(k)


def random_patches(images: DataFrame, height: int, width: int, size: int, most: int = 8, least_var: float = 50.0, seed: int = 42) -> DataFrame:
    """Up to most places (img_id, r, c, var) of each image with tables whose variance is at least least_var.

    As many as five times most places are tried, in an order that depends on image and seed.
    """
    from lumigrid.functions.geometry import window_variance

    down, across = height - size + 1, width - size + 1
    tries = F.transform(F.sequence(F.lit(0), F.lit(5 * most - 1)), lambda k: F.pmod(F.xxhash64("img_id", k, F.lit(seed)), F.lit(down * across)))
    placed = images.select("img_id", "w", "ii", "ii_sq", F.posexplode(F.array_distinct(tries)).alias("try", "at"))
    r, c = (F.col("at") / across).cast("int"), (F.col("at") % across).cast("int")
    rated = placed.select("img_id", "try", r.alias("r"), c.alias("c"), window_variance(F.col("ii"), F.col("ii_sq"), F.col("w"), r, c, F.lit(size)).alias("var")).where(F.col("var") >= least_var)
    order = Window.partitionBy("img_id").orderBy("try")
    return rated.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("img_id", "r", "c", "var")
