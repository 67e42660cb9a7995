"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lumigrid", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments are added with dots for double underscores."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and the master local, as in tests, a temporary one is set."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumigrid-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/lumigrid-{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Runtime settings for the actions within; keys are written with double underscores for dots."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Limits of the batches in which rows with texts go from Parquet to Spark and from Spark to Python and back. Spark's own, 4,096
#: rows and 64 MB, are held by each task several times over, in the JVM and in Python; results do not depend on them.
TEXT_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Set TEXT_BATCHES from now on: a DataFrame that is returned is run by its caller, beyond what settings can hold."""
    for name, value in TEXT_BATCHES.items():
        spark.conf.set(name, value)


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; the driver keeps only the start of the plan's text, as it keeps those of many actions."""
    with settings(df.sparkSession, spark__sql__maxPlanStringLength="4000"):
        df.write.parquet(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut and nothing is computed twice."""
    path = new_folder(df.sparkSession, what)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables that go when they are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, what: str) -> DataFrame:
        """As materialize does; clear removes it."""
        path = new_folder(self.spark, what)
        self.paths.append(path)
        write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove the tables. No DataFrame that reads them may be used afterwards."""
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []
