"""Files in the shared folder that tasks read or write by themselves."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession


#: Schemes of Spark's connectors that tasks reach by another name.
_SAME = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with its scheme, in a form that tasks can open; one without a scheme lies in Spark's default file system.

    A viewfs:// folder is followed to the store behind it, and s3a is taken for s3. A scheme that pyarrow has no file
    system for is an error here, before any task runs.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "viewfs":
        fs.mkdirs(path)
        path = fs.resolvePath(path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toUri().toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    scheme, sep, rest = uri.partition("://")
    uri = f"{_SAME.get(scheme, scheme)}{sep}{rest}"
    try:
        file_system(uri)
    except (pa.ArrowInvalid, OSError, ImportError) as e:
        raise ValueError(f"tasks cannot open {folder}: set spark.checkpoint.dir to a file, hdfs, s3, gs or abfss folder ({e})") from e
    return uri


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI with a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(uri)
