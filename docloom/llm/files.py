"""Files of a shared store that Python workers read at an offset or as a stream, through pyarrow.fs."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme and authority: without a scheme it is in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a full path, and the path there. Hadoop's names for S3 are s3's."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)
