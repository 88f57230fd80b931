"""Snapshots of documents: ``ref, path, content``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import decode_content


def load_snapshots(spark: SparkSession, folder: str, ref: str) -> DataFrame:
    """The files below a folder, one row each, with paths relative to the folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    # Without the scheme and the host, both are plain paths from the root of the file system.
    file = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][\w+.\-]*:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.lit(ref).alias("ref"),
        F.regexp_replace(file, "^/*" + re.escape(root.lstrip("/")) + "/", "").alias("path"),
        F.col("value").alias("content"),
    )


def snapshots_from(df: DataFrame, ref: str | Column, path: Column, content: Column, encoding: Column | None = None):
    """Snapshots from a table; payloads with an encoding are decoded, unknown encodings give NULL."""
    text = content if encoding is None else decode_content(content, encoding)
    return df.select(
        (F.lit(ref) if isinstance(ref, str) else ref).alias("ref"), path.alias("path"), text.alias("content")
    )
