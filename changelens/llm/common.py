"""What several operators of this subpackage share: folders all executors see, and tables written down."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: White space of the word definitions: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that does not exist yet, below the folder in ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Later readers agree on its rows, and a lost executor costs no more than the step that was running.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The text column, NULL counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(id_column: Column) -> Column:
    """crc32 of the id as decimal text, modulo 5: fold 0 is held out from training."""
    return F.crc32(id_column.cast("string")) % 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Hand Python this many rows at a time at most, for functions that return more than they get."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python this many rows at a time at most, in what is written meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)
