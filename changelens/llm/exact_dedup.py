"""Exact duplicates found by stateful streaming, with DataFrame operations only.

Narrow rows (digest, id, locator) run through a streaming aggregation whose keyed state lies in RocksDB, has no
expiry, and is saved in the shared folder after each batch. Per digest the state keeps the row that stays, its
locator and the number of rows seen. A digest that has been seen more than once is a hit: the full bytes of its
rows are then compared with those of the row that stays, and rows that only share the digest become groups of
their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, new_folder, text_of, written

#: Members of a large group are compared with the row that stays in lots of about this many.
LOT = 1_000
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Many small stores: space set aside for each one's logs would outweigh the state.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text_column: str = "text") -> Column:
    """The text that is compared: NULL is empty, each run of white space is one blank."""
    return F.regexp_replace(text_of(text_column), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def streamed_state(arrivals: str, schema, checkpoint: str, bytes_per_batch: str | None = None) -> DataFrame:
    """The state after all files in the folder ``arrivals``: digest, first (struct), n_rows.

    ``first`` is the least struct of all rows with that digest. Files that the checkpoint has already taken in
    are not read again, so the same call with more files goes on from the saved state.
    """
    spark = SparkSession.active()
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        reader = spark.readStream.schema(schema)
        if bytes_per_batch:
            reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
        state = reader.parquet(arrivals).groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n_rows"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
        saved = spark.read.format("statestore").load(checkpoint)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # The value holds the aggregates in the order of the query.
    first, rows = saved.schema["value"].dataType.names
    return saved.select("key.digest", F.col(f"value.`{first}`").alias("first"), F.col(f"value.`{rows}`").alias("n_rows"))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Of equal normalised texts the row with the smallest id stays; rows without an id come last. Of rows that share
    id and text just one is kept, and all of them have the same keep_id. NULL and empty texts are equal. An empty
    table gives no rows. Only the id and the text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    schema = "digest string, row struct<no_id:boolean,id:bigint,at:bigint,locator:string,size:bigint>"
    text = normalised(text_column)
    rows = docs.select(
        digest(text).alias("digest"),
        F.struct(
            F.col(id_column).isNull().alias("no_id"),
            F.col(id_column).cast("bigint").alias("id"),
            F.monotonically_increasing_id().alias("at"),
            F.input_file_name().alias("locator"),
            F.octet_length(text).cast("bigint").alias("size"),
        ).alias("row"),
    )
    arrivals = new_folder(spark, "dedup-rows")
    rows.write.parquet(arrivals)  # numbered once; what follows reads these numbers
    rows = spark.read.schema(schema).parquet(arrivals)
    state = streamed_state(arrivals, schema, new_folder(spark, "dedup-state"), bytes_per_batch)
    grouped = written(
        rows.join(state, "digest").select(
            F.col("row.id").alias("doc_id"),
            F.col("first.id").alias("keep_id"),
            F.col("n_rows").alias("group_size"),
            (F.col("row.at") == F.col("first.at")).alias("kept"),
            F.col("digest").alias("text_sha256"),
            F.col("row.no_id").alias("no_id"),
            F.col("row.at").alias("at"),
        ),
        "dedup-groups",
    )
    others = written(_different_bytes(docs, grouped, id_column, text_column, digest), "dedup-others")
    if not others.isEmpty():
        grouped = _regrouped(grouped, others)
    return grouped.drop("no_id", "at")


def _different_bytes(
    docs: DataFrame, grouped: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """Rows with the digest of the row that stays but another normalised text: other_id, other_digest, bytes."""
    members = grouped.where("group_size > 1").select("doc_id", "keep_id", "group_size", "text_sha256").distinct()
    text = normalised(text_column)
    texts = docs.select(F.col(id_column).cast("bigint").alias("other_id"), text.alias("bytes"))
    texts = texts.withColumn("other_digest", digest(F.col("bytes"))).join(
        members, F.expr("other_id <=> doc_id AND other_digest = text_sha256")
    )
    lots = F.ceil(F.col("group_size") / LOT).cast("int")
    # Both sides of the comparison read the texts of the hits, so all texts are shuffled once.
    texts = written(texts.select("other_id", "other_digest", "bytes", "keep_id", lots.alias("lots")), "dedup-texts")
    # The text that stays is repeated once per lot, so that a group of any size is compared in many tasks.
    stays = texts.where("other_id <=> keep_id").select(
        F.col("other_digest").alias("digest"), F.col("bytes").alias("kept_bytes"), F.explode(F.expr("sequence(0, lots - 1)")).alias("lot")
    )
    rest = texts.where("NOT (other_id <=> keep_id)").withColumn("lot", F.pmod(F.xxhash64("other_id"), "lots").cast("int"))
    compared = rest.alias("r").join(stays.alias("s"), F.expr("r.other_digest = s.digest AND r.lot = s.lot"))
    return compared.where("bytes <> kept_bytes").select("other_id", "other_digest", "bytes").distinct()


def _regrouped(grouped: DataFrame, others: DataFrame) -> DataFrame:
    """The same rows with (digest, bytes) as the group; ``bytes`` is NULL for the text that stays."""
    keyed = grouped.join(others, F.expr("doc_id <=> other_id AND text_sha256 = other_digest"), "left")
    again = keyed.groupBy(F.col("text_sha256").alias("digest"), F.col("bytes").alias("group_bytes")).agg(
        F.min(F.struct("no_id", "doc_id", "at")).alias("first"), F.count("*").alias("n_rows")
    )
    return keyed.join(again, F.expr("text_sha256 = digest AND bytes <=> group_bytes")).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        (F.col("at") == F.col("first.at")).alias("kept"),
        "text_sha256",
        "no_id",
        "at",
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_duplicates(docs, id_column, text_column)
    pairs = found.groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__digest"))
    keep = written(pairs.agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows")).where("__kept"), "dedup-kept")
    same = docs[id_column].cast("bigint").eqNullSafe(F.col("__keep_id")) & (sha256(normalised(text_column)) == F.col("__digest"))
    if keep.where("__rows > 1").isEmpty():
        return docs.join(keep, same, "left_semi")
    # Some rows share both id and text: one of each such set is wanted.
    return docs.join(keep, same).dropDuplicates(["__keep_id", "__digest"]).drop(*keep.columns)
