"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source with ``n`` of ``N`` rows and target weight ``w`` gets the mean rate ``r = size * w * N / n``. Each row draws
how often it appears from a Poisson distribution with that mean, by inverting it at a number in [0, 1) that comes
from a hash of the seed and the row's id. The copies are dealt out and sorted by another such hash: one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Sources with known rates up to which the table of rates is sent to all tasks (some 100 bytes a row).
MAX_BROADCAST = 50_000
_NEW = ("__source", "__rate", "__copy", "__order")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The least k with u < P(X <= k) for X of mean ``rate``; terms are kept as logarithms, so large means work."""
    # P(X > bound) is below the step between two numbers u, so the bound cuts nothing off.
    bound = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.lit(0).alias("k"), (-rate).alias("log"), F.exp(-rate).alias("below"))

    def step(a: Column, i: Column) -> Column:
        term = a["log"] + F.log(rate) - F.log(i.cast("double"))
        on = a["below"] <= u
        return F.struct(
            F.when(on, i).otherwise(a["k"]).alias("k"),
            F.when(on, term).otherwise(a["log"]).alias("log"),
            F.when(on, a["below"] + F.exp(term)).otherwise(a["below"]).alias("below"),
        )

    return F.aggregate(F.sequence(F.lit(1), bound), start, step, lambda a: a["k"])


def source_rates(
    docs: DataFrame, source_column: str, weights: Mapping[str, float] | None, temperature: float, size: float
) -> DataFrame:
    """source, n_rows, weight, rate: one row per source (NULL is a source of its own).

    With ``weights`` a source that is not named has weight 0; they need not add up to one. Without, the weight is
    the source's share to the power ``temperature`` (1: as it is, 0: all alike).
    """
    rows = docs.groupBy(F.col(source_column).cast("string").alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        raw = F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        raw = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    rows = rows.withColumn("raw", raw)
    total = rows.agg(F.sum("n_rows").alias("all_rows"), F.sum("raw").alias("all_raw"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    weight = F.coalesce(F.try_divide("raw", "all_raw"), F.lit(0.0))
    return rows.select(
        "source", "n_rows", weight.alias("weight"), (F.lit(float(size)) * weight * F.col("all_rows") / F.col("n_rows")).alias("rate")
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with each row as often as drawn (0 times or more), in an order that depends on nothing but hashes.

    Four columns are added: ``__source``, ``__rate``, ``__copy`` (from 0) and ``__order``; all columns of ``docs`` stay.
    ``size`` is the expected number of rows out as a multiple of those in. Rows with the same id draw the same
    number. NULL ids and sources count as the empty id and as one source; texts are not looked at; an empty
    table gives no rows. A draw costs as many steps as its mean, so the rate of a tiny source may be large.
    """
    rates = source_rates(docs, source_column, weights, temperature, size).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate")
    )
    if rates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        rates = F.broadcast(rates)  # else adaptive execution splits the large sources
    rows = docs.join(rates, docs[source_column].cast("string").eqNullSafe(F.col("__source")))
    drawn = poisson(F.col("__rate"), uniform(F.lit(f"{seed}:draw"), docs[id_column]))
    rows = rows.withColumn("__times", F.when(F.col("__rate") > 0, drawn).otherwise(0)).where("__times > 0")
    rows = rows.withColumn("__copy", F.explode(F.expr("sequence(0, __times - 1)"))).drop("__times")
    rows = rows.withColumn("__order", uniform(F.lit(f"{seed}:order"), docs[id_column], F.col("__copy")))
    return rows.repartition("__order").sortWithinPartitions("__order", id_column, "__copy")


def shuffled_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, rate, shuffle_key for each copy of each document."""
    return mixed(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__copy").cast("bigint").alias("copy"),
        F.col("__rate").alias("rate"),
        F.col("__order").alias("shuffle_key"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
