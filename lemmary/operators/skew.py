"""Keys that hold a large part of all rows: detection, salted aggregation and count lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.operators.cut import cut

#: Bounds of the number of cells that salted aggregation aims at; the upper one bounds the broadcast table of heavy keys.
LEAST_CELLS, MOST_CELLS = 256, 65_536


def key_counts(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """(key, n_rows) of the non-null keys. Counts are combined before the shuffle, so hot keys cost nothing more."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_rows"))


def heavy_keys(counts: DataFrame, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows: never more than ``1 / share`` rows, hence safe to broadcast."""
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("n_rows") / F.lit(total) >= F.lit(share))


def salts(counts: DataFrame, cells: int | None = None) -> DataFrame:
    """(key, n_rows, n_salts) of the heavy keys: those with more than one of ``cells`` equal parts of all rows.

    A key has as many salts as it fills parts, whatever the size of the table. ``cells`` is four times the number of
    shuffle partitions within fixed bounds; fewer than ``cells`` keys can be heavy, which bounds the table.
    """
    if cells is None:
        cells = min(MOST_CELLS, max(LEAST_CELLS, 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("n_rows") * F.lit(cells) > F.lit(total)).withColumn("n_salts", F.ceil(F.col("n_rows") * F.lit(cells) / F.lit(total)).cast("int"))


def salted_aggregate(df: DataFrame, key: str, spread: list[Column], partial: list[Column], merged: list[Column], weight: Column | None = None, cells: int | None = None) -> DataFrame:
    """Aggregate per ``key`` in two stages, the rows of heavy keys (:func:`salts`) split over salts.

    A row's salt is the hash of ``spread``: as even as a random one, but the same when a lost task is run again, and equal
    ``spread`` values meet under one salt, so distinct counts of ``spread`` add up over salts. ``partial`` aggregates per
    (key, salt), ``merged`` combines those columns per key. Light keys have the one salt 0. ``weight``: how many rows one
    row of ``df`` stands for.

    Null keys are left out. An empty table gives no rows. Other columns of ``df`` are ignored, whatever their names.
    """
    rows = df.where(F.col(key).isNotNull())
    heavy = salts(cut(key_counts(rows, key, weight)), cells).select(F.col(key).alias("__key"), F.col("n_salts").alias("__salts"))
    salted = rows.join(F.broadcast(heavy), rows[key] == F.col("__key"), "left")
    salt = F.when(F.col("__salts") > 1, F.pmod(F.xxhash64(*spread), F.col("__salts")).cast("int")).otherwise(F.lit(0))
    return salted.withColumn("__salt", salt).groupBy(key, "__salt").agg(*partial).groupBy(key).agg(*merged)


def with_key_counts(df: DataFrame, key: str, spread: list[Column], name: str, share: float = 0.001) -> DataFrame:
    """``df`` with the number of its rows that have the same string ``key``, without moving a hot key into one task.

    Heavy keys (at most ``1 / share``) take their count from a broadcast; only the rows of the other keys are shuffled by
    key, the heavy ones meanwhile by a hash of ``spread``. Rows with a null key are dropped.
    """
    rows = df.where(F.col(key).isNotNull())
    counts = cut(key_counts(rows, key))
    heavy = heavy_keys(counts, share).select(F.col(key).alias("__hk"), F.col("n_rows").alias("__hn"))
    light = counts.select(F.col(key).alias("__lk"), F.col("n_rows").alias("__ln"))
    marked = rows.join(F.broadcast(heavy), rows[key] == F.col("__hk"), "left")
    at = F.when(F.col("__hn").isNull(), F.col(key)).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(*spread).cast("string")))
    return (
        marked.withColumn("__at", at)
        .join(light, F.col("__at") == F.col("__lk"), "left")
        .withColumn(name, F.coalesce("__hn", "__ln"))
        .drop("__hk", "__hn", "__at", "__lk", "__ln")
    )
