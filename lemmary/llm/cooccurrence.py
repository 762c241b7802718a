"""Problem 6: items that appear together, by a heavy-light decomposition.

Items in many baskets are heavy (at most ``max_heavy``): their baskets become rows of a bit matrix and pairs of them are
popcounts of ANDed columns. Pairs of rare items are counted by hash, with partial sums before the shuffle. Mixed pairs come
from probing the rare items' basket lists in the baskets' heavy lists. The three parts are disjoint; their union gets the lift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.operators.cut import cut


def _popcounts(batches: Iterator[pa.RecordBatch], n_heavy: int) -> Iterator[pa.RecordBatch]:
    """Sums of popcounts of all column pairs of the bit matrix (baskets x heavy items) of this partition."""
    counts = np.zeros((n_heavy, n_heavy), dtype=np.int64)
    for b in batches:
        lists = b.column("hs")
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        bits = np.zeros((n_heavy, -(-len(lists) // 64) * 64), dtype=bool)
        bits[lists.flatten().to_numpy(), rows] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(n_heavy - 1):
            if words[i].any():
                at = np.nonzero(words[i])[0]
                counts[i, i + 1 :] += np.bitwise_count(words[i + 1 :, at] & words[i, at]).sum(axis=1, dtype=np.int64)
    i, j = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], names=["i", "j", "c"])


def cooccurring_pairs(rows: DataFrame, basket_col: str, item_col: str, min_count: int = 5, min_lift: float = 10.0, max_heavy: int = 512, block: int = 1000) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift) of all pairs in at least ``min_count`` baskets with ``min_lift``.

    Over distinct (basket, item) rows with both ids; lift = n_both * n_baskets / (n_a * n_b). Items in fewer than
    ``min_count`` baskets or in more than ``n_baskets / min_lift`` of them can't be in such a pair (n_both <= n_a) and are
    left out first, which loses nothing. Baskets of more than ``block`` items are cut into blocks, whose pairs are counted in
    separate keys, so that no basket, however large, is one task's work. Pairs come once, item_a < item_b.
    """
    edges = cut(rows.select(clean_key(basket_col).alias("basket"), clean_key(item_col).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct())
    n = edges.agg(F.count_distinct("basket")).first()[0]
    degrees = edges.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= min_count)
    degrees = cut(degrees.where(F.col("n_item") * F.lit(min_lift) <= F.lit(n)))
    kept = degrees.agg(F.sum("n_item")).first()[0] or 0
    limit = max(64, -(-kept // max_heavy))
    heavy = [r[0] for r in degrees.where(F.col("n_item") > limit).select("item").orderBy("item").collect()]  # fewer than max_heavy
    spark = edges.sparkSession
    index = spark.createDataFrame(list(enumerate(heavy)), "h int, item string")
    marked = edges.join(F.broadcast(index), "item", "left")
    light = cut(marked.where("h IS NULL").join(degrees.where(F.col("n_item") <= limit).select("item"), "item").select("basket", "item"))

    # rare with rare
    sizes = light.groupBy("basket").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > block).select("basket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    blocked = light.join(large, "basket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    left = blocked.select("basket", F.col("item").alias("x"), F.col("own").alias("bi"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("bj"))
    right = blocked.select("basket", F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("bi"), F.col("own").alias("bj"))
    rare = (
        left.join(right, ["basket", "bi", "bj"]).where("bi != bj OR x < y").groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.count(F.lit(1)).alias("n_both"))
    )
    parts = rare
    if heavy:
        lists = cut(marked.where("h IS NOT NULL").groupBy("basket").agg(F.sort_array(F.collect_set("h")).alias("hs")))
        # rare with frequent
        mixed = light.join(lists, "basket").select("item", F.explode("hs").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_count)
        mixed = mixed.join(F.broadcast(index.withColumnRenamed("item", "other")), "h").select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b"), "n_both")
        # frequent with frequent
        size = len(heavy)
        dense = lists.select("hs").mapInArrow(lambda it: _popcounts(it, size), "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("n_both"))
        dense = dense.join(F.broadcast(index.select(F.col("h").alias("i"), F.col("item").alias("item_a"))), "i").join(F.broadcast(index.select(F.col("h").alias("j"), F.col("item").alias("item_b"))), "j")
        parts = parts.unionByName(mixed).unionByName(dense.select("item_a", "item_b", "n_both"))
    ends = lambda c, m: degrees.select(F.col("item").alias(c), F.col("n_item").alias(m))
    return (
        parts.where(F.col("n_both") >= min_count)
        .join(ends("item_a", "n_a"), "item_a")
        .join(ends("item_b", "n_b"), "item_b")
        .withColumn("n_baskets", F.lit(n).cast("long"))
        .withColumn("lift", F.col("n_both") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")))
        .where(F.col("n_both") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    )
