"""Ranking metrics over long rankings and gold pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_KS = (10, 50, 100)


def _ideal(gold: Column, k: int) -> Column:
    n = F.least(gold, F.lit(k)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))


def ranking_rows(queries: DataFrame, rankings: DataFrame, gold: DataFrame, pool: DataFrame, ks: tuple[int, ...] = TOP_KS) -> DataFrame:
    """One row per query (and method, if ``rankings`` and ``queries`` have one) with counts, first hit, average precision, hits, recall and nDCG.

    ``queries``: (query_id[, method]); ``gold``: distinct (query_id, item_id); ``pool``: (id). Hits are gold items of the
    pool; a query without a ranking or gold still gets its row, with zeros (``rank_of_first_gold``: null).
    """
    by = [c for c in ("method", "query_id") if c in queries.columns]
    marked = gold.join(pool.select(F.col("id").alias("item_id"), F.lit(1).alias("in_pool")), "item_id", "left")
    counts = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_total_count"), F.count("in_pool").alias("gold_in_pool_count"))
    gold_in = marked.where("in_pool = 1").select("query_id", "item_id", F.lit(1).alias("is_gold"))
    hits = rankings.select(*by, "item_id", "rank").join(gold_in, ["query_id", "item_id"])
    running = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    hits = hits.withColumn("precision", running / F.col("rank"))
    found = hits.groupBy(*by).agg(
        F.min("rank").alias("rank_of_first_gold"),
        F.sum("precision").alias("ap"),
        *[F.count_distinct(F.when(F.col("rank") <= k, F.col("item_id"))).alias(f"hits_at_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = zero("gold_in_pool_count")
    share = lambda c, d: F.when(g > 0, F.round(F.coalesce(c, F.lit(0.0)) / d, 9)).otherwise(0.0)
    return (
        queries.select(*by).distinct().join(counts, "query_id", "left").join(found, by, "left")
        .select(
            *by, zero("gold_total_count").alias("gold_total_count"), g.alias("gold_in_pool_count"), (zero("gold_total_count") - g).alias("gold_missing_from_pool_count"), "rank_of_first_gold",
            share(F.col("ap"), g).alias("average_precision"),
            *[zero(f"hits_at_{k}").alias(f"hits_at_{k}") for k in ks],
            *[share(F.col(f"hits_at_{k}"), g).alias(f"recall_at_{k}") for k in ks],
            *[share(F.col(f"dcg_{k}"), _ideal(g, k)).alias(f"ndcg_at_{k}") for k in ks],
        )
    )


def summarize(rows: DataFrame, ks: tuple[int, ...] = TOP_KS) -> DataFrame:
    """Per method: macro means over queries with gold in the pool, sums and micro ratios over all of them."""
    by = [c for c in ("method",) if c in rows.columns]
    has = F.col("gold_in_pool_count") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(has, F.col(c))), F.lit(0.0)), 6)
    total = F.greatest(F.sum("gold_total_count"), F.lit(1))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated_queries"), F.count(F.when(has, 1)).alias("evaluated_retrievable_queries"),
        F.sum("gold_total_count").alias("gold_total"), F.sum("gold_in_pool_count").alias("gold_in_pool"), F.sum("gold_missing_from_pool_count").alias("gold_missing_from_pool"),
        F.round(F.sum("gold_in_pool_count") / total, 6).alias("gold_pool_coverage"), mean("average_precision").alias("map"),
        *[F.sum(f"hits_at_{k}").alias(f"hits_at_{k}") for k in ks],
        *[mean(f"recall_at_{k}").alias(f"recall_at_{k}") for k in ks],
        *[F.round(F.sum(f"hits_at_{k}") / total, 6).alias(f"all_positive_recall_at_{k}") for k in ks],
        *[mean(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks],
    )


def metric_delta(summary: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """(method, metric, value, delta) of every method against ``base``."""
    long = summary.select("method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select("method", "x.metric", "x.value")
    b = long.where(F.col("method") == base).select("metric", F.col("value").alias("base"))
    return long.join(b, "metric").select("method", "metric", "value", F.round(F.col("value") - F.col("base"), 6).alias("delta"))
