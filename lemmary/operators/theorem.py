"""Theorem to theorem: what a theorem's nearest neighbours say about its premises, strategies and difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strategy_rows(queries: DataFrame, neighbors: DataFrame, train_labels: DataFrame, gold_labels: DataFrame) -> DataFrame:
    """Per query theorem: gold, retrieved and common labels, recall, precision, F1 and whether any label was hit."""
    got = neighbors.join(train_labels.withColumnRenamed("theorem_id", "item_id"), "item_id").select("query_id", "label").distinct().withColumn("got", F.lit(1))
    gold = gold_labels.select(F.col("theorem_id").alias("query_id"), "label").distinct().withColumn("gold", F.lit(1))
    both = got.join(gold, ["query_id", "label"], "full").groupBy("query_id").agg(
        F.count("gold").alias("g"), F.count("got").alias("r"), F.count(F.when(F.col("gold").isNotNull() & F.col("got").isNotNull(), 1)).alias("o")
    )
    g, r, o = (F.coalesce(c, F.lit(0)) for c in ("g", "r", "o"))
    recall, precision = F.when(g > 0, o / g).otherwise(0.0), F.when(r > 0, o / r).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return queries.select("query_id").join(both, "query_id", "left").select(
        "query_id", g.alias("strategy_gold_count"), r.alias("strategy_retrieved_count"), o.alias("strategy_overlap_count"), F.round(recall, 9).alias("strategy_recall"),
        F.round(precision, 9).alias("strategy_precision"), F.round(f1, 9).alias("strategy_f1"), ((o > 0) & (g > 0)).alias("strategy_any_hit"),
    )


def difficulty_rows(queries: DataFrame, neighbors: DataFrame, train_features: DataFrame, gold_features: DataFrame) -> DataFrame:
    """Per query theorem: mean score and most frequent bucket (ties: the smallest) of the neighbours with features, against its own."""
    near = neighbors.join(train_features.withColumnRenamed("theorem_id", "item_id"), "item_id")
    got = near.groupBy("query_id").agg(F.avg("theorem_complexity_score").alias("p"), F.mode("difficulty_bucket", True).alias("b"))
    own = gold_features.select(F.col("theorem_id").alias("query_id"), F.col("theorem_complexity_score").alias("t"), F.col("difficulty_bucket").alias("tb"))
    p, t = F.coalesce("p", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    b, tb = F.coalesce("b", F.lit("")), F.coalesce("tb", F.lit(""))
    return queries.select("query_id").join(got, "query_id", "left").join(own, "query_id", "left").select(
        "query_id", F.round(p, 6).alias("difficulty_prediction"), F.round(t, 6).alias("difficulty_target"), F.round(F.abs(p - t), 6).alias("difficulty_absolute_error"),
        b.alias("difficulty_bucket_prediction"), tb.alias("difficulty_bucket_target"), ((b != "") & (b == tb)).alias("difficulty_bucket_match"),
    )


def strategy_summary(rows: DataFrame) -> DataFrame:
    """Means over theorems with gold labels; zeros without any."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.where("strategy_gold_count > 0").agg(
        F.count(F.lit(1)).alias("evaluated_theorems"), mean("strategy_recall").alias("recall"), mean("strategy_precision").alias("precision"), mean("strategy_f1").alias("f1"),
        mean(F.col("strategy_any_hit").cast("double")).alias("any_hit"),
    )


def difficulty_summary(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.where("difficulty_bucket_target != ''").agg(
        F.count(F.lit(1)).alias("evaluated_theorems"), mean("difficulty_absolute_error").alias("mae"), mean(F.col("difficulty_bucket_match").cast("double")).alias("bucket_accuracy")
    )
