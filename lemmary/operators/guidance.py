"""Guidance: votes of a theorem's neighbours for premises and strategies, bundled with their difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.operators.retrieval import top_k


def positional_votes(neighbors: DataFrame, votes: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, rank, score): each vote weighs 1 / its place in the query's list of votes.

    ``votes``: (theorem_id, item_id, seq) with repeats; the list goes through the neighbours by rank, then by ``seq`` (file
    order), then item. Several votes for one item add up.
    """
    cast = neighbors.select("query_id", F.col("item_id").alias("theorem_id"), F.col("rank").alias("nr")).join(votes, "theorem_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("nr", "seq", "item_id"))
    return top_k(cast.withColumn("place", place).groupBy("query_id", "item_id").agg(F.sum(F.lit(1.0) / F.col("place")).alias("score")), k)


def first_queries(theorems: DataFrame, limit: int = 25) -> DataFrame:
    """The first theorems in file order (column ``seq``)."""
    return theorems.orderBy("seq").limit(limit).select(F.col("theorem_id").alias("query_id"), "full_name", "domain_tag")


def bundles(queries: DataFrame, neighbors: DataFrame, premises: DataFrame, strategies: DataFrame, names: DataFrame, features: DataFrame) -> DataFrame:
    """One nested row per query: first 10 neighbours, premise and strategy suggestions, difficulty profile of all neighbours."""
    listed = lambda d, *cols: d.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("x"))
    near = neighbors.where("rank <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("neighbors"))
    named = premises.join(names, premises["item_id"] == names["id"], "left").select("query_id", "rank", F.col("item_id").alias("premise_id"), "score", F.coalesce("full_name", "item_id").alias("name"))
    p = listed(named, "premise_id", "score", "name").withColumnRenamed("x", "premise_suggestions")
    s = listed(strategies, "item_id", "score").withColumnRenamed("x", "strategy_facets")
    f = neighbors.join(features.withColumnRenamed("theorem_id", "item_id"), "item_id").groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("theorem_complexity_score", F.lit(0.0))), 6).alias("difficulty_score"), F.mode(F.when(F.col("difficulty_bucket") != "", F.col("difficulty_bucket")), True).alias("difficulty_bucket"), F.count(F.lit(1)).alias("difficulty_neighbors")
    )
    out = queries
    for d in (near, p, s, f):
        out = out.join(d, "query_id", "left")
    return out.withColumnRenamed("query_id", "theorem_id").fillna({"difficulty_score": 0.0, "difficulty_bucket": "", "difficulty_neighbors": 0})


def bundle_summary(bundled: DataFrame) -> DataFrame:
    """One row: number of bundles and mean numbers of neighbours, premises, strategies and difficulty neighbours."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))), F.lit(0)) / n, 6)
    return bundled.agg(
        F.count(F.lit(1)).alias("bundles"), mean("neighbors").alias("avg_neighbors"), mean("premise_suggestions").alias("avg_premises"), mean("strategy_facets").alias("avg_strategies"),
        F.round(F.coalesce(F.sum("difficulty_neighbors"), F.lit(0)) / n, 6).alias("avg_difficulty_neighbors"),
    )


def flat_bundles(bundled: DataFrame) -> DataFrame:
    """Bundles with their lists as texts: ids with commas, names with lines between."""
    return bundled.select(
        "theorem_id", "full_name", "domain_tag", F.array_join(F.coalesce("neighbors", F.array().cast("array<string>")), ",").alias("neighbors"),
        F.coalesce(F.array_join(F.transform("premise_suggestions", lambda x: x["premise_id"]), ","), F.lit("")).alias("premises"),
        F.coalesce(F.array_join(F.transform("premise_suggestions", lambda x: x["name"]), "\n"), F.lit("")).alias("premise_names"),
        F.coalesce(F.array_join(F.transform("strategy_facets", lambda x: x["item_id"]), ","), F.lit("")).alias("strategies"),
        "difficulty_score", "difficulty_bucket", "difficulty_neighbors",
    )


def evidence(premises: DataFrame, strategies: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(kind, name, score, n_bundles, rank): premises (by name) and strategies by their score over all bundles, the first ``limit`` of each kind."""
    named = premises.join(names, premises["item_id"] == names["id"], "left").select(F.lit("premise").alias("kind"), F.coalesce("full_name", "item_id").alias("name"), "score")
    rows = named.unionByName(strategies.select(F.lit("strategy").alias("kind"), F.col("item_id").alias("name"), "score"))
    total = rows.groupBy("kind", "name").agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("n_bundles"))
    order = Window.partitionBy("kind").orderBy(F.desc("score"), F.asc("name"))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def histograms(bundled: DataFrame) -> DataFrame:
    """(kind, value, n, share): bundles by difficulty bucket and by domain; what is empty is 'unknown'."""
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))
    each = F.explode(F.array(F.struct(F.lit("bucket").alias("kind"), known("difficulty_bucket").alias("value")), F.struct(F.lit("domain").alias("kind"), known("domain_tag").alias("value"))))
    counts = bundled.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))
