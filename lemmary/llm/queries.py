"""Registered queries of the training-data problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.llm import cooccurrence, groups, overlap, packing, set_join, tokens, truncation, vectors
from lemmary.llm.oracle import ORACLE  # noqa: F401
from lemmary.operators.cut import cut
from lemmary.sources.tables import table


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = set_join.symbol_records(table(spark, d, "proof_states"), table(spark, d, "theorem_enrichment"))
    members, classes = set_join.set_classes(records, "id", "values", 5)
    return members, classes, set_join.similar_classes(classes, 0.75)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return set_join.similar_record_pairs(*_sets(spark, d))


def p1_linked(spark: SparkSession, d: str) -> DataFrame:
    return set_join.linked_records(*_sets(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.list_pairs(vectors.nearest_lists(table(spark, d, "entity_vectors")))


def p2_lists(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_lists(table(spark, d, "entity_vectors")).withColumnsRenamed({"kind": "entity_type", "id": "entity_id", "other": "neighbor_id"})


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return groups.graph_nodes(table(spark, d, "theorems"), table(spark, d, "proof_states"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.theorem_groups(_nodes(spark, d))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_records(_nodes(spark, d), table(spark, d, "split_targets"))


def p3_edge_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_edges(table(spark, d, "positive_edges"), p3_splits(spark, d))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """(name, n): groups in several splits, ids without one, splits whose share of proof states is off by more than 0.01 (all must be 0), edges and proof states counted."""
    records = cut(p3_splits(spark, d))
    states = records.where("kind = 'proof_state'")
    n = states.count()
    got = states.groupBy("split").agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias("got")).join(table(spark, d, "split_targets").distinct(), "split", "full")
    off = F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))) > 0.01
    several = records.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    edges = groups.split_edges(table(spark, d, "positive_edges"), records)
    counts = {"groups in several splits": several, "ids without split": records.where("split IS NULL"), "splits off target": got.where(off), "proof states": states}
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, x in counts.items()]
    return reduce(DataFrame.unionByName, [*parts, edges.agg(F.sum("n_edges").alias("n")).select(F.lit("edges").alias("name"), "n")])


def _texts(spark: SparkSession, d: str, *columns: tuple[str, str]) -> DataFrame:
    """(kind, id, text, split) of the named tables and text columns."""
    return reduce(DataFrame.unionByName, [table(spark, d, name).select(F.lit(name).alias("kind"), "id", F.col(text).alias("text"), "split") for name, text in columns])


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """(kind, eval_id, train_id, path) of proof states, premises and theorems."""
    close = overlap.cross_split_pairs(_texts(spark, d, ("proof_states", "goal_text"), ("premises", "code"))).select("kind", "eval_id", "train_id", "path")
    return close.unionByName(overlap.cross_split_names(_texts(spark, d, ("theorems", "full_name"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(_overlaps(spark, d))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, path, n_pairs): what the segment join finds by itself and what the exact path beside it adds."""
    return overlap.pair_paths(_overlaps(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, split, file_path, n_records, n_pairs): evaluation records that occur in train, per split and source file."""
    theorems = table(spark, d, "theorems").select(clean_key("id").alias("id"), "split", "file_path").distinct()
    files = theorems.groupBy("id").agg(F.min("file_path").alias("file_path"))
    states = table(spark, d, "proof_states").select(clean_key("id").alias("id"), "split", clean_key("theorem_id").alias("t")).distinct()
    states = states.join(files.withColumnRenamed("id", "t"), "t", "left").select("id", "split", "file_path")
    premises = table(spark, d, "premises").select(clean_key("id").alias("id"), "split", "file_path").distinct()
    homes = theorems.withColumn("table_name", F.lit("theorems")).unionByName(states.withColumn("table_name", F.lit("proof_states"))).unionByName(premises.withColumn("table_name", F.lit("premises")))
    homes = homes.where(F.trim("split").isin("val", "test")).groupBy("table_name", "id").agg(F.min(F.trim("split")).alias("split"), F.min("file_path").alias("file_path"))
    pairs = _overlaps(spark, d).select(F.col("kind").alias("table_name"), F.col("eval_id").alias("id"), "train_id").distinct()
    per = pairs.groupBy("table_name", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(homes, ["table_name", "id"]).groupBy("table_name", "split", "file_path").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_pairs"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = cooccurrence.cooccurring_pairs(table(spark, d, "positive_edges"), "proof_state_id", "premise_id")
    return found.withColumnsRenamed({"item_a": "premise_a", "item_b": "premise_b"}).withColumn("lift", F.round("lift", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("premise_a", "premise_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, d, "documents")), table(spark, d, "token_budgets"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p8_containers(spark, d), table(spark, d, "token_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("is_cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.truncated(table(spark, d, "documents")))


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_reasons(truncation.truncated(table(spark, d, "documents")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_linked, p2_found, p2_lists, p3_found, p3_splits, p3_edge_splits, p3_checks, p5_found, p5_paths, p5_report, p6_found, p6_pairs, p7_ids, p8_containers, p8_summary, p9_found, p9_reasons, p9_sources)
}
