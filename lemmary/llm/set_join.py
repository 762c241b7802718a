"""Problem 1: all pairs of records whose value sets overlap strongly, by a prefix-filtered join.

Tokens are ordered by rarity (document frequency over distinct sets, then hash). Two sets of sizes m <= n with
|A∩B| / |A∪B| >= t share at least ``ceil(t / (1 + t) * (m + n))`` tokens, hence at least one among the first
``n - ceil(t * n) + 1`` tokens of each. Only those prefixes are joined; length and positional bounds are part of the join
condition, and the survivors are verified on the whole sets, all of it in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key, clean_values
from lemmary.operators.cut import cut
from lemmary.operators.skew import with_key_counts

_EPS = 1e-9


def _ceil(c: Column) -> Column:
    return F.ceil(c - F.lit(_EPS)).cast("int")


def set_classes(records: DataFrame, id_col: str, values_col: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records with equal sets form a class named by its smallest id.

    members: (id, class_id); classes: (class_id, tokens, n_members). Repeated rows count once, an id with several value
    arrays has their union, sets under ``min_size`` values are left out.
    """
    rows = records.select(clean_key(id_col).alias("id"), clean_values(values_col).alias("v")).where(F.col("id").isNotNull()).distinct()
    sets = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).alias("v")).where(F.size("v") >= min_size)
    keyed = cut(sets.withColumn("k", F.md5(F.concat_ws("\u0001", "v").cast("binary"))))
    classes = keyed.groupBy("k").agg(F.min("id").alias("class_id"), F.first("v").alias("tokens"), F.count(F.lit(1)).alias("n_members"))
    classes = cut(classes)
    members = keyed.select("id", "k").join(classes.select("k", "class_id"), "k").select("id", "class_id")
    return members, classes.select("class_id", "tokens", "n_members")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, overlap, jaccard) of all pairs of classes with Jaccard similarity of at least ``threshold``.

    A hot prefix token makes one skewed join key; adaptive execution splits it over tasks, the rows being joinable in
    any subsets.
    """
    tokens = classes.select("class_id", F.explode("tokens").alias("tok"))
    counted = with_key_counts(tokens, "tok", [F.col("class_id")], "df")
    ordered = counted.groupBy("class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("tok").alias("h")))), lambda x: x["h"]).alias("t")
    )
    parity = [f"aggregate(filter(t, x -> (x & 64) = {64 * i}), 0L, (a, x) -> a ^ shiftleft(1L, CAST(x & 63 AS int)))" for i in range(2)]
    sized = cut(ordered.select("class_id", "t", F.size("t").alias("n"), *[F.expr(p).alias(f"s{i}") for i, p in enumerate(parity)]))
    prefix = sized.select("class_id", "n", "s0", "s1", F.posexplode(F.slice("t", F.lit(1), F.col("n") - _ceil(F.col("n") * threshold) + 1)).alias("pos", "h"))
    a = prefix.select(*[F.col(c).alias(f"a_{c}") for c in ("class_id", "n", "s0", "s1", "pos")], F.col("h"))
    b = prefix.select(*[F.col(c).alias(f"b_{c}") for c in ("class_id", "n", "s0", "s1", "pos")], F.col("h"))
    need = _ceil((F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)))
    longer = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_class_id") < F.col("b_class_id")))
    close = F.col("a_n") >= F.col("b_n") * threshold - _EPS
    possible = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= need
    apart = F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) + F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
    alike = apart <= F.col("a_n") + F.col("b_n") - 2 * need
    candidates = a.join(b, "h").where(longer & close & possible & alike).select("a_class_id", "b_class_id").distinct()
    side = lambda x: sized.select(F.col("class_id").alias(f"{x}_class_id"), F.col("n").alias(f"{x}_n"), F.col("t").alias(f"{x}_t"))
    overlap = F.size(F.array_intersect("a_t", "b_t"))
    return (
        candidates.join(side("a"), "a_class_id").join(side("b"), "b_class_id").withColumn("overlap", overlap).where(F.col("overlap") >= need)
        .select(
            F.least("a_class_id", "b_class_id").alias("class_a"),
            F.greatest("a_class_id", "b_class_id").alias("class_b"),
            "overlap",
            (F.col("overlap") / (F.col("a_n") + F.col("b_n") - F.col("overlap"))).alias("jaccard"),
        )
    )


def similar_record_pairs(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ``pairs`` of classes and the pairs within a class, written out for their members."""
    left, right = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    between = pairs.select("class_a", "class_b").join(left, "class_a").join(right, "class_b").select("x", "y")
    several = classes.where("n_members > 1").select("class_id")
    of = members.join(several, "class_id")
    within = (
        of.select("class_id", F.col("id").alias("x")).join(of.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y")
    )
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def linked_records(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, n_links): one row per record with the number of other records similar to it; copies stay unexpanded."""
    sizes = classes.select("class_id", "n_members")
    ends = pairs.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(
        pairs.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other"))
    )
    others = ends.join(sizes.select(F.col("class_id").alias("other"), "n_members"), "other").groupBy("class_id").agg(F.sum("n_members").alias("n_other"))
    links = sizes.join(others, "class_id", "left").select("class_id", (F.col("n_members") - 1 + F.coalesce("n_other", F.lit(0))).cast("long").alias("n_links"))
    return members.join(links, "class_id").select("id", "class_id", "n_links")


def symbol_records(proof_states: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(id, values): proof states with ``symbols`` and enriched theorems with ``key_symbols``."""
    return proof_states.select(F.col("id"), F.col("symbols").alias("values")).unionByName(
        enrichment.select(F.col("theorem_id").alias("id"), F.col("key_symbols").alias("values"))
    )
