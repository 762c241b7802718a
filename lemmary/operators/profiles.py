"""Text profiles of proof states, premises and theorems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_values
from lemmary.functions.text import facet_text, lines, tags, words


def proof_state_profile() -> Column:
    """Name, tags, hypotheses, goal and symbols of a state, one non-empty part per line; never its premises."""
    return lines("full_name", tags("domain_tag", "subdomain_tag"), words("local_hypotheses"), "goal_text", words("symbols"))


def premise_profile() -> Column:
    return lines("full_name", "file_path", tags("domain_tag", "subdomain_tag"), "code")


def first_states(states: DataFrame, max_states: int = 5) -> DataFrame:
    """The first states of each theorem by tactic index (null last), then id, with their place ``n``."""
    order = Window.partitionBy("theorem_id").orderBy(F.asc_nulls_last("tactic_idx"), "id")
    return states.where("theorem_id IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_states)


def theorem_profiles(theorems: DataFrame, states: DataFrame, max_states: int = 5, arrays: bool = True) -> DataFrame:
    """Theorems with ``profile_text``: name, path, tags, goals, sorted distinct symbols and up to 12 hypotheses of the first states.

    ``arrays=False`` leaves symbols and hypotheses out. A theorem without states keeps its own parts.
    """
    item = F.struct("n", F.coalesce("goal_text", F.lit("")).alias("g"), F.coalesce("symbols", F.array().cast("array<string>")).alias("s"), F.coalesce("local_hypotheses", F.array().cast("array<string>")).alias("h"))
    grouped = first_states(states, max_states).groupBy("theorem_id").agg(F.array_sort(F.collect_list(item)).alias("st"))
    goals = F.array_join(F.filter(F.transform("st", lambda x: x["g"]), lambda x: x.rlike(r"\S")), "\n")
    symbols = F.array_join(clean_values(F.flatten(F.transform("st", lambda x: x["s"]))), " ")
    hyps = F.array_join(F.slice(F.flatten(F.transform("st", lambda x: F.slice(F.filter(x["h"], lambda y: y.isNotNull()), 1, 4))), 1, 12), "\n")
    parts = ["full_name", "file_path", tags("domain_tag", "subdomain_tag"), goals, *([symbols, hyps] if arrays else [])]
    joined = theorems.join(grouped, theorems["id"] == grouped["theorem_id"], "left").drop("theorem_id")
    return joined.select(
        F.col("id").alias("theorem_id"), "full_name", "file_path", "domain_tag", "subdomain_tag", "split",
        lines(*parts).alias("profile_text"), F.greatest(F.coalesce(F.size("st"), F.lit(0)), F.lit(0)).alias("profile_proof_state_count"), F.lit(max_states).alias("profile_max_states"),
    )


def enrichment_text() -> Column:
    """The nine parts of an enrichment row in their order, one non-empty part per line."""
    return lines(
        "topic", "goal_pattern", words("mathematical_objects"), words("key_symbols"), words("useful_lemma_types"),
        facet_text("strategy_facets"), words("likely_tactics"), words("difficulty_reasons"), "difficulty_bucket_hint",
    )


def append_enrichment(profiles: DataFrame, enrichment: DataFrame) -> DataFrame:
    """``profiles`` with ``llm_enrichment_text``, which also ends ``profile_text``; theorems without enrichment get none."""
    extra = enrichment.select(F.col("theorem_id"), enrichment_text().alias("llm_enrichment_text"))
    out = profiles.join(extra, "theorem_id", "left").withColumn("llm_enrichment_text", F.coalesce("llm_enrichment_text", F.lit("")))
    return out.withColumn("profile_text", lines("profile_text", "llm_enrichment_text"))
