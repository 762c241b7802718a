"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmary.operators.premise_stats import dominant_premises, premise_stats
from lemmary.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_premises(premise_stats(table(spark, sf_dir, "positive_edges")))


def p4_premise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return premise_stats(table(spark, sf_dir, "positive_edges"))


QUERIES = {"p4_found": p4_found, "p4_premise_stats": p4_premise_stats}

_EDGES = r"""WITH e AS (SELECT CASE WHEN regexp_matches(premise_id, '\S') THEN trim(premise_id, ' ') END AS premise_id,
 CASE WHEN regexp_matches(proof_state_id, '\S') THEN trim(proof_state_id, ' ') END AS ps, recorded_at FROM positive_edges)
"""
ORACLE = {
    "p4_found": _EDGES
    + """SELECT premise_id FROM e WHERE premise_id IS NOT NULL GROUP BY premise_id
HAVING count(*) * 100 >= (SELECT count(*) FROM e WHERE premise_id IS NOT NULL)""",
    "p4_premise_stats": _EDGES
    + """SELECT premise_id, count(*) AS n_rows, count(DISTINCT ps) AS n_proof_states, min(recorded_at) AS first_recorded_at,
 max(recorded_at) AS last_recorded_at FROM e WHERE premise_id IS NOT NULL GROUP BY premise_id""",
}
