"""Problem 4: results per premise although a dozen premises hold half of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.operators.cut import cut, release
from lemmary.operators.skew import salted_aggregate


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(premise_id, ps, n, lo, hi): each edge once with its number of rows and its first and last time."""
    rows = edges.select(clean_key("premise_id").alias("premise_id"), clean_key("proof_state_id").alias("ps"), F.col("recorded_at").alias("at"))
    return rows.where("premise_id IS NOT NULL").groupBy("premise_id", "ps").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def premise_stats(edges: DataFrame, cells: int | None = None) -> DataFrame:
    """Rows, distinct proof states and first and last ``recorded_at`` of each premise, by two-stage salted aggregation.

    The table is read once: repeated edges are combined first, spread by premise and state. Then the edges of heavy
    premises are split over salts, and the partial results merged by premise.

    Repeated rows count each in ``n_rows`` and once in ``n_proof_states``; ids are compared without spaces at both ends;
    rows with a null or blank premise are left out, those with a null or blank proof state count as rows only. Null times
    are ignored (all null: null). An empty table gives no rows.
    """
    distinct = cut(distinct_edges(edges))
    stats = cut(
        salted_aggregate(
            distinct,
            "premise_id",
            [F.col("ps")],
            [F.sum("n").alias("n"), F.count("ps").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")],
            [F.sum("n").alias("n_rows"), F.sum("d").alias("n_proof_states"), F.min("lo").alias("first_recorded_at"), F.max("hi").alias("last_recorded_at")],
            F.col("n"),
            cells,
        )
    )
    release(distinct)
    return stats


def dominant_premises(stats: DataFrame, share: float = 0.01) -> DataFrame:
    """Premises with at least ``share`` of all rows in ``stats``; at most ``1 / share`` of them."""
    total = stats.agg(F.sum("n_rows")).first()[0] or 0
    return stats.where(F.col("n_rows") / F.lit(total) >= F.lit(share)).select("premise_id")
