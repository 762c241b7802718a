"""Statistics of the splits and a markdown report from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: str, column: str, limit: int | None = None) -> DataFrame:
    """(by, value, n) by count descending, value ascending; with ``limit`` the first values of each ``by``."""
    counts = df.where(F.col(column).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return counts
    order = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def other_counts(counts: DataFrame, by: str, limit: int = 8) -> DataFrame:
    """(by, listed, other, total): rows under the first ``limit`` values and under all others."""
    order = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("r", F.row_number().over(order))
    return ranked.groupBy(by).agg(
        F.sum(F.when(F.col("r") <= limit, F.col("n")).otherwise(0)).alias("listed"), F.sum(F.when(F.col("r") > limit, F.col("n")).otherwise(0)).alias("other"), F.sum("n").alias("total")
    )


def value_table(counts: DataFrame, by: str, order: tuple[str, ...], limit: int = 8) -> DataFrame:
    """(place, value, n_<each of order>, share): the first ``limit`` values of each ``by`` in turn, each value once, in the order first met.

    Then a row 'Other' with what is left. ``share`` is of the last of ``order``.
    """
    window = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.where(F.col(by).isin(*order)).withColumn("r", F.row_number().over(window))
    turn = F.coalesce(*[F.when(F.col(by) == s, i) for i, s in enumerate(order)])
    sums = [F.sum(F.when(F.col(by) == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in order]
    per = ranked.groupBy("value").agg(F.min(F.when(F.col("r") <= limit, turn * limit + F.col("r"))).alias("met"), *sums)
    listed = F.when(F.col("met").isNotNull(), F.col("value")).otherwise("Other")
    rows = per.groupBy(listed.alias("value")).agg(F.min("met").alias("met"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in order])
    total = F.greatest(F.sum(f"n_{order[-1]}").over(Window.partitionBy()), F.lit(1))  # a few dozen rows
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("met")))
    return rows.select(place.alias("place"), "value", *[f"n_{s}" for s in order], F.round(F.col(f"n_{order[-1]}") / total, 6).alias("share"))


def split_stats(theorems: DataFrame, states: DataFrame, premises: DataFrame, edges: DataFrame) -> DataFrame:
    """Per split: rows of each table, states per theorem and edges per state."""
    n = lambda d, name: d.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias(name))
    e = edges.join(states.select(F.col("id").alias("proof_state_id"), "split"), "proof_state_id")
    out = n(theorems, "theorems").join(n(states, "proof_states"), "split", "full").join(n(premises, "premises"), "split", "full").join(n(e, "positive_edges"), "split", "full").fillna(0)
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return out.withColumn("states_per_theorem", ratio("proof_states", "theorems")).withColumn("edges_per_state", ratio("positive_edges", "proof_states"))


def markdown_rows(columns: list[str], rows: list[list]) -> list[str]:
    """Lines of a markdown table; floats with four decimals."""
    fmt = lambda v: f"{v:.4f}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(map(fmt, r)) + " |" for r in rows]]


def markdown_table(df: DataFrame, columns: list[str]) -> list[str]:
    """A markdown table of a small aggregate; columns named share as percentages."""
    return markdown_rows(columns, [[percent(r[c]) if c == "share" else r[c] for c in columns] for r in df.select(*columns).collect()])


def percent(value: float | None) -> str:
    """A share with one decimal, '' if unknown."""
    return "" if value is None else f"{value:.1%}"


def all_positive(exact: float | None, recall: float | None, coverage: float | None) -> str:
    """The all-positive recall with four decimals; without it, recall times coverage marked with '~'; '' if neither is known."""
    if exact is not None:
        return f"{exact:.4f}"
    return f"~{recall * coverage:.4f}" if recall is not None and coverage is not None else ""


def signed(value: float | None, base: float | None) -> str:
    """The difference with its sign and four decimals, '' if either is unknown."""
    return f"{value - base:+.4f}" if value is not None and base is not None else ""
