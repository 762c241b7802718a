"""Problem 8: documents into containers of fixed capacity, by first-fit decreasing in randomised groups.

A tournament tree over the free room of a group's containers finds the first one that fits in logarithmic time. Groups are
drawn by the hash of the document id and sized by tokens, so their number grows with the corpus while a group stays
bounded; each leaves at most its last containers part-filled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.operators.cut import cut


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item, items taken from the largest to the smallest, ties in the given order."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # node i: most room below it; leaf j at leaves + j
    place = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        need, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        place[i] = node - leaves
        room[node] -= need
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return place


def pack(sizes: DataFrame, budgets: DataFrame, containers_per_group: int = 2048, pack_group: Callable[[np.ndarray, int], np.ndarray] = first_fit_decreasing) -> DataFrame:
    """(budget, doc_id, piece, n_tokens, container): every document with tokens in containers of each budget's capacity.

    ``sizes``: (doc_id, n_tokens), ``budgets``: (budget, capacity_tokens). A document longer than the capacity is cut into
    full pieces, which are containers by themselves, and a rest; no other document is split. Documents with no (or a null
    number of) tokens take no place. Budgets without a positive capacity give no rows. Rows of one doc_id count each, their
    pieces being numbered alike.
    """
    b = [(r["budget"], int(r["capacity_tokens"])) for r in budgets.where("budget IS NOT NULL AND capacity_tokens > 0").distinct().collect()]
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    docs = cut(sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n")).where("n > 0"))
    total = docs.agg(F.sum("n")).first()[0] or 0
    caps = [F.struct(F.lit(n).alias("budget"), F.lit(c).cast("long").alias("capacity"), F.lit(max(1, round(total / (c * containers_per_group)))).cast("long").alias("groups")) for n, c in b]
    empty = F.array().cast("array<struct<budget:string,capacity:bigint,groups:bigint>>")
    each = docs.select("doc_id", "n", F.inline(F.array(*caps) if caps else empty))
    full = each.where("n >= capacity").select(
        "budget", "doc_id", F.posexplode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / F.col("capacity")))).alias("piece", "x"), F.col("capacity").alias("n_tokens")
    )
    full = full.select("budget", "doc_id", "piece", "n_tokens", F.concat(F.lit("full:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("piece").cast("string")).alias("container"))
    rest = each.withColumn("n_tokens", F.col("n") % F.col("capacity")).where("n_tokens > 0")
    rest = rest.select(
        "budget", "capacity", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.col("groups")).alias("grp"), "doc_id", F.floor(F.col("n") / F.col("capacity")).cast("int").alias("piece"), "n_tokens"
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        place = pack_group(table.column("n_tokens").to_numpy(), table.column("capacity")[0].as_py())
        group = table.column("grp")[0].as_py()
        names = pa.array([f"{group}:{x}" for x in place.tolist()])
        return pa.table([table.column(c) for c in ("budget", "doc_id", "piece", "n_tokens")] + [names], names=["budget", "doc_id", "piece", "n_tokens", "container"])

    packed = rest.groupBy("budget", "grp").applyInArrow(run, f"budget string, doc_id {id_type}, piece int, n_tokens long, container string")
    return full.unionByName(packed)


def packing_summary(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget, n_containers, n_tokens, fill): how full the containers are; ``fill`` is tokens over room."""
    per = packed.groupBy("budget", "container").agg(F.sum("n_tokens").alias("used"))
    per = per.groupBy("budget").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"))
    caps = budgets.select("budget", "capacity_tokens").distinct()
    return per.join(caps, "budget").select("budget", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))
