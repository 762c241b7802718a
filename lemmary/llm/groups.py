"""Problem 3: train, val and test without a theorem in two of them, by frontier breadth-first components.

Adjacency lists are hash-partitioned by node. Every node whose hash is below those of all its neighbours is a seed (each
component has one); all seeds expand at once, one level per round, a node joining the smallest label that reaches it
first. Edges between differently labelled nodes make the small graph of colliding labels, whose components merge the
labels: in one task while it is small, by the same method again beyond that. Components then take their split in hash order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.operators.cut import cut

#: Largest graph of labels (edges) that a single task merges.
SMALL_GRAPH = 250_000


def _merge_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one bounded edge list; the root of a set is its smallest label."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for f in frames:
        for a, b in zip(f["src"], f["dst"], strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "comp": [root(x) for x in nodes]})


def components(edges: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(node, comp) for every node of ``edges`` (src, dst: strings); nodes are connected iff they have the same ``comp``.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows. A hub's adjacency list is one
    skewed key of a join without further conditions, which adaptive execution splits over tasks.
    """
    one_way = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    adj = cut(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    owned = cut(adj.groupBy("src").agg(F.min(rank("dst")).alias("least")).where(rank("src") < F.col("least")).select(F.col("src").alias("node"), F.col("src").alias("label")))
    frontier = owned
    while True:
        reached = frontier.join(adj, frontier["node"] == adj["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        frontier = cut(reached.join(owned.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        owned = owned.unionByName(frontier)
    owned = cut(owned)
    at = lambda node, label: owned.select(F.col("node").alias(node), F.col("label").alias(label))
    collisions = cut(
        adj.where("src < dst").join(at("src", "la"), "src").join(at("dst", "lb"), "dst").where("la != lb").select(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst")).distinct()
    )
    size = collisions.count()
    if not size:
        return owned.select("node", F.col("label").alias("comp"))
    if size <= small_graph:
        merged = collisions.coalesce(1).mapInPandas(_merge_small, "node string, comp string")
    else:
        merged = components(collisions, small_graph)
    roots = cut(merged).select(F.col("node").alias("label"), "comp")
    return owned.join(roots, "label", "left").select("node", F.coalesce("comp", "label").alias("comp"))


def graph_nodes(theorems: DataFrame, proof_states: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(kind, key, comp): every theorem id ('t'), proof state id ('p') and full name ('n') with its component.

    Rows belong together if they share a theorem id, a full name or a proof state id, also through further rows. Ids and
    names are compared without spaces at both ends; null and blank ones link nothing.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), clean_key(c))
    th = theorems.select(node("t", "id").alias("t"), node("n", "full_name").alias("n")).distinct()
    ps = proof_states.select(node("p", "id").alias("p"), node("t", "theorem_id").alias("t"), node("n", "full_name").alias("n")).distinct()
    # a proof state ties all its keys to the smallest of them, so that the graph holds no proof states
    touches = cut(ps.select("p", F.explode(F.array("t", "n")).alias("key")).where("p IS NOT NULL AND key IS NOT NULL").distinct())
    centre = cut(touches.groupBy("p").agg(F.min("key").alias("centre")))
    edges = (
        touches.join(centre, "p").where("key != centre").select(F.col("centre").alias("src"), F.col("key").alias("dst"))
        .unionByName(th.select(F.col("t").alias("src"), F.col("n").alias("dst")))
        .unionByName(ps.where("p IS NULL").select(F.col("t").alias("src"), F.col("n").alias("dst")))
    )
    comp = cut(components(edges, small_graph))
    keys = th.select(F.explode(F.array("t", "n")).alias("node")).unionByName(touches.select(F.col("key").alias("node"))).unionByName(
        ps.where("p IS NULL").select(F.explode(F.array("t", "n")).alias("node"))
    )
    keyed = keys.where("node IS NOT NULL").distinct().join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    states = (
        ps.where("p IS NOT NULL").select(F.col("p").alias("node")).distinct()
        .join(centre.withColumnRenamed("p", "node"), "node", "left")
        .join(comp.withColumnRenamed("node", "centre"), "centre", "left")
        .select("node", F.coalesce("comp", "centre", "node").alias("comp"))
    )
    return keyed.unionByName(states).select(F.substring("node", 1, 1).alias("kind"), F.expr("substring(node, 3)").alias("key"), "comp")


def theorem_groups(nodes: DataFrame) -> DataFrame:
    """(group_id, theorem_id): theorem ids of components with two or more of them; group_id is the smallest."""
    t = nodes.where("kind = 't'").select("comp", F.col("key").alias("theorem_id"))
    groups = t.groupBy("comp").agg(F.min("theorem_id").alias("group_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return t.join(groups, "comp").select("group_id", "theorem_id")


def _place_large(targets: list[tuple[str, float]], total: float):  # noqa: ANN202
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"comp": [], "weight": []}), *frames])
        left = {s: share * total for s, share in targets}
        out = []
        for comp, w in sorted(zip(rows["comp"], rows["weight"], strict=True), key=lambda x: (-x[1], x[0])):
            best = max(left, key=lambda s: (left[s], s))
            left[best] -= w
            out.append((comp, best, float(w)))
        yield pd.DataFrame(out, columns=["comp", "split", "weight"])

    return place


def assign_splits(weights: DataFrame, targets: DataFrame, large_share: float = 0.005, buckets: int = 4096) -> DataFrame:
    """(comp, split): each component whole in one split, weights close to ``targets`` (split, share).

    ``weights`` is (comp, weight). Components with ``large_share`` or more of all weight (at most ``1 / large_share``) go
    one after the other to the split with most room; the rest follow in hash order, the splits taking consecutive ranges
    of the running weight. The running weight is summed over ``buckets`` ranges of the hash first, so no window holds more
    than one range. Shares need not add to 1; without targets there are no rows.
    """
    goal = sorted((r["split"], float(r["share"])) for r in targets.where("split IS NOT NULL AND share > 0").distinct().collect())
    whole = sum(s for _, s in goal)
    goal = [(n, s / whole) for n, s in goal]
    w = cut(weights)
    total = float(w.agg(F.sum("weight")).first()[0] or 0)
    if not goal:
        return w.select("comp", F.lit(None).cast("string").alias("split")).where("false")
    is_large = (F.col("weight") >= F.lit(large_share * total)) & (F.col("weight") > 0)
    large = cut(w.where(is_large).coalesce(1).mapInPandas(_place_large(goal, total), "comp string, split string, weight double"))
    used = {r["split"]: r["w"] for r in large.groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    room = [(n, max(s * total - used.get(n, 0.0), 0.0)) for n, s in goal]
    free = sum(x for _, x in room) or 1.0
    ranked = w.where(~is_large).withColumn("h", F.xxhash64("comp")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)).cast("int"))
    rest = float(w.where(~is_large).agg(F.sum("weight")).first()[0] or 0)
    sums = ranked.groupBy("bucket").agg(F.sum("weight").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("weight").over(Window.partitionBy("bucket").orderBy("h", "comp")) - F.col("weight") / 2
    place = ranked.withColumn("inside", inside).join(F.broadcast(before), "bucket").withColumn("at", (F.col("before") + F.col("inside")) / F.lit(rest or 1.0))
    split, edge = F.lit(goal[-1][0] if not any(x for _, x in room) else [n for n, x in room if x][-1]), sum(x for _, x in room)
    for name, x in reversed(room):
        edge -= x
        if x:
            split = F.when(F.col("at") >= F.lit((edge + x) / free), split).otherwise(F.lit(name))
    return large.select("comp", "split").unionByName(place.select("comp", split.alias("split")))


def split_records(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, id, group_id, split) of all theorem ids and proof state ids; a component's weight is its number of proof states."""
    n = cut(nodes)
    weights = n.groupBy("comp").agg(F.count(F.when(F.col("kind") == "p", 1)).cast("double").alias("weight"))
    splits = cut(assign_splits(weights, targets))
    kind = F.when(F.col("kind") == "t", F.lit("theorem")).otherwise(F.lit("proof_state"))
    return n.where("kind IN ('t', 'p')").join(splits, "comp").select(kind.alias("kind"), F.col("key").alias("id"), F.col("comp").alias("group_id"), "split")


def split_edges(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(split, n_edges): rows of ``edges`` by the split of their proof state; 'none' for unknown, null and blank ids."""
    states = records.where("kind = 'proof_state'").select(F.col("id").alias("ps"), "split")
    keyed = edges.select(clean_key("proof_state_id").alias("ps")).groupBy("ps").agg(F.count(F.lit(1)).alias("n"))
    return keyed.join(states, "ps", "left").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.sum("n").alias("n_edges"))
