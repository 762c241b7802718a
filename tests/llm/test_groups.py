import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from lemmary.llm import groups


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, small):
    r = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(120)] + [(f"r{r.randrange(90)}", f"r{r.randrange(90)}") for _ in range(80)] + [("h3", "n9"), (None, "x"), ("y", "y")]
    want = union_find([(a, b) for a, b in edges if a and b and a != b])
    got = dict(groups.components(spark.createDataFrame(edges + edges[:30], "src string, dst string"), small).collect())
    assert set(got) == set(want)
    pairing = defaultdict(set)
    for x in want:
        pairing[want[x]].add(got[x])
    assert all(len(v) == 1 for v in pairing.values()) and len({min(v) for v in pairing.values()}) == len(pairing)
    assert rows(groups.components(spark.createDataFrame([], "src string, dst string"), small)) == []


TH = "id string, full_name string, split string, comp string"
PS = "id string, theorem_id string, full_name string, comp string"


def test_groups_and_splits(spark):
    th = [("t1", "A", None, "x"), (" t2 ", "A ", None, "x"), ("t3", "B", None, "x"), ("t4", None, None, "x"), ("t1", "A", None, "x"), (None, "B", None, "x"), ("t5", " ", None, "x")]
    ps = [("p1", "t3", "C", "x"), ("p2", "t6", "C", "x"), ("p3", "t7", None, "x"), ("p3", "t8", None, "x"), ("p4", None, None, "x"), (None, "t9", "Q", "x"), (None, "t10", "Q", "x"), ("p5", " ", "", "x")]
    nodes = groups.graph_nodes(spark.createDataFrame(th, TH), spark.createDataFrame(ps, PS))
    assert rows(groups.theorem_groups(nodes)) == [("t1", "t1"), ("t1", "t2"), ("t10", "t10"), ("t10", "t9"), ("t3", "t3"), ("t3", "t6"), ("t7", "t7"), ("t7", "t8")]
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, share double")
    got = groups.split_records(nodes, targets).collect()
    assert {(r["kind"], r["id"]) for r in got} == {("theorem", f"t{i}") for i in range(1, 11)} | {("proof_state", f"p{i}") for i in range(1, 6)}
    per = defaultdict(set)
    for r in got:
        per[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in per.values())


def test_shares_with_a_hot_component(spark):
    w = [(f"c{i}", 3.0) for i in range(2000)] + [("giant", 3000.0), ("zero", 0.0)]
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, share double")
    got = dict(groups.assign_splits(spark.createDataFrame(w, "comp string, weight double"), targets).collect())
    share = Counter()
    for c, x in w:
        share[got[c]] += x / 9000
    assert len(got) == 2002 and got["giant"] == "train" and all(abs(share[s] - t) < 0.01 for s, t in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_empty(spark):
    none_t, none_p = spark.createDataFrame([], TH), spark.createDataFrame([], PS)
    nodes = groups.graph_nodes(none_t, none_p)
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert rows(nodes) == [] and rows(groups.theorem_groups(nodes)) == [] and rows(groups.split_records(nodes, targets)) == []
    w = spark.createDataFrame([("a", 1.0)], "comp string, weight double")
    assert rows(groups.assign_splits(w, targets.limit(0))) == []


def test_edges(spark):
    records = spark.createDataFrame([("proof_state", "p1", "g", "train"), ("proof_state", "p2", "h", "val")], "kind string, id string, group_id string, split string")
    e = spark.createDataFrame([("p1",), (" p1",), ("p2",), ("zz",), (None,)], "proof_state_id string")
    assert rows(groups.split_edges(e, records)) == [("none", 2), ("train", 2), ("val", 1)]
