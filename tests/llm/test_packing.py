import random
from collections import defaultdict

import numpy as np
from conftest import rows
from lemmary.llm import packing


def naive(sizes, capacity):
    room, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        place[i] = b
    return place


def test_tree_equals_naive_first_fit_decreasing():
    r = random.Random(7)
    for n in (0, 1, 2, 17, 300):
        s = [r.randrange(1, 101) for _ in range(n)]
        assert packing.first_fit_decreasing(np.array(s, np.int64), 100).tolist() == naive(s, 100)


SIZES, BUDGETS = "doc_id long, n_tokens long, budget string", "budget string, capacity_tokens int"


def test_pack(spark):
    r = random.Random(8)
    data = [(i, r.randrange(0, 300), "x") for i in range(1500)] + [(9001, 10_000, "x"), (9002, 1024, "x"), (9003, None, "x"), (9004, 2048, "x")]
    b = spark.createDataFrame([("s", 1024), ("l", 4096), ("s", 1024), (None, 5), ("none", 0)], BUDGETS)
    got = packing.pack(spark.createDataFrame(data, SIZES), b, containers_per_group=20)
    used, docs = defaultdict(int), defaultdict(list)
    for x in got.collect():
        used[x["budget"], x["container"]] += x["n_tokens"]
        docs[x["budget"], x["doc_id"]].append(x["n_tokens"])
    for name, cap in (("s", 1024), ("l", 4096)):
        assert all(u <= cap for (k, _), u in used.items() if k == name)
        for i, n, _ in data:
            assert sum(docs.get((name, i), [])) == (n or 0)
            assert len(docs.get((name, i), [])) == -(-(n or 0) // cap)
    assert {k for k, _ in used} == {"s", "l"}
    fill = {x["budget"]: x["fill"] for x in packing.packing_summary(got, b.where("budget IN ('s', 'l')")).collect()}
    assert fill["s"] > 0.95 and fill["l"] > 0.9


def test_empty(spark):
    b = spark.createDataFrame([("s", 1024)], BUDGETS)
    assert rows(packing.pack(spark.createDataFrame([], SIZES), b)) == []
    assert rows(packing.pack(spark.createDataFrame([(1, 5, "x")], SIZES), b.limit(0))) == []
