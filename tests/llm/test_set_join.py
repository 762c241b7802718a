import random

import pytest
from conftest import rows
from lemmary.llm import set_join

SCHEMA = "id string, values array<string>, v int, class_id string"


def run(spark, data, t=0.75, k=5):
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in data], SCHEMA)
    members, classes = set_join.set_classes(d, "id", "values", k)
    pairs = set_join.similar_classes(classes, t)
    return members, classes, pairs


def brute(data, t=0.75, k=5):
    sets = {}
    for i, v in data:
        if i and i.strip():
            sets.setdefault(i.strip(" "), set()).update(x.strip(" ") for x in v or [] if x and x.strip())
    ids = sorted(i for i, s in sets.items() if len(s) >= k)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12]


@pytest.mark.parametrize("t", [0.5, 0.75, 0.9, 1.0])
def test_against_brute_force(spark, t):
    r = random.Random(int(t * 100))
    base = [[f"w{r.randrange(30)}" for _ in range(r.randrange(3, 12))] for _ in range(25)]
    data = []
    for i in range(200):
        v = list(r.choice(base))
        for _ in range(r.randrange(3)):
            v[r.randrange(len(v))] = f"w{r.randrange(30)}"
        data.append((f"r{i}", v))
    data += [("r3", data[3][1]), (" r4 ", [" " + x for x in data[4][1]]), (None, ["a"] * 9), (" ", list("abcdef")), ("n", None), ("e", []), ("d", [None, " ", "a", "b", "c", "d", "d"])]
    members, classes, pairs = run(spark, data, t)
    assert rows(set_join.similar_record_pairs(members, classes, pairs)) == sorted(brute(data, t), key=repr)


def test_copies_stay_in_classes(spark):
    data = [(f"c{i:03}", list("abcdef")) for i in range(60)] + [("x", list("abcdefg")), ("y", list("uvwxyz"))]
    members, classes, pairs = run(spark, data)
    assert classes.count() == 3 and rows(pairs, "class_a", "class_b", "overlap") == [("c000", "x", 6)]
    links = dict(set_join.linked_records(members, classes, pairs).select("id", "n_links").collect())
    assert links["c007"] == 60 and links["x"] == 60 and links["y"] == 0
    assert set_join.similar_record_pairs(members, classes, pairs).count() == 60 * 59 // 2 + 60


def test_hot_token_in_all_sets(spark):
    data = [(f"r{i}", ["hot", *[f"u{i}_{j}" for j in range(7)]]) for i in range(300)] + [("s", ["hot", *[f"u5_{j}" for j in range(7)]])]
    members, classes, pairs = run(spark, data)
    assert rows(set_join.similar_record_pairs(members, classes, pairs)) == [("r5", "s")]


def test_empty(spark):
    members, classes, pairs = run(spark, [])
    assert rows(set_join.similar_record_pairs(members, classes, pairs)) == [] and rows(set_join.linked_records(members, classes, pairs)) == []
