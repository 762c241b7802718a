import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import rows
from lemmary.llm import cooccurrence

SCHEMA = "b string, i string, item string, n int"


def brute(data, min_count, min_lift):
    edges = {(b.strip(" "), i.strip(" ")) for b, i, *_ in data if b and b.strip() and i and i.strip()}
    baskets = {}
    for b, i in edges:
        baskets.setdefault(b, set()).add(i)
    n, deg = len(baskets), Counter(i for _, i in edges)
    c = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return sorted((a, b, x, deg[a], deg[b]) for (a, b), x in c.items() if x >= min_count and x * n >= min_lift * deg[a] * deg[b])


@pytest.mark.parametrize(("max_heavy", "block"), [(512, 1000), (4, 7), (1, 3)])
def test_against_brute_force(spark, monkeypatch, max_heavy, block):
    r = random.Random(6)
    data = []
    for b in range(400):
        pop = [f"i{min(int(r.expovariate(0.08)), 79):02}" for _ in range(r.randrange(1, 9))]
        data += [(f"b{b}", i, "x", 1) for i in pop] + ([(f" b{b} ", "twin1", "x", 1), (f"b{b}", " twin2", "x", 1)] if b % 37 == 0 else [])
    data += [("huge", f"i{k:02}", "x", 1) for k in range(80)] + [(None, "i01", "x", 1), ("b1", None, "x", 1), (" ", "i01", "x", 1)]
    for min_lift in (1.0, 3.0):
        got = cooccurrence.cooccurring_pairs(spark.createDataFrame(data + data[:50], SCHEMA), "b", "i", 3, min_lift, max_heavy, block)
        assert rows(got, "item_a", "item_b", "n_both", "n_a", "n_b") == sorted(brute(data, 3, min_lift), key=repr)


def test_heavy_items_use_the_bit_matrix(spark):
    data = [(f"b{k}", i, "x", 1) for k in range(2000) for i in ("h1", "h2", "h3") if (k * (int(i[1]) + 6)) % 7 < 5]
    got = cooccurrence.cooccurring_pairs(spark.createDataFrame(data, SCHEMA), "b", "i", 5, 0.1, 64)
    assert rows(got, "item_a", "item_b", "n_both", "n_a", "n_b") == sorted(brute(data, 5, 0.1), key=repr)


def test_empty(spark):
    assert rows(cooccurrence.cooccurring_pairs(spark.createDataFrame([], SCHEMA), "b", "i")) == []


def test_a_basket_larger_than_a_block_is_cut_at_every_size(spark):
    """700 light items in one basket and blocks of 100: 49 pairs of blocks, none of which counts more than 100 x 100 pairs."""
    data = [("big", f"i{i:03}") for i in range(700)] + [(f"b{j}", f"i{i:03}") for i in range(0, 700, 7) for j in range(i, i + 3)] + [(f"b{j}", f"i{i + 1:03}") for i in range(0, 700, 7) for j in range(i, i + 3)]
    d = spark.createDataFrame(data, "basket string, item string")
    got = {(r["item_a"], r["item_b"]): r["n_both"] for r in cooccurrence.cooccurring_pairs(d, "basket", "item", min_count=4, min_lift=1.0, block=100).collect()}
    assert got == {(f"i{i:03}", f"i{i + 1:03}"): 4 for i in range(0, 700, 7)}
