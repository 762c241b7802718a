import random
import re

import numpy as np
import pytest
from conftest import rows
from lemmary.llm import overlap
from pyspark.sql import functions as F

SCHEMA = "id string, text string, split string, k string, n int"


def of(spark, data, kind="t"):
    return spark.createDataFrame(data, SCHEMA).withColumn("kind", F.lit(kind))


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def brute(data, t=0.75, least=40):
    side = {"train": "train", "val": "eval", "test": "eval"}
    kept = [(i.strip(), norm(x), side[s]) for i, x, s, *_ in data if i and i.strip() and x and s in side and len(norm(x)) >= least]
    out = set()
    for i, x, a in kept:
        for j, y, b in kept:
            if a == "eval" and b == "train" and i != j:
                g, h = grams(x), grams(y)
                if len(g & h) / len(g | h) >= t:
                    out.add((i, j))
    return sorted(out)


def edited(r, t):
    for _ in range(r.randrange(0, 9)):
        i, kind = r.randrange(len(t)), r.randrange(4)
        if kind == 0:
            t = t[:i] + r.choice("abcxyz≤") + t[i:]
        elif kind == 1:
            t = t[:i] + t[i + 1 :]
        elif kind == 2:
            j = r.randrange(len(t))
            t = t[min(i, j) :] + t[: min(i, j)] if r.random() < 0.2 else t
        else:
            t = t[:i] + "  " + t[i:].upper()
    return t + (" " + "".join(r.choice("pqrs ") for _ in range(r.randrange(40))) if r.random() < 0.4 else "")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["⊢ " + "".join(r.choice("abcdefgh  .≤") for _ in range(r.randrange(30, 140))) for _ in range(25)]
    data = [(f"r{i:03}", edited(r, r.choice(base)), r.choice(["train", "train", "val", "test", None]), "x", 1) for i in range(160)]
    data += [("copy", data[0][1], "val", "x", 1), ("copy", data[0][1], "train", "x", 1), ("n", None, "val", "x", 1), (None, base[0], "val", "x", 1), ("e", "", "train", "x", 1), ("short", "abc", "test", "x", 1)]
    data += [("long1", "lorem ipsum dolor " * 300 + "a", "train", "x", 1), ("long2", "lorem ipsum dolor " * 290, "test", "x", 1)]
    other = of(spark, [("zz", *x[1:]) for x in data if x[2] == "val"], "u")  # the same texts in another table meet nothing
    got = overlap.cross_split_pairs(of(spark, data).unionByName(other))
    assert rows(got.select("eval_id", "train_id").distinct()) == [tuple(x) for x in brute(data)]


def test_empty(spark):
    none = of(spark, [])
    assert rows(overlap.cross_split_pairs(none)) == [] and rows(overlap.cross_split_names(none)) == []
    assert rows(overlap.cross_split_pairs(of(spark, [("a", "x" * 50, "train", "x", 1)]))) == []


def test_names(spark):
    data = [("a", "Foo.bar_baz", "train", "", 1), ("b", "foobarBAZ'", "val", "", 1), ("c", "...", "val", "", 1), ("d", "..", "train", "", 1), (" a ", "Foo.bar_baz", "train", "", 1), ("e", "foobarbaz", None, "", 1), ("f", None, "val", "", 1)]
    found = overlap.cross_split_names(of(spark, data, "theorems"))
    assert rows(found.select("eval_id", "train_id")) == [("b", "a")]
    assert rows(overlap.found_pairs(found)) == [("theorems", "a", "b")]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_banded_distances():
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab≤c") for _ in range(r.randrange(0, 25)))
    pairs = [(word(), word()) for _ in range(150)] + [("", ""), ("", "abc"), ("abc", "")]
    bands = [r.randrange(0, 12) for _ in pairs]
    got = overlap.banded_distances(pairs, bands)
    assert got == [d if (d := distance(a, b)) <= w else None for (a, b), w in zip(pairs, bands, strict=True)]


def test_substring_hashes_are_the_substrings():
    texts = ["abcabcabc", "", "abcd", "abcde", "≤≥≠∈∉x"]
    h, owner, pos = overlap.substring_hashes(texts, 5)
    assert [len(set(h[owner == i])) for i in range(5)] == [len(grams(t)) for t in texts]
    assert pos[owner == 0].tolist() == [0, 1, 2, 3, 4] and h[0] == h[3]
    h, owner, _ = overlap.substring_hashes(["zzabcde", "abcdeyy"], 5)
    assert len(set(h[owner == 0]) & set(h[owner == 1])) == 1
    assert len(overlap.substring_hashes([], 5)[0]) == 0 and len(overlap.substring_hashes(["a", ""], 5)[0]) == 0


@pytest.mark.parametrize("size", [3, 5])
def test_edits_break_no_more_segments_than_allowed(size):
    """Greedy worst cases: characters left out at slot borders until the similarity would fall under the threshold."""
    r, width = random.Random(3), 2 * size - 1
    gram = lambda t: {t[i : i + size] for i in range(len(t) - size + 1)}
    for length in range(40, 400, 7):
        a = "".join(chr(0x4E00 + i) for i in range(length))
        slots = length // width
        starts = [j * length // slots for j in range(slots)]
        for step in (1, 2, 3):
            b = [*a]
            worst = 0
            for s in [0, length - 1, *starts[1::step], *r.sample(range(length), length // 9)]:
                before = b[:]
                b[s] = ""
                if s in starts and s:
                    b[s - 1] = ""
                x, y = gram(a), gram("".join(b))
                if len(x & y) < 0.75 * len(x | y):
                    b = before
                worst = max(worst, sum(a[p : p + width] not in "".join(b) for p in starts))
            assert worst <= overlap.allowed_breaks(np.array([length - size + 1]), 0.75, size)[0]


def test_paths(spark):
    r = random.Random(9)
    a = "".join(chr(0x4E00 + r.randrange(9000)) for _ in range(200))
    binders = [f"({x} : ℕ) " for x in "abcdefghijklmnop"]
    data = [("a", a, "train", "", 1), ("b", a[:50] + "x" + a[52:], "val", "", 1), ("c", a[100:] + a[:100], "test", "", 1), ("d", a, "test", "", 1)]
    data += [("e", "".join(binders), "train", "", 1), ("f", "".join(binders[::-1]), "val", "", 1)]
    found = overlap.cross_split_pairs(of(spark, data))
    assert rows(found.select("eval_id", "path", "edits")) == [("b", "edits", 2), ("c", "sets", None), ("d", "equal", 0), ("f", "sets", 16)]
    assert rows(overlap.pair_paths(found).select("table_name", "path", "n_pairs")) == [("t", "edits", 1), ("t", "equal", 1), ("t", "sets", 2)]


def test_passes_over_shares_of_the_keys_find_the_same(spark, monkeypatch):
    """Large corpora are joined in passes, so that the rows of all keys never lie on disk at once; no key is left out or joined twice."""
    r = random.Random(7)
    base = ["⊢ " + "".join(r.choice("abcdefgh  .≤") for _ in range(r.randrange(40, 120))) for _ in range(12)]
    data = [(f"r{i:03}", edited(r, r.choice(base)), r.choice(["train", "val"]), "x", 1) for i in range(80)]
    chars = sum({norm(x[1]): len(norm(x[1])) for x in data if len(norm(x[1])) >= 40}.values())
    monkeypatch.setattr(overlap, "PASS_CHARS", chars / 9)
    shares, inner = [], overlap._pairs_of_share
    monkeypatch.setattr(overlap, "_pairs_of_share", lambda *a: shares.append(a[-1]) or inner(*a))
    got = overlap.cross_split_pairs(of(spark, data))
    assert rows(got.select("eval_id", "train_id").distinct()) == [tuple(x) for x in brute(data)] and shares == [(0, 3), (1, 3), (2, 3)]
    texts = [norm(x[1]) for x in data]
    counts = np.zeros((2, 1 << overlap.COUNT_BITS), np.uint8)
    keys = lambda *share: sorted(overlap.Keys(texts, ["t"] * len(texts), counts, 0.75, 5, None, *share).h.tolist())
    assert sorted(x for i in range(3) for x in keys((i, 3))) == keys()
