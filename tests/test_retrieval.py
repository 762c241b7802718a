import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from lemmary.operators import fusion, metrics, retrieval, tfidf


def brute_topk(scores, k):
    return [(i, r + 1, s) for r, (s, i) in enumerate([(-a, b) for a, b in sorted((-s, i) for i, s in scores.items())][:k])]


def test_dense_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 11)
    r = random.Random(2)
    q = [(f"q{i}", [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(20)]
    c = [(f"c{i}", [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(40)]
    got = defaultdict(list)
    for a, *x in rows(retrieval.dense_top_k(spark.createDataFrame(q, "id string, v array<double>"), spark.createDataFrame(c, "id string, v array<double>"), 5)):
        got[a].append(tuple(x))
    for a, v in q:
        want = brute_topk({b: round(sum(x * y for x, y in zip(v, w, strict=True)), 9) for b, w in c}, 5)
        assert sorted(got[a], key=lambda x: x[1]) == want


def test_dense_returns_all_when_k_is_large_and_handles_empty(spark):
    s = "id string, v array<double>"
    q, c = spark.createDataFrame([("q", [1.0])], s), spark.createDataFrame([("a", [-1.0]), ("b", [0.0])], s)
    assert rows(retrieval.dense_top_k(q, c, 9)) == [("q", "a", 2, -1.0), ("q", "b", 1, 0.0)]
    none = spark.createDataFrame([], s)
    assert rows(retrieval.dense_top_k(none, c, 9)) == [] and rows(retrieval.dense_top_k(q, none, 9)) == []
    assert len(rows(retrieval.dense_top_k(c, c, 9))) == 4


def tfidf_brute(train, query, k):
    import re

    tok = lambda t: re.findall(r"\b[\w'.:]+|\S", (t or "").lower())
    df = Counter(x for _, t in train for x in set(tok(t)))
    idf = {x: math.log((1 + len(train)) / (1 + n)) + 1 for x, n in df.items()}

    def vec(t):
        w = {x: (1 + math.log(n)) * idf[x] for x, n in Counter(tok(t)).items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    tv = {i: vec(t) for i, t in train}
    out = {}
    for i, t in query:
        q = vec(t)
        s = {j: round(sum(v * w.get(x, 0) for x, v in q.items()), 9) for j, w in tv.items()}
        out[i] = brute_topk({j: v for j, v in s.items() if v > 0}, k)
    return out


@pytest.mark.parametrize("dense_share", [0, 0.1, 1])
def test_tfidf_against_brute_force(spark, monkeypatch, dense_share):
    monkeypatch.setattr(retrieval, "DENSE_SHARE", dense_share)
    r = random.Random(3)
    words = ["a", "b.c", "h₁", "(", "≤", "foo'", "bar", "baz", "qux", "zz"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))
    train, query = [(f"t{i}", text()) for i in range(30)] + [("tn", None)], [(f"q{i}", text() + " unknown") for i in range(10)] + [("qo", "unknown"), ("qn", None)]
    got = defaultdict(list)
    for a, *x in rows(tfidf.lexical_top_k(spark.createDataFrame(query, "id string, text string"), spark.createDataFrame(train, "id string, text string"), 4)):
        got[a].append(tuple(x))
    want = tfidf_brute(train, query, 4)
    for i in want:
        g = sorted(got[i], key=lambda x: x[1])
        assert [x[0] for x in g] == [x[0] for x in want[i]] and all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(g, want[i], strict=True))
    assert not got["qo"] and not got["qn"]


def test_vocabulary_cap_keeps_most_frequent(spark):
    d = spark.createDataFrame([("1", "b b a c"), ("2", "b a")], "id string, text string")
    assert rows(tfidf.vocabulary(tfidf.term_counts(d), 2), "term", "total") == [("a", 2), ("b", 3)]


def near(spark, data):
    return spark.createDataFrame(data, "query_id string, item_id string, rank int, score double")


def test_expansion_modes(spark):
    n = near(spark, [("q", "n1", 1, 0.5), ("q", "n2", 2, -0.3), ("q", "n3", 3, 0.9)])
    e = spark.createDataFrame([("n1", "p1"), ("n2", "p2"), ("n2", "p1"), ("nx", "p9")], "neighbor_id string, item_id string")
    assert rows(fusion.expand(n, e, 3, mode="rank")) == [("q", "p1", 1, 1.5), ("q", "p2", 2, 0.5)]
    assert rows(fusion.expand(n, e, 1, mode="rank")) == [("q", "p1", 1, 1.0)]
    assert rows(fusion.expand(n, e, 3, mode="sim")) == [("q", "p1", 1, 0.5), ("q", "p2", 2, 0.0)]
    assert rows(fusion.expand(n, e, 3, mode="rank_sim")) == [("q", "p1", 1, 0.5), ("q", "p2", 2, 0.0)]
    with pytest.raises(ValueError):
        fusion.expand(n, e, 3, mode="other")


def test_fusion(spark):
    s = spark.createDataFrame(
        [("a", "q", "x", 1), ("a", "q", "y", 2), ("b", "q", "y", 1), ("b", "q", "x", 2), ("b", "q", "z", 3), ("c", "q", "w", 1), ("a", "q", "y", 4)], "source string, query_id string, item_id string, rank int"
    )
    one = fusion.fuse(s.where("source = 'b'"), fusion.presets_table(spark, {"m": {"b": 2.0}}))
    assert rows(one, "item_id", "rank") == [("x", 2), ("y", 1), ("z", 3)]
    off = fusion.fuse(s, fusion.presets_table(spark, {"m": {"a": 1.0, "b": 1.0, "c": 0.0, "none": 5.0}}), 2)
    assert rows(off, "item_id", "rank", "score") == [("x", 2, 1.5), ("y", 1, 1.75)]
    tie = fusion.rank_union(s.where("rank < 4"), ["a", "b"])
    assert rows(tie, "item_id", "rank") == [("x", 1), ("y", 2), ("z", 3)]


def test_presets():
    n = {(a, b): len(fusion.active_presets(a, b)) for a in (False, True) for b in (False, True)}
    assert n == {(False, False): 13, (True, False): 15, (False, True): 14, (True, True): 17}


def brute_row(ranked, gold, pool, ks):
    g = gold & pool
    hits, ap = 0, 0.0
    for r, x in enumerate(ranked, 1):
        if x in g:
            hits += 1
            ap += hits / r
    row = [len(gold), len(g), len(gold - pool), next((r for r, x in enumerate(ranked, 1) if x in g), None), round(ap / len(g), 9) if g else 0.0]
    h = [len(set(ranked[:k]) & g) for k in ks]
    dcg = [sum(1 / math.log2(r + 1) for r, x in enumerate(ranked[:k], 1) if x in g) for k in ks]
    ideal = [sum(1 / math.log2(r + 1) for r in range(1, min(len(g), k) + 1)) for k in ks]
    return tuple([*row, *h, *[round(x / len(g), 9) if g else 0.0 for x in h], *[round(a / b, 9) if g else 0.0 for a, b in zip(dcg, ideal, strict=True)]])


def test_metrics_against_brute_force(spark):
    lists = {"q1": ["a", "b", "c"], "q2": [], "q3": ["d", "e"], "q4": ["a", "a", "b"], "q5": list("abcdefgh")}
    gold = {"q1": {"b", "d"}, "q2": {"a"}, "q3": {"x"}, "q4": {"a", "b"}, "q5": set("acgh")}
    pool, ks = set("abcdefgh") - {"d"}, (1, 2, 3)
    r = spark.createDataFrame([(q, x, i + 1) for q, v in lists.items() for i, x in enumerate(v)], "query_id string, item_id string, rank int")
    g = spark.createDataFrame([(q, x) for q, v in gold.items() for x in v], "query_id string, item_id string")
    q = spark.createDataFrame([(x,) for x in [*lists, "q6"]], "query_id string")
    got = metrics.ranking_rows(q, r, g, spark.createDataFrame([(x,) for x in pool], "id string"), ks)
    want = [(x, *brute_row(lists.get(x, []), gold.get(x, set()), pool, ks)) for x in [*lists, "q6"]]
    assert rows(got) == sorted(want, key=repr)
    s = metrics.summarize(got, ks).first().asDict()
    full = [w for w in want if w[2] > 0]
    assert s["evaluated_queries"] == 6 and s["evaluated_retrievable_queries"] == len(full)
    assert s["map"] == round(sum(w[5] for w in full) / len(full), 6)
    assert s["all_positive_recall_at_3"] == round(sum(w[8] for w in want) / sum(w[1] for w in want), 6)


def test_metric_delta(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "method string, map double")
    assert rows(metrics.metric_delta(d, "a", ["map"])) == [("a", "map", 0.5, 0.0), ("b", "map", 0.75, 0.25)]


def test_most_frequent_with_ties(spark):
    import random

    r = random.Random(4)
    data = [(f"t{i:03}", r.choice([1, 1, 1, 2, 3, 9])) for i in range(200)]
    d = spark.createDataFrame(data, "term string, total long").repartition(5)
    for limit in (1, 7, 60, 150, 199, 200, 300):
        assert rows(tfidf.most_frequent(d, limit), "term") == sorted((t,) for t, _ in sorted(data, key=lambda x: (-x[1], x[0]))[:limit])
    assert rows(tfidf.most_frequent(d.limit(0), 3)) == []


def test_blocks_and_chunks_give_what_one_product_gives(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 11)
    monkeypatch.setattr(retrieval, "CHUNK", 3)
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(20, 5)), rng.normal(size=(40, 5))
    frame = lambda x, p: spark.createDataFrame([(f"{p}{i:02}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    got = {(r["measure"], r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in retrieval.dense_and_cosine_top_k(frame(q, "q"), frame(c, "c"), 4).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 2 * 20 * 4
    for name, s in (("dot", q @ c.T), ("cosine", unit(q) @ unit(c).T)):
        s = np.round(s, 9)
        for i in range(20):
            for r, j in enumerate(np.argsort(-s[i], kind="stable")[:4]):
                assert got[name, f"q{i:02}", r + 1][0] == f"c{j:02}" and abs(got[name, f"q{i:02}", r + 1][1] - s[i, j]) < 1e-8


def test_symbol_vocabulary_is_capped(spark):
    d = spark.createDataFrame([("a", "xx yy"), ("b", "xx zz"), ("c", "xx yy ww")], "id string, text string")
    terms = tfidf.symbol_terms(d, ["text"])
    known = tfidf.symbol_vocabulary(terms, 2)
    assert rows(known) == [("xx",), ("yy",)]
    assert sorted(len(r["t"]) for r in tfidf.symbol_rows(terms, known).collect()) == [1, 2, 2]


def test_held_places_survive_many_blocks_of_candidates(spark, monkeypatch):
    """Ids that no place holds are dropped on the way; of ties the first ids stay; a row leaves a cell per query and place, however many blocks."""
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 11)
    r = random.Random(5)
    vector = lambda: [float(r.choice([-1, 0, 1, 2])) for _ in range(3)]
    q, c = [(f"q{i}", vector()) for i in range(3)], [(f"c{i:03}", vector()) for i in range(200)]
    frame = lambda x: spark.createDataFrame(x, "id string, v array<float>")
    leave, inner = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda d, *a: leave.append(d.count()) or inner(d, *a))
    got = rows(retrieval.dense_top_k(frame(q), frame(c), 2), "query_id", "rank", "item_id", "score")
    want = [(a, rank, b, s) for a, v in q for b, rank, s in brute_topk({b: sum(x * y for x, y in zip(v, w, strict=True)) for b, w in c}, 2)]
    assert got == sorted(want, key=repr) and leave == [6]


def test_a_fusion_without_encoder_sources_searches_by_one_measure(spark, monkeypatch):
    from lemmary.plans.pipeline import Pipeline

    p, asked = Pipeline(None), []
    monkeypatch.setattr(p, "together", lambda *names: asked.append(names))
    monkeypatch.setattr(p, "source", lambda name: near(spark, [("q", name, 1, 0.5)]))
    assert rows(p.sources(["dense", "lexical", "symbol"]), "item_id") == [("dense",), ("lexical",), ("symbol",)]
    names = {x for names in asked for x in names}
    assert "premise_dots" in names and not names & {"premise_searches", "state_searches"}
    asked.clear()
    p.sources(["dense", "pretrained_dense", "lexical"])
    names = {x for names in asked for x in names}
    assert "premise_searches" in names and "premise_dots" not in names


def test_hits_and_lists_are_those_of_the_single_fusions(spark, monkeypatch):
    """All methods in one pass over whole queries, however the rows are cut, rank what each fusion and source ranks alone."""
    monkeypatch.setattr(fusion, "BATCH", 7)
    r, names = random.Random(6), ["a", "b", "c"]
    weights = {"even": {"a": 1.0, "b": 1.0}, "odd": {"a": 0.7, "b": 0.0, "c": 2.5}}
    data = [(s, f"q{q}", f"p{i:02}", n) for s in names for q in range(9) if (s, q) != ("c", 4) for n, i in enumerate(r.sample(range(12), 6), 1)]
    sources = spark.createDataFrame(data, "source string, query_id string, item_id string, rank int").repartition(5)
    gold = [(f"q{q}", f"p{i:02}") for q in range(10) for i in r.sample(range(12), 3)]
    want = defaultdict(list)
    for s, q, i, n in data:
        want[s, q].append((n, i))
    for name, w in weights.items():
        for q in range(9):
            score = defaultdict(float)
            for s, x, i, n in data:
                if x == f"q{q}" and w.get(s, 0) > 0:
                    score[i] += w[s] / n
            want[name, f"q{q}"] = [(n, i) for i, n, _ in brute_topk({i: round(x, 9) for i, x in score.items()}, 4)]
    got = fusion.hits(sources, names, weights, spark.createDataFrame(gold, "query_id string, item_id string"), 4)
    assert rows(got) == sorted(((m, q, i, n) for (m, q), x in want.items() for n, i in x if (q, i) in gold), key=repr)
    wide = fusion.lists(sources, names, weights, 4)
    assert wide.columns == ["query_id", *names, *weights]
    assert rows(wide) == [(f"q{q}", *[",".join(i for _, i in sorted(want[m, f"q{q}"])) for m in [*names, *weights]]) for q in range(9)]
    fused = fusion.fuse(sources, fusion.presets_table(spark, weights), 4)
    assert rows(fused, "preset", "query_id", "item_id", "rank") == sorted(((m, q, i, n) for (m, q), x in want.items() if m in weights for n, i in x), key=repr)


def test_stored_rows_are_read_from_files_a_fraction_of_a_checkpoint(spark):
    import os

    from lemmary.operators.cut import cut, store

    def on_disk():
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)

    d = spark.range(50_000).selectExpr("concat('query ', id div 100) as query_id", "concat('item ', id % 100) as item_id", "cast(id % 100 as int) as rank")
    cut(d.limit(1))
    start = on_disk()
    kept = store(d)
    stored = on_disk() - start
    assert kept.schema == d.schema or [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in d.schema]
    assert kept.count() == 50_000 and kept.where("query_id = 'query 7' AND item_id = 'item 9'").count() == 1
    cut(d)
    assert 0 < stored * 5 < on_disk() - start - stored


def test_expansion_variants_against_brute_force(spark, monkeypatch):
    """Every variant in one pass; halves at the ninth decimal go up, as in SQL."""
    monkeypatch.setattr(fusion, "BATCH", 11)
    r = random.Random(8)
    data = [(f"q{q}", f"n{i}", n, round(r.uniform(-0.2, 1), 9)) for q in range(6) for n, i in enumerate(r.sample(range(15), 8), 1)] + [("qh", "n15", 2, 0.123456789)]
    edges = [(f"n{i}", f"p{j:02}") for i in range(14) for j in r.sample(range(9), r.randrange(0, 5))] + [("n15", "p00")]
    variants = {"a": (8, "rank"), "b": (5, "rank_sim"), "c": (3, "sim"), "d": (8, "rank_sim")}
    got = defaultdict(list)
    for s, q, *x in rows(fusion.expand_all(near(spark, data), spark.createDataFrame(edges, "neighbor_id string, item_id string"), variants, 4)):
        got[s, q].append(tuple(x))
    vote = {"rank": lambda n, s: 1 / n, "sim": lambda n, s: max(0.0, s), "rank_sim": lambda n, s: max(0.0, s) / n}
    for name, (first, mode) in variants.items():
        for q in {x[0] for x in data}:
            score = defaultdict(float)
            for a, i, n, s in data:
                for e, p in edges:
                    if a == q and e == i and n <= first:
                        score[p] += vote[mode](n, s)
            want = brute_topk({i: math.floor(x * 1e9 + 0.5) / 1e9 for i, x in score.items()}, 4)
            have = sorted(got[name, q], key=lambda x: x[1])
            assert [x[:2] for x in have] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(have, want, strict=True))
    assert got["d", "qh"] == [("p00", 1, 0.061728395)]
