import numpy as np
from conftest import rows
from lemmary.llm import vectors

SCHEMA = "entity_type string, entity_id string, row_index long, embedding array<float>, c long, v int"


def brute(data, k=10, least=0.8):
    out = set()
    usable = {}
    for kind, i, _, v, *_ in data:
        if kind and i and v is not None and len(v) == 64 and all(x is not None for x in v) and any(v):
            usable[kind, i.strip()] = np.float32(v).astype(float)
    for kind in {a for a, _ in usable}:
        ids = sorted(i for a, i in usable if a == kind)
        x = np.array([usable[kind, i] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = np.round(x @ x.T, 6)
        for r, i in enumerate(ids):
            near = sorted((-c[r, j], ids[j]) for j in range(len(ids)) if j != r)[:k]
            out |= {(min(i, j), max(i, j)) for s, j in near if -s >= least}
    return out


def make(n, seed, clusters=40, spread=0.055):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = centre[r.integers(0, clusters, n)] + r.normal(size=(n, 64)) * spread
    return v * r.uniform(0.5, 3, (n, 1))


def test_recall_and_exact_scores(spark):
    v = make(1500, 1)
    data = [("A" if i % 3 else "B", f"e{i:05}", i, [float(x) for x in v[i]], 1, 1) for i in range(len(v))]
    got = {tuple(r) for r in vectors.list_pairs(vectors.nearest_lists(spark.createDataFrame(data, SCHEMA))).collect()}
    want = brute(data)
    assert len(want) > 2000 and len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98


def test_equal_vectors_nulls_repeats_and_ties(spark):
    e = [0.0] * 64
    e[3] = 2.0
    data = [("A", f"c{i:03}", i, e, 1, 1) for i in range(40)] + [("A", "c001", 1, e, 1, 1), ("A", " c002 ", 1, e, 1, 1), ("B", "c000", 0, e, 1, 1)]
    data += [("A", "zero", 0, [0.0] * 64, 1, 1), ("A", "short", 0, [1.0], 1, 1), ("A", "null", 0, None, 1, 1), ("A", "hole", 0, [None] + [1.0] * 63, 1, 1), (None, "x", 0, e, 1, 1), ("A", None, 0, e, 1, 1)]
    lists = vectors.nearest_lists(spark.createDataFrame(data, SCHEMA))
    got = {}
    for r in lists.collect():
        got.setdefault((r["kind"], r["id"]), []).append((r["rank"], r["other"], r["cosine"]))
    assert set(got) == {("A", f"c{i:03}") for i in range(40)}
    assert sorted(got["A", "c005"]) == [(r + 1, f"c{i:03}", 1.0) for r, i in enumerate(x for x in range(11) if x != 5)]
    assert sorted(got["A", "c039"]) == [(r + 1, f"c{r:03}", 1.0) for r in range(10)]


def test_empty(spark):
    assert rows(vectors.nearest_lists(spark.createDataFrame([], SCHEMA))) == []


def test_template_orders_by_expected_score():
    t = vectors.probe_template(8, 16)
    assert t[0] == (1,) and len(set(t)) == 16 and all(17 - x not in c for c in t for x in c)


def test_large_buckets_in_blocks(spark, monkeypatch):
    for name, size in (("LARGE_BUCKET", 40), ("QUERY_BLOCK", 64), ("INDEX_BLOCK", 50)):
        monkeypatch.setattr(vectors, name, size)
    v = np.concatenate([make(200, 3, 8), make(400, 4, 1, 0.004)])
    data = [("A", f"e{i:05}", i, [float(x) for x in v[i]], 1, 1) for i in range(len(v))]
    got = {tuple(r) for r in vectors.list_pairs(vectors.nearest_lists(spark.createDataFrame(data, SCHEMA))).collect()}
    want = brute(data)
    assert len(got & want) / len(want) > 0.99 and len(got & want) / len(got) > 0.99
