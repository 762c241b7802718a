import datetime as dt
import random
from collections import defaultdict

from conftest import rows
from lemmary.operators.premise_stats import distinct_edges, dominant_premises, premise_stats
from lemmary.operators.skew import key_counts, salts, with_key_counts
from pyspark.sql import functions as F

SCHEMA = "proof_state_id string, premise_id string, recorded_at timestamp, n_rows int, ps string"


def t(i):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)


def test_against_brute_force_with_a_hot_key(spark):
    r = random.Random(1)
    data = [(f"ps{r.randrange(200)}", "hot" if r.random() < 0.4 else f" p{r.randrange(60)}" + " " * r.randrange(2), t(r.randrange(999)), 1, "x") for _ in range(3000)]
    data += [(None, "hot", t(5000), 1, "x"), ("  ", "hot", None, 1, "x"), ("a", None, t(1), 1, "x"), ("a", " ", t(1), 1, "x")]
    want = defaultdict(lambda: [0, set(), []])
    for ps, p, at, *_ in data:
        p = (p or "").strip()
        if p:
            w = want[p]
            w[0] += 1
            if ps and ps.strip():
                w[1].add(ps.strip())
            if at:
                w[2].append(at)
    got = premise_stats(spark.createDataFrame(data, SCHEMA), cells=40)
    assert rows(got) == sorted([(p, n, len(s), min(a), max(a)) for p, (n, s, a) in want.items()], key=repr)
    total = sum(w[0] for w in want.values())
    assert rows(dominant_premises(got, 0.01)) == sorted([(p,) for p, w in want.items() if w[0] * 100 >= total], key=repr)


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(premise_stats(empty)) == [] and rows(dominant_premises(premise_stats(empty))) == []
    nulls = spark.createDataFrame([("a", None, None, 1, "x")], SCHEMA)
    assert rows(premise_stats(nulls)) == []
    alone = spark.createDataFrame([(None, "p", None, 1, "x")] * 2, SCHEMA)
    assert rows(premise_stats(alone)) == [("p", 2, 0, None, None)]


def test_exact_share_counts(spark):
    data = [(f"s{i}", "p7" if i < 7 else f"q{i}", t(i), 1, "x") for i in range(700)]
    assert rows(dominant_premises(premise_stats(spark.createDataFrame(data, SCHEMA)))) == [("p7",)]


def test_key_counts_keep_all_rows(spark):
    d = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 1), (None, 1)], "k string, i int")
    got = with_key_counts(d, "k", [F.col("i")], "n", share=0.2)
    assert sorted(set(rows(got, "k", "n"))) == [("a", 50), ("b", 1), ("c", 1)] and got.count() == 52


def test_every_dominant_premise_is_salted_at_every_size(spark):
    """A dozen premises with half of all edges: each has several salts, also in the smallest table, in line with its share."""
    for n in (1_000, 20_000):
        data = [(f"s{i}", f"hot{i % 12}" if i % 2 else f"p{i}", t(i), 1, "x") for i in range(n)]
        got = {r["premise_id"]: r["n_salts"] for r in salts(key_counts(distinct_edges(spark.createDataFrame(data, SCHEMA)), "premise_id", F.col("n"))).collect()}
        assert {k for k in got if k.startswith("hot")} == {f"hot{i}" for i in range(1, 12, 2)} and all(got[k] >= 20 for k in got if k.startswith("hot"))


def test_cut_needs_a_shared_folder_on_clusters():
    import pytest
    from lemmary.operators.cut import ensure_checkpoint_dir

    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Fake)
