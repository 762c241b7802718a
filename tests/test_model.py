from conftest import rows
from lemmary.plans.model import Model, whole_rows

STATE = "id string, theorem_id string, full_name string, tactic_idx int, context string, goal_text string, local_hypotheses array<string>, symbols array<string>, tactic string, domain_tag string, subdomain_tag string, split string"


def state(i, t, split="train", name=None, tactic="simp at h", goal="g", idx=0):
    return (i, t, name, idx, None, goal, None, None, tactic, None, None, split)


def test_whole_rows_keep_values_together(spark):
    d = spark.createDataFrame([("k", "b", 1), ("k", "a", 9), ("k", None, 0), ("m", None, 3), ("m", None, 2)], "k string, x string, y int")
    assert rows(whole_rows(d, ["k"], ["x", "y"])) == [("k", "a", 9), ("m", None, 2)]


def test_a_state_under_several_theorems_keeps_all_links(spark, tmp_path):
    data = [state(" s1", "t2 "), state("s1", "t1", name="N"), state("s1", "t1", name="N"), state("s2", None), state("s3", "  "), state("s4", "t1", "val"), state("s4", "t1", None)]
    spark.createDataFrame(data, STATE).write.parquet(str(tmp_path / "proof_states.parquet"))
    edges = [("s1", "p", None), ("s1 ", "p", None), ("s4", "q", None), ("s2", "p", None), (None, "p", None)]
    spark.createDataFrame(edges, "proof_state_id string, premise_id string, recorded_at timestamp").write.parquet(str(tmp_path / "positive_edges.parquet"))
    m = Model(spark, str(tmp_path))
    assert rows(m.states(), "id", "theorem_id", "split") == [("s1", "t1", "train"), ("s2", None, "train"), ("s3", None, "train"), ("s4", "t1", "val")]
    assert rows(m.edges_by_theorem("train")) == [("t1", "p"), ("t2", "p")] and rows(m.edges_by_theorem("val")) == [("t1", "q")]
    assert rows(m.theorem_states(), "id", "theorem_id") == [("s1", "t1"), ("s1", "t2"), ("s4", "t1")]
    assert rows(m.premise_votes("train"), "theorem_id", "item_id") == [("t1", "p"), ("t2", "p")]
    assert rows(m.features(), "theorem_id", "num_proof_states") == [("t1", 2), ("t2", 1)]
    assert rows(m.strategies_by_theorem("train")) == [("t1", "simp"), ("t2", "simp")]


def test_given_tables_come_before_derived_ones(spark, tmp_path):
    import pytest

    spark.createDataFrame([state("s1", "t1"), state("s2", "t1")], STATE).write.parquet(str(tmp_path / "proof_states.parquet"))
    spark.createDataFrame([("s1", "x", " rewrite "), ("s1", "x", ""), ("s9", "x", "lost")], "proof_state_id string, technique_id string, label string").write.parquet(str(tmp_path / "proof_state_techniques.parquet"))
    spark.createDataFrame([("t1", 7.5, "hard")], "theorem_id string, theorem_complexity_score double, difficulty_bucket string").write.parquet(str(tmp_path / "theorem_features.parquet"))
    m = Model(spark, str(tmp_path))
    assert rows(m.techniques(), "proof_state_id", "theorem_id", "label") == [("s1", "t1", "rewrite")]
    assert rows(m.features(), "theorem_id", "num_proof_states", "theorem_complexity_score", "difficulty_bucket") == [("t1", 2, 7.5, "hard")]
    assert rows(m.label_votes("train"), "theorem_id", "item_id") == [("t1", "rewrite")]
    with pytest.raises(FileNotFoundError):
        m.raw("theorems")
