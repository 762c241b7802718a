import json

import pytest
from conftest import rows
from lemmary.operators import enrich, export, guidance, profiles, report, theorem
from pyspark.sql import functions as F

STATE = "id string, theorem_id string, full_name string, tactic_idx int, goal_text string, local_hypotheses array<string>, symbols array<string>, domain_tag string, subdomain_tag string"
THEOREM = "id string, full_name string, file_path string, domain_tag string, subdomain_tag string, split string"


def test_profiles(spark):
    s = spark.createDataFrame([("s", "t", "F.a", 0, "⊢ x", ["h : y", " "], ["B", "A"], "D", None), ("n", None, None, None, None, None, None, None, None)], STATE)
    assert rows(s.select("id", profiles.proof_state_profile())) == [("n", ""), ("s", "F.a\nD\nh : y\n⊢ x\nB A")]
    p = spark.createDataFrame([("p", "P.x", "a.lean", "D", "S", "theorem")], "id string, full_name string, file_path string, domain_tag string, subdomain_tag string, code string")
    assert p.select(profiles.premise_profile()).first()[0] == "P.x\na.lean\nD S\ntheorem"


def test_theorem_profiles(spark):
    t = spark.createDataFrame([("t", "T.a", "a.lean", "D", "S", "train"), ("u", None, None, None, None, None)], THEOREM)
    states = [(f"s{i}", "t", "x", None if i == 6 else 6 - i, f"g{i}", [f"h{i}{j}" for j in range(6)], [f"S{i}", "Z"], None, None) for i in range(7)]
    got = {r["theorem_id"]: r for r in profiles.theorem_profiles(t, spark.createDataFrame(states, STATE)).collect()}
    kept = [5, 4, 3, 2, 1]
    hyps = [f"h{i}{j}" for i in kept for j in range(4)][:12]
    assert got["t"]["profile_text"] == "\n".join(["T.a", "a.lean", "D S", *[f"g{i}" for i in kept], "S1 S2 S3 S4 S5 Z", *hyps])
    assert got["t"]["profile_proof_state_count"] == 5 and got["u"]["profile_text"] == "" and got["u"]["profile_proof_state_count"] == 0
    bare = profiles.theorem_profiles(t, spark.createDataFrame(states, STATE), arrays=False).where("theorem_id = 't'").first()["profile_text"]
    assert "S1" not in bare and "h51" not in bare and "g5" in bare
    assert rows(profiles.first_states(spark.createDataFrame(states, STATE), 2), "id") == [("s4",), ("s5",)]


def test_enrichment_text(spark):
    schema = (
        "theorem_id string, topic string, mathematical_objects array<string>, goal_pattern string, key_symbols array<string>, useful_lemma_types array<string>, "
        "strategy_facets array<struct<facet:string,target:string,direction_or_action:string,confidence:double>>, likely_tactics array<string>, difficulty_reasons array<string>, difficulty_bucket_hint string"
    )
    e = spark.createDataFrame([("t", "", ["o"], "gp", None, [], [("f", None, "d", 0.1), ("g", " ", "e", None)], ["simp"], None, "easy")], schema)
    p = spark.createDataFrame([("t", "base"), ("u", "only")], "theorem_id string, profile_text string")
    assert rows(profiles.append_enrichment(p, e)) == [("t", "base\ngp\no\nf d g e\nsimp\neasy", "gp\no\nf d g e\nsimp\neasy"), ("u", "only", "")]


def test_strategy_and_difficulty(spark):
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    n = spark.createDataFrame([("q1", "a", 1, 1.0), ("q1", "b", 2, 0.5), ("q1", "zz", 3, 0.1)], "query_id string, item_id string, rank int, score double")
    labels = spark.createDataFrame([("a", "simp"), ("b", "rw"), ("b", "simp"), ("b", "omega")], "theorem_id string, label string")
    gold = spark.createDataFrame([("q1", "simp"), ("q1", "exact")], "theorem_id string, label string")
    got = {r["query_id"]: r for r in theorem.strategy_rows(q, n, labels, gold).collect()}
    assert tuple(got["q1"])[1:] == (2, 3, 1, 0.5, 0.333333333, 0.4, True) and tuple(got["q2"])[1:] == (0, 0, 0, 0.0, 0.0, 0.0, False)
    assert rows(theorem.strategy_summary(theorem.strategy_rows(q, n, labels, gold))) == [(1, 0.5, 0.333333, 0.4, 1.0)]
    feats = spark.createDataFrame([("a", 2.0, "hard"), ("b", 4.0, "easy"), ("q1", 5.0, "easy")], "theorem_id string, theorem_complexity_score double, difficulty_bucket string")
    got = {r["query_id"]: tuple(r)[1:] for r in theorem.difficulty_rows(q, n, feats, feats).collect()}
    assert got == {"q1": (3.0, 5.0, 2.0, "easy", "easy", True), "q2": (0.0, 0.0, 0.0, "", "", False)}
    assert rows(theorem.difficulty_summary(theorem.difficulty_rows(q, n, feats, feats))) == [(1, 2.0, 1.0)]


def test_guidance(spark):
    n = spark.createDataFrame([("q", "a", 1, 1.0), ("q", "b", 2, 0.5)], "query_id string, item_id string, rank int, score double")
    votes = spark.createDataFrame([("a", "p1", "s1"), ("a", "p2", "s2"), ("b", "p1", "s0"), ("c", "p9", "s")], "theorem_id string, item_id string, seq string")
    p = guidance.positional_votes(n, votes, 10)
    assert rows(p) == [("q", "p1", 1, round(1 + 1 / 3, 9)), ("q", "p2", 2, 0.5)]
    q = spark.createDataFrame([("q", "Q", "D"), ("r", "R", None)], "query_id string, full_name string, domain_tag string")
    names = spark.createDataFrame([("p1", "Premise.one")], "id string, full_name string")
    feats = spark.createDataFrame([("a", 2.0, "hard")], "theorem_id string, theorem_complexity_score double, difficulty_bucket string")
    b = guidance.bundles(q, n, p, p.limit(0), names, feats)
    got = {r["theorem_id"]: r for r in b.collect()}
    assert [(x["premise_id"], x["name"]) for x in got["q"]["premise_suggestions"]] == [("p1", "Premise.one"), ("p2", "p2")]
    assert got["q"]["neighbors"] == ["a", "b"] and got["r"]["difficulty_bucket"] == "" and got["q"]["difficulty_neighbors"] == 1
    assert tuple(guidance.bundle_summary(b).first()) == (2, 1.0, 1.0, 0.0, 0.5)


def test_extract_json():
    assert enrich.extract_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert enrich.extract_json('Sure: {"a": {"b": 2}} done') == {"a": {"b": 2}}
    for bad in ("", "none", "[1, 2]", "{broken"):
        with pytest.raises(ValueError):
            enrich.extract_json(bad)


def test_enrichment_run_and_cache(spark):
    t = spark.createDataFrame([("t1", "N", "f.l", "D", "S", "train"), ("t2", None, None, None, None, "train")], THEOREM)
    states = spark.createDataFrame(
        [("s1", "t1", 0, "g1", ["h1", None, "h2"], ["B", " A "]), ("s2", "t1", 1, " ", None, None), ("s3", "t1", 2, "x" * 600, [], ["A"])],
        "id string, theorem_id string, tactic_idx int, goal_text string, local_hypotheses array<string>, symbols array<string>",
    )
    w = enrich.requests(enrich.prompt_rows(t, states), "m")
    text = w.where("theorem_id = 't1'").first()["prompt"]
    assert "1. g1\n3. " + "x" * 500 + "..." in text and "Name: N" in text and "1. h1 | h2" in text and "Symbols: A, B" in text and "File: f.l" in text
    got = {r["theorem_id"]: r for r in enrich.enrich(w).collect()}
    assert got["t1"]["status"] == "ok" and got["t1"]["topic"].startswith("topic ") and got["t1"]["mathematical_objects"] is None and got["t1"]["strategy_facets"][0]["confidence"] == 0.5
    failed = enrich.enrich(w, lambda t: "nothing")
    assert {(r["status"], r["error"], r["raw_response"]) for r in failed.collect()} == {("error", "no JSON object in the answer", "nothing")}
    assert tuple(enrich.enrichment_summary(failed).first()) == (2, 0, 2, "t1: no JSON object in the answer\nt2: no JSON object in the answer")
    assert tuple(enrich.enrichment_summary(failed.limit(0)).first()) == (0, 0, 0, "")
    cache = w.where("theorem_id = 't1'")
    assert rows(enrich.uncached(w, cache), "theorem_id") == [("t2",)]
    assert rows(enrich.uncached(w, cache.withColumn("prompt_hash", F.lit("old"))), "theorem_id") == [("t1",), ("t2",)]
    earlier = enrich.enrich(w.where("theorem_id = 't1'"), lambda t: '{"topic": "old"}')
    assert rows(enrich.enrichment_run(w, earlier), "theorem_id", "topic")[0] == ("t1", "old")
    assert rows(enrich.enrichment_run(w, earlier, force=True), "theorem_id", "topic")[0][1] != "old"
    assert rows(enrich.enrichment_run(w, failed), "status") == [("ok",), ("ok",)]  # failures aren't answers
    assert rows(enrich.enrichment_run(w, None, limit=1), "theorem_id") == [("t1",)]


def test_odd_answers(spark):
    w = spark.createDataFrame([("t", "N", "train", "p", "h", "m", "v")], "theorem_id string, full_name string, split string, prompt string, prompt_hash string, model string, prompt_version string")
    odd = json.dumps({"topic": {"a": 1}, "key_symbols": "one", "strategy_facets": [1, {"facet": 2, "confidence": "high"}], "likely_tactics": [1, None]})
    r = enrich.enrich(w, lambda t: odd).first()
    assert r["topic"] == '{"a": 1}' and r["key_symbols"] == ["one"] and r["likely_tactics"] == ["1", "None"] and [tuple(x) for x in r["strategy_facets"]] == [("2", None, None, None)]


def test_embed(spark):
    d = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in enrich.embed(d, lambda t: enrich.hashed_words(t, 8)).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and got["b"] == [0.0] * 8 == got["c"]
    sizes = {r["id"]: r["embedding"] for r in enrich.embed(d, lambda t: [[len(t)]] * len(t), 2).collect()}
    assert max(x[0] for x in sizes.values()) <= 2


def test_export(spark, tmp_path):
    t = spark.createDataFrame([("t1", "A", "f", "D", "S", "train"), ("t2", "B", "f", "D", "S", "val"), ("t3", "C", "f", "D", "S", "train")], THEOREM)
    f = spark.createDataFrame([("t1", 1.0)], "theorem_id string, theorem_complexity_score double")
    e = spark.createDataFrame([("t1", "", "m", "v1"), ("t2", None, "m", "v2")], "theorem_id string, topic string, model string, prompt_version string")
    x = export.enriched_theorems(t, f, e)
    assert rows(x, "id", "llm_enrichment_available", "theorem_complexity_score") == [("t1", True, 1.0), ("t2", False, None), ("t3", False, None)]
    assert tuple(export.versions(x).first()) == ("m", "v1,v2")
    edges = spark.createDataFrame([("s1", "p"), ("s2", "p"), (None, "p")], "proof_state_id string, premise_id string")
    own = spark.createDataFrame([("s1", "train"), ("s1", "val"), ("s2", "test")], "proof_state_id string, split string")
    assert rows(export.of_split(edges, {"proof_state_id": own}), "proof_state_id", "split") == [("s1", "train"), ("s1", "val"), ("s2", "test")]
    assert export.of_split(spark.createDataFrame([(1,)], "x int"), {"proof_state_id": own}).count() == 3
    assert rows(export.manifest(x)) == [("train", 2, 1, 0.5, "m", "v1"), ("val", 1, 0, 0.0, "m", "v2")]
    export.write_splits(x, str(tmp_path), "theorems")
    assert spark.read.parquet(str(tmp_path / "hf/theorems/validation")).count() == 1 and spark.read.parquet(str(tmp_path / "train/theorems.parquet")).count() == 2


def test_report(spark):
    t = spark.createDataFrame([("train", "A"), ("train", "A"), ("train", "B"), ("train", "C"), ("val", None)], "split string, domain string")
    c = report.value_counts(t, "split", "domain")
    assert rows(report.value_counts(t, "split", "domain", 2)) == [("train", "A", 2), ("train", "B", 1)]
    assert rows(report.other_counts(c, "split", 1)) == [("train", 2, 2, 4)]
    v = report.value_counts(t, "split", "domain").unionByName(spark.createDataFrame([("test", "Z", 3), ("test", "A", 1)], "split string, value string, n long"))
    assert rows(report.value_table(v, "split", ("train", "val", "test"), 1)) == [(1, "A", 2, 0, 1, 0.25), (2, "Z", 0, 0, 3, 0.75), (3, "Other", 2, 0, 0, 0.0)]
    assert report.percent(0.1234) == "12.3%" and report.percent(None) == ""
    d = spark.createDataFrame([("a|b", 0.5)], "name string, x double")
    assert report.markdown_table(d, ["name", "x"]) == ["| name | x |", "| --- | --- |", "| a\\|b | 0.5000 |"]


def test_json_round_trip_of_bundles(spark):
    d = spark.createDataFrame([("q", [("p", 1.5)])], "id string, s array<struct<id:string,score:double>>")
    assert json.loads(d.select(F.to_json(F.struct("*"))).first()[0]) == {"id": "q", "s": [{"id": "p", "score": 1.5}]}


def test_report_numbers():
    assert report.all_positive(0.5, 0.1, 0.1) == "0.5000" and report.all_positive(None, 0.5, 0.5) == "~0.2500" and report.all_positive(None, 0.5, None) == ""
    assert report.signed(0.5, 0.25) == "+0.2500" and report.signed(0.1, 0.25) == "-0.1500" and report.signed(None, 1.0) == ""
