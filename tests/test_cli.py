import json
import os

import pytest
from lemmary import cli
from lemmary.plans.model import Model
from lemmary.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def run(spark, task, out, *more):
    cli.main([task, "--tables", SF, "--out", str(out), *more], spark)


def test_theorem_task(spark, tmp_path):
    run(spark, "evaluate-t2", tmp_path, "--split", "val", "--neighbor-k", "5")
    assert json.load(open(tmp_path / "t2_val_metrics.json"))[0]["evaluated_queries"] >= 0
    assert set(json.load(open(tmp_path / "t2_val_grading.json"))) == {"strategies", "difficulty"}
    assert spark.read.parquet(str(tmp_path / "t2_val_neighbors.parquet")).where("rank > 5").count() == 0


def test_export(spark, tmp_path):
    run(spark, "export-enriched-dataset", tmp_path, "--dataset-version", "v7")
    m = json.load(open(tmp_path / "v7/manifest.json"))
    assert set(m["configs"]) == {"theorems", "theorem_profiles", "positive_edges", "premises", "proof_states"} and m["llm_models"] and m["version"] == "v7"
    for split, x in m["splits"].items():
        for name, n in x["tables"].items():
            assert spark.read.parquet(str(tmp_path / f"v7/{split}/{name}.parquet")).count() == n
    assert os.path.isdir(tmp_path / "v7/hf/theorems/validation") and "| train |" in (tmp_path / "v7/README.md").read_text()
    empty = spark.read.parquet(f"{SF}/theorem_enrichment.parquet").limit(0).selectExpr("*", "'ok' AS status")
    empty.write.parquet(str(tmp_path / "none.parquet"))
    with pytest.raises(FileNotFoundError):
        run(spark, "export-enriched-dataset", tmp_path / "x", "--enrichment", str(tmp_path / "none.parquet"))


def test_enrichment_is_cached_and_read(spark, tmp_path):
    run(spark, "llm-enrich-theorems", tmp_path, "--split", "val")
    path = str(tmp_path / "llm/theorem_enrichment_val.parquet")
    first = {r["theorem_id"]: r["created_at"] for r in spark.read.parquet(path).collect()}
    run(spark, "llm-enrich-theorems", tmp_path, "--split", "val")
    assert first and {r["theorem_id"]: r["created_at"] for r in spark.read.parquet(path).collect()} == first
    run(spark, "llm-enrich-theorems", tmp_path, "--split", "val", "--force")
    assert all(first[r["theorem_id"]] < r["created_at"] for r in spark.read.parquet(path).collect())
    s = json.load(open(tmp_path / "llm/theorem_enrichment_val_summary.json"))
    assert s["requested"] == s["succeeded"] == len(first) and s["failed"] == 0 and s["errors"] == ""
    run(spark, "llm-enrich-theorems", tmp_path, "--split", "val", "--limit", "1")
    assert spark.read.parquet(str(tmp_path / "llm/theorem_enrichment_val_1.parquet")).count() == 1
    assert Model(spark, SF, spark.read.parquet(path)).enrichment().count() == len(first)


def test_guidance_with_enrichment_uses_enriched_neighbours(spark, tmp_path):
    for more in ((), ("--llm",)):
        run(spark, "aggregate-guidance", tmp_path, "--guidance-limit", "3", *more)
    a, b = (spark.read.json(str(tmp_path / f"t3_{x}_bundles")) for x in ("test", "test_llm_enriched"))
    q = "theorem_id"
    assert a.count() == b.count() <= 3 and {r[q] for r in a.select(q).collect()} == {r[q] for r in b.select(q).collect()}


def test_embeddings_are_read_again(spark, tmp_path):
    run(spark, "build-pretrained-embeddings", tmp_path, "--entity-types", "premise,proof_state,theorem_profile")
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r[0] for r in e.select("entity_type").distinct().collect()} == {"Premise", "ProofState", "Theorem"}
    p = Pipeline(Model(spark, SF), embeddings=e)
    ids = {r["id"] for r in e.where("entity_type = 'Premise' AND split = 'train'").collect()}
    assert {r["item_id"] for r in p.pretrained_dense.collect()} <= ids and p.theorem_neighbors_pretrained.count() >= 0 and p.pretrained_similar_ps.count() >= 0


def test_report_holds_what_takes_part(spark, tmp_path):
    run(spark, "build-report", tmp_path)
    text = (tmp_path / "report_test.md").read_text()
    for part in ("## Data", "### Domains", "### Labels", "## Proof state to premise", "### Against dense", "## Theorem to theorem", "## Guidance", "### Evidence", "### Examples", "## Glossary", "weighted_rrf_theorem_tuned"):
        assert part in text
    assert "_llm" not in text and "pretrained" not in text


def test_arguments(tmp_path):
    assert cli.suffix("test", True, True) == "test_llm_enriched_pretrained" and len(cli.TASKS) == 9
    with pytest.raises(FileNotFoundError):
        cli.main(["evaluate-t1", "--tables", str(tmp_path / "none"), "--out", str(tmp_path)])
    with pytest.raises(SystemExit):
        cli.main(["evaluate-t1", "--tables", SF, "--out", str(tmp_path), "--split", "dev"])
    for bad in (("--limit", "0"), ("--entity-types", "lemma"), ("--splits", "dev")):
        with pytest.raises(SystemExit):
            cli.main(["evaluate-t1", "--tables", SF, "--out", str(tmp_path), *bad])
