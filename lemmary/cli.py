"""python -m lemmary.cli TASK --tables DIR --out DIR: the engine's tasks over a folder of tables."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.operators import enrich, export, metrics, profiles, theorem
from lemmary.operators.cut import cut
from lemmary.plans import graph_queries as q
from lemmary.plans.model import Model
from lemmary.plans.pipeline import Pipeline
from lemmary.sources import files

SPLITS = ("train", "val", "test")
ENTITIES = {"premise": "Premise", "proof_state": "ProofState", "theorem_profile": "Theorem"}


def suffix(split: str, llm: bool = False, pretrained: bool = False) -> str:
    return split + "_llm_enriched" * llm + "_pretrained" * pretrained


def records(df: DataFrame) -> list[dict]:
    """The rows of a small aggregate."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


def evaluate_t1(p: Pipeline, a: argparse.Namespace) -> None:
    """Rankings of all methods that take part as Parquet (long and wide) and their metrics as JSON."""
    name = f"{a.out}/t1_{suffix(p.split, a.llm, a.pretrained)}"
    p.all_rankings.write.mode("overwrite").parquet(f"{name}_rankings.parquet")
    q.candidate_rankings(p).write.mode("overwrite").parquet(f"{name}_candidates.parquet")
    files.write_json(records(metrics.summarize(p.rows()).orderBy("method")), f"{name}_metrics.json")


def evaluate_t2(p: Pipeline, a: argparse.Namespace) -> None:
    """Theorem neighbours as Parquet and their grading as JSON."""
    near = p.theorem_neighbors_pretrained if a.pretrained else p.theorem_neighbors_llm if a.llm else p.theorem_neighbors
    name = f"{a.out}/t2_{suffix(p.split, a.llm, a.pretrained)}"
    near.write.mode("overwrite").parquet(f"{name}_neighbors.parquet")
    files.write_json(records(metrics.summarize(p.theorem_rows(near))), f"{name}_metrics.json")
    graded = {"strategies": theorem.strategy_summary(q._labels(p, near)), "difficulty": theorem.difficulty_summary(q._difficulty(p, near))}
    files.write_json({k: records(d)[0] for k, d in graded.items()}, f"{name}_grading.json")


def aggregate_guidance(p: Pipeline, a: argparse.Namespace) -> None:
    """Guidance bundles as JSON lines; with --llm from the neighbours of the enriched profiles."""
    files.write_json_lines(q.bundles(p, a.guidance_limit, a.llm), f"{a.out}/t3_{suffix(p.split, a.llm)}_bundles")


def build_report(p: Pipeline, a: argparse.Namespace) -> None:
    os.makedirs(a.out, exist_ok=True)
    with open(f"{a.out}/report_{suffix(p.split, a.llm, a.pretrained)}.md", "w", encoding="utf-8") as f:
        f.write("\n".join(q.report_lines(p, a.guidance_limit)) + "\n")


def id_pipeline(p: Pipeline, a: argparse.Namespace) -> None:
    for task in (evaluate_t1, evaluate_t2, aggregate_guidance, build_report):
        task(p, a)


def client(a: argparse.Namespace) -> Callable[[str], str]:
    """The offline client, or one that posts to --url: the key is read from the variable that --key-variable names, after --env-file."""
    if not a.url:
        return enrich.stub_client
    if a.env_file:
        files.load_env(a.env_file)
    key = os.environ.get(a.key_variable, "")
    headers = {"Authorization": f"Bearer {key}"} if key else {}
    body = lambda text: {"model": a.model, "messages": [{"role": "user", "content": text}]}
    return files.http_client(a.url, headers, body, lambda r: r["choices"][0]["message"]["content"])


def enrich_split(p: Pipeline, a: argparse.Namespace, split: str) -> dict:
    """Answers for the theorems of a split as Parquet and JSON lines with a summary; earlier answers to the same prompts are kept."""
    name = f"{a.out}/llm/theorem_enrichment_{split}" + (f"_{a.limit}" if a.limit is not None else "")
    spark, path = p.m.spark, f"{name}.parquet"
    cache = cut(spark.read.parquet(path)) if files.exists(spark, path) else None  # the same folder is written again
    shown = enrich.prompt_rows(p.m.theorems().where(F.col("split") == split), p.theorem_states, a.max_states)
    answers = cut(enrich.enrichment_run(enrich.requests(shown, a.model), cache, client(a), a.limit, a.force, concurrency=a.concurrency))
    answers.write.mode("overwrite").parquet(path)
    files.write_json_lines(answers.orderBy("theorem_id"), f"{name}_lines")
    summary = {"split": split, "parquet": path, **records(enrich.enrichment_summary(answers))[0]}
    files.write_json(summary, f"{name}_summary.json")
    return summary


def llm_enrich_theorems(p: Pipeline, a: argparse.Namespace) -> None:
    print(json.dumps(enrich_split(p, a, p.split)))


def llm_pipeline(p: Pipeline, a: argparse.Namespace) -> None:
    """Enrichment of all splits."""
    print(json.dumps([enrich_split(p, a, s) for s in SPLITS]))


def export_enriched_dataset(p: Pipeline, a: argparse.Namespace) -> None:
    """All tables per split in both layouts under a version, with manifest and card; an error if a split has no enrichment."""
    out = f"{a.out}/{a.dataset_version}"
    tables = q.export_tables(p)
    per = {r["split"]: r for r in records(export.manifest(tables["theorems"].where(F.col("split").isin(*SPLITS))))}
    bare = [s for s in SPLITS if s in per and not per[s]["llm_enriched_theorems"]]
    if bare or not per:
        raise FileNotFoundError(f"no enrichment for split: {', '.join(bare) or 'all'}")
    for name, d in tables.items():
        export.write_splits(d, out, name)
    counts = records(export.split_counts(tables))
    splits = {
        s: {"tables": {c["table_name"]: c["n"] for c in counts if c["split"] == s}, **{k: (v.split(",") if k.startswith("llm_") and isinstance(v, str) else v) for k, v in r.items() if k != "split"}}
        for s, r in sorted(per.items())
    }
    v = records(export.versions(tables["theorems"].where("split IS NOT NULL")))[0]
    files.write_json({"version": a.dataset_version, "max_profile_states": a.max_states, "splits": splits, "configs": list(tables), **{k: x.split(",") for k, x in v.items()}}, f"{out}/manifest.json")
    for name in ("dataset_card.md", "README.md"):
        with open(f"{out}/{name}", "w", encoding="utf-8") as f:
            f.write(export.card(a.dataset_version, splits))


def build_pretrained_embeddings(p: Pipeline, a: argparse.Namespace) -> None:
    """(entity_type, id, split, embedding) of texts by an encoder (here hashed words) as one table, as --embeddings reads it."""
    texts = {
        "Premise": lambda: p.premises.select("id", "split", profiles.premise_profile().alias("text")),
        "ProofState": lambda: p.states.select("id", "split", profiles.proof_state_profile().alias("text")),
        "Theorem": lambda: p.profiles.select(F.col("theorem_id").alias("id"), "split", F.col("profile_text").alias("text")),
    }
    for i, kind in enumerate(ENTITIES[x.strip()] for x in a.entity_types.split(",") if x.strip()):
        docs = texts[kind]().where(F.col("split").isin([s.strip() for s in a.splits.split(",")])).select(F.lit(kind).alias("entity_type"), "id", "split", "text")
        enrich.embed(docs, batch_size=a.batch_size).write.mode("append" if i else "overwrite").parquet(f"{a.out}/embeddings.parquet")


TASKS: dict[str, Callable[[Pipeline, argparse.Namespace], None]] = {
    f.__name__.replace("_", "-"): f
    for f in (evaluate_t1, evaluate_t2, aggregate_guidance, build_report, id_pipeline, llm_enrich_theorems, llm_pipeline, export_enriched_dataset, build_pretrained_embeddings)
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("task", choices=TASKS)
    a.add_argument("--tables", required=True, help="folder of the tables")
    a.add_argument("--out", required=True)
    a.add_argument("--split", default="test", choices=SPLITS)
    a.add_argument("--neighbor-k", type=int, default=20)
    a.add_argument("--guidance-limit", type=int, default=25)
    a.add_argument("--max-states", type=int, default=5)
    a.add_argument("--llm", action="store_true", help="sources and fusions that use enrichment")
    a.add_argument("--pretrained", action="store_true", help="sources and fusions that use an encoder")
    a.add_argument("--embeddings", help="table written by build-pretrained-embeddings")
    a.add_argument("--enrichment", help="table written by llm-enrich-theorems, instead of theorem_enrichment")
    a.add_argument("--model", default="offline")
    a.add_argument("--limit", type=int, help="only the first theorems, as a pilot")
    a.add_argument("--concurrency", type=int, default=8)
    a.add_argument("--force", action="store_true", help="ask again for what is cached")
    a.add_argument("--url", help="a chat endpoint; without it the offline client answers")
    a.add_argument("--key-variable", default="TEXT_MODEL_KEY")
    a.add_argument("--env-file")
    a.add_argument("--dataset-version", default="v1")
    a.add_argument("--splits", default=",".join(SPLITS))
    a.add_argument("--entity-types", default=",".join(ENTITIES))
    a.add_argument("--batch-size", type=int, default=256)
    args = a.parse_args(argv)
    if not os.path.isdir(args.tables) and "://" not in args.tables:
        raise FileNotFoundError(f"no table folder: {args.tables}")
    if any(x is not None and x < 1 for x in (args.neighbor_k, args.guidance_limit, args.max_states, args.limit, args.concurrency, args.batch_size)):
        a.error("numbers must be positive")
    unknown = {x.strip() for x in args.entity_types.split(",") if x.strip()} - set(ENTITIES) | {x.strip() for x in args.splits.split(",") if x.strip()} - set(SPLITS)
    if unknown:
        a.error(f"unknown: {', '.join(sorted(unknown))}")
    spark = spark or SparkSession.builder.appName("lemmary").getOrCreate()
    answers = spark.read.parquet(args.enrichment) if args.enrichment else None
    embeddings = files.required_table(spark, args.embeddings) if args.embeddings else None
    p = Pipeline(Model(spark, args.tables, answers), args.split, neighbor_k=args.neighbor_k, embeddings=embeddings, llm=args.llm, pretrained=args.pretrained, max_states=args.max_states)
    TASKS[args.task](p, args)


if __name__ == "__main__":
    main()
