"""Registered queries of the retrieval engine; each runs over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.operators import enrich, export, fusion, guidance, metrics, profiles, report, retrieval, tfidf, theorem
from lemmary.operators.cut import cut
from lemmary.plans.graph_sql import ORACLE  # noqa: F401
from lemmary.plans.model import Model
from lemmary.plans.pipeline import Pipeline
from lemmary.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LAST: dict[tuple[str, str], Pipeline] = {}


def pipeline(spark: SparkSession, folder: str) -> Pipeline:
    """The pipeline of a folder; the last one is kept, so that queries share its checkpointed parts."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Pipeline(Model(spark, folder))
    return _LAST[key]


def forget() -> None:
    """Drop the kept pipeline: the next query computes all its parts anew."""
    _LAST.clear()


def query(f: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(pipeline(spark, folder))
    return f


_RANKED = ["query_id", "item_id", "rank", "score"]


# scans, projections, filters


@query
def scan_parquet(p: Pipeline) -> DataFrame:
    return p.m.raw("theorems")


@query
def premise_pool(p: Pipeline) -> DataFrame:
    return p.m.pool()


@query
def embedding_ids(p: Pipeline) -> DataFrame:
    return p.m.vectors("ProofState").select("id", "row_index")


@query
def eligible_queries(p: Pipeline) -> DataFrame:
    return p.queries.select("id", "theorem_id")


@query
def active_presets(p: Pipeline) -> DataFrame:
    rows = [(bool(llm), bool(pre), n) for llm in (0, 1) for pre in (0, 1) for n in fusion.active_presets(bool(llm), bool(pre))]
    return p.m.spark.createDataFrame(rows, "llm boolean, pretrained boolean, preset string")


@query
def prefix_columns(p: Pipeline) -> DataFrame:
    return export.prefixed(p.m.enrichment().select("theorem_id", "topic", "goal_pattern", "model", "likely_tactics"))


@query
def llm_cache_antijoin(p: Pipeline) -> DataFrame:
    """Train theorems that no enrichment row covers."""
    wanted = p.m.theorems().select(F.col("id").alias("theorem_id"))
    return wanted.join(p.m.enrichment().select("theorem_id"), "theorem_id", "left_anti")


# joins and sets


@query
def edges_by_theorem(p: Pipeline) -> DataFrame:
    return p.m.edges_by_theorem("train")


@query
def strategies_by_theorem(p: Pipeline) -> DataFrame:
    return p.m.strategies_by_theorem("train")


@query
def gold_by_query(p: Pipeline) -> DataFrame:
    return p.gold.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("gold"))


@query
def gold_in_pool(p: Pipeline) -> DataFrame:
    return p.gold.join(p.m.pool().withColumnRenamed("id", "item_id"), "item_id", "left_semi").select("query_id", "item_id")


@query
def gold_missing(p: Pipeline) -> DataFrame:
    return p.gold.join(p.m.pool().withColumnRenamed("id", "item_id"), "item_id", "left_anti").select("query_id", "item_id")


def _enriched(p: Pipeline) -> DataFrame:
    cols = ["theorem_id", "topic", "goal_pattern", "difficulty_bucket_hint", "prompt_version", "model"]
    return export.enriched_theorems(p.m.theorems(), p.m.features(), p.m.enrichment().select(*cols))


@query
def enriched_theorems(p: Pipeline) -> DataFrame:
    return _enriched(p)


@query
def enrichment_available(p: Pipeline) -> DataFrame:
    return _enriched(p).select("id", "llm_enrichment_available")


@query
def enriched_profiles(p: Pipeline) -> DataFrame:
    extra = export.prefixed(p.m.enrichment().select("theorem_id", "topic", "model"))
    return p.llm_profiles.join(extra, "theorem_id", "left").select("theorem_id", "full_name", "profile_text", "llm_enrichment_text", "llm_topic", "llm_model")


@query
def export_manifest(p: Pipeline) -> DataFrame:
    return export.manifest(_enriched(p).where("split IS NOT NULL"))


# profiles


@query
def first_states(p: Pipeline) -> DataFrame:
    return profiles.first_states(p.theorem_states).select("theorem_id", "id", "tactic_idx", "n")


@query
def proof_state_profile(p: Pipeline) -> DataFrame:
    return p.states.select("id", profiles.proof_state_profile().alias("profile"))


@query
def premise_profile(p: Pipeline) -> DataFrame:
    return p.premises.select("id", profiles.premise_profile().alias("profile"))


@query
def theorem_profiles(p: Pipeline) -> DataFrame:
    return p.profiles.drop("split")


@query
def theorem_profiles_without_arrays(p: Pipeline) -> DataFrame:
    return profiles.theorem_profiles(p.m.theorems(), p.theorem_states, arrays=False).select("theorem_id", "profile_text")


@query
def enrichment_text(p: Pipeline) -> DataFrame:
    return p.m.enrichment().select("theorem_id", profiles.enrichment_text().alias("llm_enrichment_text"))


# weights


def _train_docs(p: Pipeline) -> DataFrame:
    return p.premises.where("split = 'train'").select("id", profiles.premise_profile().alias("text"))


@query
def tfidf_idf(p: Pipeline) -> DataFrame:
    return tfidf.fit(_train_docs(p)).select("term", "df", F.round("idf", 9).alias("idf"))


@query
def tfidf_weights(p: Pipeline) -> DataFrame:
    docs = _train_docs(p)
    return tfidf.weights(docs, tfidf.fit(docs)).select("id", "term", F.round("w", 9).alias("w"))


@query
def vocab_cap(p: Pipeline) -> DataFrame:
    return tfidf.vocabulary(tfidf.term_counts(_train_docs(p)), 500)


# sources


@query
def dense_topk(p: Pipeline) -> DataFrame:
    return p.dense.select("query_id", "item_id", "rank")


@query
def dense_topk_scores(p: Pipeline) -> DataFrame:
    return p.similar_states.select(*_RANKED)


@query
def dense_self_topk(p: Pipeline) -> DataFrame:
    """Ten nearest other vectors of every row of ``embeddings``."""
    v = p.m.raw("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return retrieval.top_k(retrieval.dense_top_k(v, v, 11).where("query_id != item_id").select("query_id", "item_id", "score"), 10)


@query
def pretrained_dense(p: Pipeline) -> DataFrame:
    return p.pretrained_dense.select(*_RANKED)


@query
def pretrained_similar_ps(p: Pipeline) -> DataFrame:
    return p.pretrained_similar_ps.select(*_RANKED)


@query
def lexical_topk(p: Pipeline) -> DataFrame:
    return p.lexical.select(*_RANKED)


@query
def symbol_overlap(p: Pipeline) -> DataFrame:
    return p.symbol.select(*_RANKED)


for _k in (25, 50, 100):
    for _mode in fusion.MODES:
        if _k == 100 or _mode == "rank":
            _name = f"expand_{_mode}" + ("" if _mode != "rank" else f"_k{_k}")
            QUERIES[_name] = lambda spark, folder, k=_k, mode=_mode: pipeline(spark, folder).expanded(k, mode)
QUERIES["expand_rank"] = QUERIES["expand_rank_k25"]


@query
def theorem_neighbors(p: Pipeline) -> DataFrame:
    return p.theorem_neighbors


@query
def theorem_neighbors_llm(p: Pipeline) -> DataFrame:
    return p.theorem_neighbors_llm


@query
def theorem_neighbors_pretrained(p: Pipeline) -> DataFrame:
    return p.theorem_neighbors_pretrained


@query
def neighbor_premises(p: Pipeline) -> DataFrame:
    return p.neighbor_premises(p.theorem_neighbors)


@query
def theorem_premises(p: Pipeline) -> DataFrame:
    return p.theorem_premises(p.theorem_neighbors)


@query
def theorem_premises_llm(p: Pipeline) -> DataFrame:
    return p.theorem_premises(p.theorem_neighbors_llm)


# fusion


@query
def dense_lexical_rrf(p: Pipeline) -> DataFrame:
    return p.union(["dense", "lexical"])


@query
def full_union_rrf(p: Pipeline) -> DataFrame:
    return p.union(["dense", "lexical", "symbol", "similar_ps"])


@query
def rrf_union(p: Pipeline) -> DataFrame:
    return p.union(["lexical", "symbol", "similar_theorem"])


for _name in fusion.PRESETS:
    QUERIES[f"weighted_rrf_{_name}"] = lambda spark, folder, n=_name: pipeline(spark, folder).fused([n]).drop("preset")


# evaluation


@query
def ranking_rows(p: Pipeline) -> DataFrame:
    return p.rows("lexical")


@query
def average_precision(p: Pipeline) -> DataFrame:
    return p.rows("weighted_rrf_theorem_tuned").select("query_id", "average_precision")


@query
def ndcg(p: Pipeline) -> DataFrame:
    return p.rows("weighted_rrf_theorem_tuned").select("query_id", "ndcg_at_10", "ndcg_at_50", "ndcg_at_100")


@query
def first_gold_rank(p: Pipeline) -> DataFrame:
    return p.rows("weighted_rrf_theorem_tuned").select("query_id", "rank_of_first_gold")


@query
def summarize_rankings(p: Pipeline) -> DataFrame:
    return metrics.summarize(p.rows("lexical"))


@query
def t1_metrics(p: Pipeline) -> DataFrame:
    return metrics.summarize(p.rows())


_DELTAS = ["map", "recall_at_100", "all_positive_recall_at_100", "ndcg_at_10"]


@query
def metric_delta(p: Pipeline) -> DataFrame:
    return metrics.metric_delta(metrics.summarize(p.rows()), "dense", _DELTAS)


@query
def candidate_rankings(p: Pipeline) -> DataFrame:
    """One row per eligible state: its ranking by every source and fusion as one list, and its gold premises."""
    of = p.queries.select(F.col("id").alias("query_id"), "theorem_id", "full_name", "split")
    return of.join(p.all_lists.select("query_id", *sorted(p.methods)), "query_id", "left").join(gold_by_query(p), "query_id", "left").fillna("", p.methods)


@query
def marginal_hits(p: Pipeline) -> DataFrame:
    """(source, hits, only_here): gold premises a source finds in its first 100, and those that no other source finds."""
    found = p.all_sources.join(p.gold, ["query_id", "item_id"], "left_semi").groupBy("query_id", "item_id").agg(F.collect_set("source").alias("s"))
    each = found.select(F.explode("s").alias("source"), (F.size("s") == 1).cast("long").alias("lone"))
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.sum("lone").alias("only_here"))


@query
def split_audit(p: Pipeline) -> DataFrame:
    """(split, n_files, files_in_train, n_theorems, theorems_in_train, gold_edges, gold_in_train_pool) of val and test."""
    t = p.m.theorems().where("split IS NOT NULL")
    own = t.where("split != 'train'")
    train_files = t.where("split = 'train' AND file_path IS NOT NULL").select("file_path").distinct()
    seen = own.where("file_path IS NOT NULL").select("split", "file_path").distinct().join(train_files.withColumn("hit", F.lit(1)), "file_path", "left")
    files = seen.groupBy("split").agg(F.count(F.lit(1)).alias("n_files"), F.count("hit").alias("files_in_train"))
    ids = own.select("split", "id").join(t.where("split = 'train'").select("id", F.lit(1).alias("hit")), "id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("n_theorems"), F.count("hit").alias("theorems_in_train"))
    edges = p.m.edges().join(p.states.where("split != 'train'").select(F.col("id").alias("proof_state_id"), "split"), "proof_state_id")
    gold = edges.join(p.m.pool().select(F.col("id").alias("premise_id"), F.lit(1).alias("hit")), "premise_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("gold_edges"), F.count("hit").alias("gold_in_train_pool"))
    return files.join(ids, "split").join(gold, "split")


# theorem to theorem


@query
def theorem_rows(p: Pipeline) -> DataFrame:
    """The graded neighbours of every query theorem: ranking, strategy and difficulty columns side by side."""
    near = p.theorem_neighbors.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]), ",").alias("neighbors"))
    rows = p.theorem_rows(p.theorem_neighbors)
    return rows.join(_labels(p, p.theorem_neighbors), "query_id").join(_difficulty(p, p.theorem_neighbors), "query_id").join(near, "query_id", "left").fillna("", ["neighbors"])


def _labels(p: Pipeline, neighbors: DataFrame) -> DataFrame:
    return theorem.strategy_rows(p.theorem_queries, neighbors, p.m.strategies_by_theorem("train"), p.m.strategies_by_theorem(p.split))


def _difficulty(p: Pipeline, neighbors: DataFrame) -> DataFrame:
    return theorem.difficulty_rows(p.theorem_queries, neighbors, p.m.features(), p.m.features())


@query
def strategy_rows(p: Pipeline) -> DataFrame:
    return _labels(p, p.theorem_neighbors)


@query
def difficulty_rows(p: Pipeline) -> DataFrame:
    return _difficulty(p, p.theorem_neighbors)


@query
def t2_strategy_summary(p: Pipeline) -> DataFrame:
    return theorem.strategy_summary(_labels(p, p.theorem_neighbors))


@query
def t2_difficulty_summary(p: Pipeline) -> DataFrame:
    return theorem.difficulty_summary(_difficulty(p, p.theorem_neighbors))


@query
def t2_summary(p: Pipeline) -> DataFrame:
    return metrics.summarize(p.theorem_rows(p.theorem_neighbors))


@query
def t2_summary_llm(p: Pipeline) -> DataFrame:
    return metrics.summarize(p.theorem_rows(p.theorem_neighbors_llm))


# guidance


def _guidance(p: Pipeline, limit: int = 25, llm: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The first query theorems in file order, their neighbours (``llm``: of the enriched profiles), premise and strategy suggestions."""
    theorems = p.profiles.where(F.col("split") == p.split).join(p.m.theorem_order().withColumnRenamed("id", "theorem_id"), "theorem_id")
    q = cut(guidance.first_queries(theorems, limit))
    near = cut((p.theorem_neighbors_llm if llm else p.theorem_neighbors).join(q.select("query_id"), "query_id", "left_semi"))
    return q, near, guidance.positional_votes(near, p.m.premise_votes("train"), 10), guidance.positional_votes(near, p.m.label_votes("train"), 8)


@query
def guidance_limit(p: Pipeline) -> DataFrame:
    return _guidance(p)[0]


@query
def guidance_premises(p: Pipeline) -> DataFrame:
    return _guidance(p)[2]


@query
def guidance_strategies(p: Pipeline) -> DataFrame:
    return _guidance(p)[3]


def train_names(p: Pipeline) -> DataFrame:
    return p.premises.where("split = 'train'").select("id", "full_name")


def bundles(p: Pipeline, limit: int = 25, llm: bool = False) -> DataFrame:
    return guidance.bundles(*_guidance(p, limit, llm), train_names(p), p.m.features())


@query
def guidance_bundles(p: Pipeline) -> DataFrame:
    return guidance.flat_bundles(bundles(p))


@query
def guidance_bundles_llm(p: Pipeline) -> DataFrame:
    return guidance.flat_bundles(bundles(p, llm=True))


@query
def guidance_summary(p: Pipeline) -> DataFrame:
    return guidance.bundle_summary(bundles(p))


@query
def guidance_histograms(p: Pipeline) -> DataFrame:
    return guidance.histograms(bundles(p))


@query
def guidance_evidence(p: Pipeline) -> DataFrame:
    _, _, premises, strategies = _guidance(p)
    return guidance.evidence(premises, strategies, train_names(p))


# statistics, report, enrichment


@query
def split_stats(p: Pipeline) -> DataFrame:
    return report.split_stats(p.m.theorems(), p.states, p.premises, p.m.edges())


@query
def domain_counts(p: Pipeline) -> DataFrame:
    return report.value_counts(p.m.theorems(), "split", "domain_tag", 8)


@query
def domain_other(p: Pipeline) -> DataFrame:
    return report.other_counts(report.value_counts(p.m.theorems(), "split", "domain_tag"), "split", 3)


@query
def domain_table(p: Pipeline) -> DataFrame:
    """Domains of theorems, the first 8 of train, val and the query split in turn, with their counts in each."""
    return report.value_table(report.value_counts(p.m.theorems(), "split", "domain_tag"), "split", tuple(dict.fromkeys(["train", "val", p.split])))


@query
def label_counts(p: Pipeline) -> DataFrame:
    """The first 8 strategy labels of each split by the number of states with them."""
    return report.value_counts(p.m.techniques().select("proof_state_id", "label", "split").distinct(), "split", "label", 8)


@query
def bucket_counts(p: Pipeline) -> DataFrame:
    """Theorems by difficulty bucket and split."""
    return report.value_counts(p.m.theorems().join(p.m.features().withColumnRenamed("theorem_id", "id"), "id"), "split", "difficulty_bucket")


@query
def export_versions(p: Pipeline) -> DataFrame:
    return export.versions(_enriched(p).where("split IS NOT NULL"))


def export_tables(p: Pipeline) -> dict[str, DataFrame]:
    """The tables of an export with a split each; those the folder lacks are left out."""
    states = p.m.links().select("proof_state_id", "split").where("split IS NOT NULL")
    theorems = p.m.theorems().where("split IS NOT NULL")
    keys = {
        "proof_state_id": states, "theorem_id": theorems.select(F.col("id").alias("theorem_id"), "split"), "premise_id": p.m.premises().where("split IS NOT NULL").select(F.col("id").alias("premise_id"), "split"),
        "file_path": theorems.where("file_path IS NOT NULL").select("file_path", "split"),
    }
    present = [t for t in export.MORE_TABLES if p.m.has(t)]
    extra = export.prefixed(p.m.enrichment().drop("split"))
    profiles_ = p.llm_profiles.join(p.profiles.select("theorem_id", F.col("profile_text").alias("base_profile_text")), "theorem_id").join(extra, "theorem_id", "left")
    enriched = export.enriched_theorems(p.m.theorems(), p.m.features(), p.m.enrichment())
    return {"theorems": enriched, "theorem_profiles": profiles_} | {t: export.of_split(table(p.m.spark, p.m.folder, t), keys) for t in [*export.TABLES, *present]}


@query
def export_counts(p: Pipeline) -> DataFrame:
    return export.split_counts(export_tables(p))


_T1_STAGES = [
    ("Baselines", ["dense", "lexical", "symbol", "dense_lexical_rrf"]),
    ("Similar states", ["similar_ps", "similar_ps_k50", "similar_ps_k100", "similar_ps_k100_sim", "similar_ps_k100_rank_sim"]),
    ("Similar theorems", ["similar_theorem", "similar_theorem_llm"]),
    ("Encoder", ["pretrained_dense", "pretrained_similar_ps"]),
    ("Fusions", ["full_union_rrf", *[f"weighted_rrf_{n}" for n in fusion.PRESETS]]),
]
_GLOSSARY = [
    ("recall_at_k (covered)", "part of the gold premises in the pool that the first k results hold, mean over queries"),
    ("all-positive recall", "hits over all gold premises, those outside the pool included; '~' marks recall times coverage"),
    ("map", "mean over queries of the precision at every hit, summed over the gold premises in the pool"),
    ("ndcg_at_k", "gain discounted by the logarithm of the rank, over the best possible"),
    ("gold_pool_coverage", "part of all gold premises that are in the pool"),
    ("reciprocal-rank fusion", "each source adds weight / rank to what it returns"),
    ("strategy recall, precision, F1", "labels of the neighbours' states against those of the theorem"),
    ("difficulty MAE, bucket accuracy", "mean score and most frequent bucket of the neighbours against the theorem's"),
]


def report_lines(p: Pipeline, limit: int = 25) -> list[str]:
    """The lines of the report: data, metrics of all methods, theorem neighbours, guidance, glossary. Only small aggregates are collected."""
    splits = tuple(dict.fromkeys(["train", "val", p.split]))
    text = ["# Report", "", "## Data", "", *report.markdown_table(split_stats(p).orderBy("split"), ["split", "theorems", "proof_states", "premises", "positive_edges", "states_per_theorem", "edges_per_state"])]
    text += ["", "### Domains", "", *report.markdown_table(domain_table(p).orderBy("place"), ["value", *[f"n_{s}" for s in splits], "share"])]
    spread = lambda d: {s: ", ".join(f"{r['value']}: {r['n']}" for r in d.where(F.col("split") == s).orderBy(F.desc("n"), "value").collect()) for s in splits}
    labels = [["difficulty bucket", *spread(bucket_counts(p)).values()], ["strategy label", *spread(label_counts(p)).values()]]
    text += ["", "### Labels", "", *report.markdown_rows(["label type", *splits], labels)]
    m = {r["method"]: r.asDict() for r in metrics.summarize(p.rows()).collect()}
    columns = ["recall_at_10", "recall_at_50", "recall_at_100"]
    stage = lambda name, x: [name, x["method"], *[x[c] for c in columns], report.all_positive(x.get("all_positive_recall_at_100"), x["recall_at_100"], x["gold_pool_coverage"]), x["map"], x["ndcg_at_10"], x["gold_pool_coverage"]]
    text += ["", "## Proof state to premise", "", *report.markdown_rows(["stage", "method", *columns, "all-positive recall_at_100", "map", "ndcg_at_10", "gold_pool_coverage"], [stage(n, m[x]) for n, xs in _T1_STAGES for x in xs if x in m])]
    deltas = [[x, *[report.signed(r[c], m["dense"][c]) for c in ("recall_at_100", "all_positive_recall_at_100", "map", "ndcg_at_10")]] for x, r in sorted(m.items()) if x != "dense"] if "dense" in m else []
    text += ["", "### Against dense", "", *report.markdown_rows(["method", "recall_at_100", "all-positive recall_at_100", "map", "ndcg_at_10"], deltas)]
    kinds = [("profiles", p.theorem_neighbors)] + [("enriched profiles", p.theorem_neighbors_llm)] * p.llm + [("encoder", p.theorem_neighbors_pretrained)] * p.pretrained
    rows = []
    for name, near in kinds:
        s, l, d = metrics.summarize(p.theorem_rows(near)).first(), theorem.strategy_summary(_labels(p, near)).first(), theorem.difficulty_summary(_difficulty(p, near)).first()
        rows.append([name, *[s[c] for c in columns], s["map"], s["ndcg_at_10"], l["recall"], l["precision"], l["f1"], d["mae"], d["bucket_accuracy"]])
    text += ["", "## Theorem to theorem", "", *report.markdown_rows(["neighbours by", *columns, "map", "ndcg_at_10", "strategy recall", "precision", "F1", "difficulty MAE", "bucket accuracy"], rows)]
    b = cut(bundles(p, limit, p.llm))
    text += ["", "## Guidance", "", f"The first {limit} theorems in file order, no sample of them.", "", *report.markdown_table(guidance.bundle_summary(b), ["bundles", "avg_neighbors", "avg_premises", "avg_strategies", "avg_difficulty_neighbors"])]
    h = guidance.histograms(b)
    for kind, title in (("bucket", "difficulty bucket"), ("domain", "domain")):
        text += ["", f"### By {title}", "", *report.markdown_table(h.where(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(8), ["value", "n", "share"])]
    _, _, premises, strategies = _guidance(p, limit, p.llm)
    text += ["", "### Evidence", "", *report.markdown_table(guidance.evidence(premises, strategies, train_names(p)).orderBy("kind", "rank"), ["kind", "name", "score"])]
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(c)
    some = b.orderBy("theorem_id").limit(5).select("full_name", "domain_tag", n("neighbors"), n("premise_suggestions"), n("strategy_facets"), "difficulty_bucket")
    text += ["", "### Examples", "", *report.markdown_table(some, some.columns)]
    return [*text, "", "## Glossary", "", *report.markdown_rows(["term", "meaning"], [list(x) for x in _GLOSSARY])]


@query
def report_markdown(p: Pipeline) -> DataFrame:
    return p.m.spark.createDataFrame(list(enumerate(report_lines(p))), "line int, text string")


def enrichment_answers(p: Pipeline, cache: DataFrame | None, **options: object) -> DataFrame:
    """Answers for all theorems of the pipeline's tables, asked for anew where the cache has none for the same prompt."""
    shown = enrich.prompt_rows(p.m.theorems(), p.theorem_states, p.max_states)
    model = options.pop("model", "offline")
    return enrich.enrichment_run(cut(enrich.requests(shown, model)), cache, **options)


@query
def llm_enrich_stub(p: Pipeline) -> DataFrame:
    """Answers of the offline client for theorems that the enrichment table lacks or answers for another prompt."""
    cache = p.m.enrichment().where("prompt_hash IS NOT NULL").select("theorem_id", "prompt_hash", "model")
    wanted = enrich.requests(enrich.prompt_rows(p.m.theorems(), p.theorem_states), "offline")
    return enrich.enrich(enrich.uncached(wanted, cache)).drop("created_at")


@query
def enrichment_summary(p: Pipeline) -> DataFrame:
    return enrich.enrichment_summary(cut(enrichment_answers(p, None)))


@query
def hash_embed(p: Pipeline) -> DataFrame:
    return enrich.embed(p.profiles.select(F.col("theorem_id").alias("id"), F.col("profile_text").alias("text")))
