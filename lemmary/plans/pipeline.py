"""The retrieval pipeline of one table folder: sources, fusions and evaluation, each part computed once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.operators import fusion, metrics, profiles, retrieval, tfidf
from lemmary.operators.cut import drop_shuffles, store
from lemmary.plans.model import Model


class Pipeline:
    """``split`` states and theorems as queries against those of train."""

    def __init__(self, model: Model, split: str = "test", k: int = 100, neighbor_k: int = 20, embeddings: DataFrame | None = None, llm: bool = True, pretrained: bool = True, max_states: int = 5) -> None:
        """``embeddings``: (entity_type, id, embedding) of an encoder for the pretrained sources; else they rank by cosine of the given vectors.

        ``llm`` and ``pretrained`` say whether the sources and fusions that need enrichment and an encoder take part.
        """
        self.m, self.split, self.k, self.neighbor_k, self.embeddings, self.max_states = model, split, k, neighbor_k, embeddings, max_states
        self.llm, self.pretrained = llm, pretrained

    @property
    def active_sources(self) -> list[str]:
        return [s for s in SOURCES if (self.llm or not s.endswith("_llm")) and (self.pretrained or not s.startswith("pretrained_"))]

    @property
    def methods(self) -> list[str]:
        """The names of all rankings that take part."""
        return [*self.active_sources, "dense_lexical_rrf", "full_union_rrf", *[f"weighted_rrf_{n}" for n in fusion.active_presets(self.llm, self.pretrained)]]

    def together(self, *names: str) -> None:
        """Compute parts that don't need each other at the same time, so that small stages fill the cluster."""
        with ThreadPoolExecutor(len(names)) as pool:
            for done in [pool.submit(getattr, self, n) for n in names]:
                done.result()
        drop_shuffles(self.m.spark)

    # proof state -> premise

    @cached_property
    def states(self) -> DataFrame:
        return store(self.m.states())

    @property
    def theorem_states(self) -> DataFrame:
        return self.m.theorem_states()

    @cached_property
    def premises(self) -> DataFrame:
        return store(self.m.premises())

    @cached_property
    def state_vectors(self) -> DataFrame:
        return store(self.m.vectors("ProofState"))

    @cached_property
    def pool(self) -> DataFrame:
        """Train premises with a vector: what the state queries can retrieve."""
        train = self.premises.where("split = 'train'").select("id")
        return store(self.m.vectors("Premise").join(train, "id", "left_semi"))

    @cached_property
    def gold(self) -> DataFrame:
        s = self.states.where(F.col("split") == self.split).select(F.col("id").alias("neighbor_id"))
        return store(self.state_edges.join(s, "neighbor_id", "left_semi").select(F.col("neighbor_id").alias("query_id"), "item_id"))

    @cached_property
    def queries(self) -> DataFrame:
        """Eligible states with their vectors: of the split, with gold premises and a vector."""
        s = self.states.where(F.col("split") == self.split)
        has_gold = self.gold.select(F.col("query_id").alias("id"))
        return store(s.join(self.state_vectors.select("id", "v"), "id").join(has_gold, "id", "left_semi"))

    @cached_property
    def premise_searches(self) -> DataFrame:
        """Premises nearest to the queries by inner product and by cosine, which stands for the vectors of an encoder: one pass."""
        return store(retrieval.dense_and_cosine_top_k(self.queries, self.pool, self.k))

    @cached_property
    def premise_dots(self) -> DataFrame:
        """Those by inner product alone."""
        return store(retrieval.dense_top_k(self.queries, self.pool, self.k))

    @cached_property
    def state_searches(self) -> DataFrame:
        """Train states nearest to the queries by both measures, once for k = 100; smaller k and all modes are taken from it."""
        return store(retrieval.dense_and_cosine_top_k(self.queries, self.train_states, 100))

    @cached_property
    def state_dots(self) -> DataFrame:
        return store(retrieval.dense_top_k(self.queries, self.train_states, 100))

    def has(self, part: str) -> bool:
        """Whether a part has been computed."""
        return part in vars(self)

    @staticmethod
    def by(searches: DataFrame, measure: str) -> DataFrame:
        return searches.where(F.col("measure") == measure).drop("measure")

    @property
    def dense(self) -> DataFrame:
        return self.by(self.premise_searches, "dot") if self.has("premise_searches") else self.premise_dots

    def encoded(self, kind: str, like: DataFrame) -> DataFrame:
        """Vectors (id, v) of the encoder's table for the ids of ``like``."""
        v = self.embeddings.where(F.col("entity_type") == kind).select("id", F.col("embedding").cast("array<double>").alias("v"))
        return v.join(like.select("id"), "id", "left_semi")

    @cached_property
    def pretrained_dense(self) -> DataFrame:
        if self.embeddings is None:
            return self.by(self.premise_searches, "cosine")
        train = self.premises.where("split = 'train'")
        return store(retrieval.dense_top_k(self.encoded("ProofState", self.queries), self.encoded("Premise", train), self.k))

    @cached_property
    def lexical(self) -> DataFrame:
        q = self.queries.select("id", profiles.proof_state_profile().alias("text"))
        c = self.premises.where("split = 'train'").select("id", profiles.premise_profile().alias("text"))
        return store(tfidf.lexical_top_k(q, c, self.k))

    @cached_property
    def symbol(self) -> DataFrame:
        joined = lambda c: F.concat_ws(" ", F.coalesce(c, F.array().cast("array<string>")))
        terms = tfidf.symbol_terms(self.premises.where("split = 'train'"), ["full_name", "code", "file_path"])
        known = tfidf.symbol_vocabulary(terms)
        q = store(tfidf.symbol_rows(tfidf.symbol_terms(self.queries, [joined("symbols"), "goal_text", joined("local_hypotheses"), "full_name"]), known))
        return store(retrieval.sparse_top_k(q, store(tfidf.symbol_rows(terms, known)), self.k))

    @cached_property
    def train_states(self) -> DataFrame:
        train = self.states.where("split = 'train'").select("id")
        return self.state_vectors.join(train, "id", "left_semi")

    @property
    def similar_states(self) -> DataFrame:
        return self.by(self.state_searches, "dot") if self.has("state_searches") else self.state_dots

    @cached_property
    def state_edges(self) -> DataFrame:
        return store(self.m.edges().select(F.col("proof_state_id").alias("neighbor_id"), F.col("premise_id").alias("item_id")))

    def expanded(self, k_states: int, mode: str) -> DataFrame:
        return fusion.expand(self.similar_states, self.state_edges, k_states, self.k, mode)

    @cached_property
    def pretrained_similar_ps(self) -> DataFrame:
        if self.embeddings is None:
            near = self.by(self.state_searches, "cosine")
        else:
            near = retrieval.dense_top_k(self.encoded("ProofState", self.queries), self.encoded("ProofState", self.states.where("split = 'train'")), 100)
        return fusion.expand(near, self.state_edges, 100, self.k, "rank_sim")

    # theorem -> theorem

    @cached_property
    def profiles(self) -> DataFrame:
        return store(profiles.theorem_profiles(self.m.theorems(), self.theorem_states, self.max_states))

    @cached_property
    def llm_profiles(self) -> DataFrame:
        return store(profiles.append_enrichment(self.profiles, self.m.enrichment()))

    def _theorem_neighbors(self, p: DataFrame) -> DataFrame:
        docs = p.select(F.col("theorem_id").alias("id"), F.col("profile_text").alias("text"), "split")
        return store(tfidf.lexical_top_k(docs.where(F.col("split") == self.split).drop("split"), docs.where("split = 'train'").drop("split"), self.neighbor_k))

    @cached_property
    def theorem_neighbors(self) -> DataFrame:
        return self._theorem_neighbors(self.profiles)

    @cached_property
    def theorem_neighbors_llm(self) -> DataFrame:
        return self._theorem_neighbors(self.llm_profiles)

    @cached_property
    def theorem_neighbors_pretrained(self) -> DataFrame:
        t = self.m.theorems().select("id", "split")
        q, c = t.where(F.col("split") == self.split), t.where("split = 'train'")
        if self.embeddings is not None:
            return store(retrieval.dense_top_k(self.encoded("Theorem", q), self.encoded("Theorem", c), self.neighbor_k))
        v = self.m.vectors("Theorem")
        return store(self.by(retrieval.dense_and_cosine_top_k(v.join(q, "id", "left_semi"), v.join(c, "id", "left_semi"), self.neighbor_k), "cosine"))

    @cached_property
    def theorem_queries(self) -> DataFrame:
        return self.profiles.where(F.col("split") == self.split).select(F.col("theorem_id").alias("query_id"))

    @cached_property
    def train_theorem_edges(self) -> DataFrame:
        links = self.m.links().where("split = 'train'").select(F.col("proof_state_id").alias("neighbor_id"), "theorem_id")
        return store(self.state_edges.join(links, "neighbor_id").select(F.col("theorem_id").alias("neighbor_id"), "item_id").distinct())

    def neighbor_premises(self, neighbors: DataFrame) -> DataFrame:
        return fusion.expand(neighbors, self.train_theorem_edges, self.neighbor_k, self.k, "rank")

    def theorem_premises(self, neighbors: DataFrame) -> DataFrame:
        """The ranking of a state's theorem, for every eligible state."""
        of = self.queries.select(F.col("id").alias("query_id"), "theorem_id")
        ranked = self.neighbor_premises(neighbors).withColumnRenamed("query_id", "theorem_id")
        return of.join(ranked, "theorem_id").select("query_id", "item_id", "rank", "score")

    # fusion and evaluation

    def source(self, name: str) -> DataFrame:
        """(query_id, item_id, rank, score) of one source, computed when first asked for."""
        make = {
            "dense": lambda: self.dense, "lexical": lambda: self.lexical, "symbol": lambda: self.symbol, "similar_theorem": lambda: self.theorem_premises(self.theorem_neighbors),
            "similar_theorem_llm": lambda: self.theorem_premises(self.theorem_neighbors_llm), "pretrained_dense": lambda: self.pretrained_dense,
            "pretrained_similar_ps": lambda: self.pretrained_similar_ps, **{n: lambda v=v: self.expanded(*v) for n, v in EXPANSIONS.items()},
        }
        return make[name]()

    def sources(self, names: list[str]) -> DataFrame:
        """(source, query_id, item_id, rank, score) of the named sources; parts they need are computed side by side, expansions in one pass."""
        own = {"pretrained_dense", "pretrained_similar_ps"} if self.embeddings is not None else set()
        needed = {n if n in own else SEARCHES.get(n, n) for n in names}
        for dots, both in (("premise_dots", "premise_searches"), ("state_dots", "state_searches")):
            if both in needed or self.has(both):
                needed = needed - {dots} | ({both} if dots in needed else set())
        if len(needed) > 1:
            self.together("states", "premises", "state_vectors", "state_edges")
            self.together("gold", "pool", "profiles", "train_theorem_edges")
            self.together("queries")
            todo = sorted(needed)
            for at in range(0, len(todo), 2):  # more at a time would hold the shuffles of all on disk
                self.together(*todo[at : at + 2])
        expanded = {n: v for n, v in EXPANSIONS.items() if n in names}
        parts = []
        if expanded:
            parts = [fusion.expand_all(self.similar_states, self.state_edges, expanded, self.k).select("source", "query_id", "item_id", "rank", "score")]
        names = [n for n in names if n not in expanded]
        return reduce(DataFrame.unionByName, [self.source(n).select(F.lit(n).alias("source"), "query_id", "item_id", "rank", "score") for n in names] + parts)

    @cached_property
    def all_sources(self) -> DataFrame:
        return store(self.sources(self.active_sources))

    def fused(self, names: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
        """The named fusions (all: None), over the sources they weigh."""
        chosen = {n: w for n, w in fusion.PRESETS.items() if names is None or n in names}
        needed = sorted({s for w in chosen.values() for s, x in w.items() if x > 0})
        return fusion.fuse(self.sources(needed) if sources is None else sources, fusion.presets_table(self.m.spark, chosen), self.k)

    def union(self, names: list[str]) -> DataFrame:
        return fusion.rank_union(self.sources(names), names, self.k)

    @property
    def _ranked(self) -> DataFrame:
        """Every active source, kept only if it is already."""
        return self.all_sources if self.has("all_sources") else self.sources(self.active_sources)

    @property
    def _fusions(self) -> dict[str, dict[str, float]]:
        """The weights of every fusion that takes part."""
        plain = {"dense_lexical_rrf": ["dense", "lexical"], "full_union_rrf": ["dense", "lexical", "symbol", "similar_ps"]}
        return {n: dict.fromkeys(s, 1.0) for n, s in plain.items()} | {f"weighted_rrf_{n}": w for n, w in fusion.active_presets(self.llm, self.pretrained).items()}

    @cached_property
    def all_hits(self) -> DataFrame:
        """(method, query_id, item_id, rank): the gold premises in the rankings of every source and fusion."""
        return store(fusion.hits(self._ranked, self.active_sources, self._fusions, self.gold, self.k))

    @property
    def all_lists(self) -> DataFrame:
        """(query_id, a column for each of ``methods``): the whole rankings of every source and fusion as texts."""
        return fusion.lists(self._ranked, self.active_sources, self._fusions, self.k)

    @cached_property
    def all_rankings(self) -> DataFrame:
        """(method, query_id, item_id, rank): every source and fusion."""
        fused = fusion.fuse(self.all_sources, fusion.presets_table(self.m.spark, self._fusions), self.k)
        return store(self.all_sources.select(F.col("source").alias("method"), "query_id", "item_id", "rank").unionByName(fused.select(F.col("preset").alias("method"), "query_id", "item_id", "rank")))

    def ranking(self, method: str) -> DataFrame:
        """(method, query_id, item_id, rank) of one source or weighted fusion."""
        r = self.source(method) if method in SOURCES else self.fused([method.removeprefix("weighted_rrf_")])
        return r.select(F.lit(method).alias("method"), "query_id", "item_id", "rank")

    def rows(self, method: str | None = None) -> DataFrame:
        """Metrics per method and eligible query; queries that a method ranks nothing for have their row too."""
        r = self.all_hits if method is None else self.ranking(method)  # metrics look at gold premises alone
        q = self.queries.select(F.col("id").alias("query_id"))
        methods = [method] if method else self.methods
        q = q.withColumn("method", F.explode(F.array(*[F.lit(x) for x in methods])))
        return metrics.ranking_rows(q, r, self.gold, self.pool)

    def theorem_rows(self, neighbors: DataFrame) -> DataFrame:
        gold = self.m.edges_by_theorem(self.split).select(F.col("theorem_id").alias("query_id"), F.col("premise_id").alias("item_id"))
        return metrics.ranking_rows(self.theorem_queries, self.neighbor_premises(neighbors), gold, self.m.pool())


SOURCES = [
    "dense", "lexical", "symbol", "similar_ps", "similar_ps_k50", "similar_ps_k100", "similar_ps_k100_sim", "similar_ps_k100_rank_sim",
    "similar_theorem", "similar_theorem_llm", "pretrained_dense", "pretrained_similar_ps",
]
#: Variants of the similar-state source: neighbours, weighting.
EXPANSIONS = {
    "similar_ps": (25, "rank"), "similar_ps_k50": (50, "rank"), "similar_ps_k100": (100, "rank"), "similar_ps_k100_sim": (100, "sim"), "similar_ps_k100_rank_sim": (100, "rank_sim"),
}
#: The part that a source is taken from, where it isn't its own.
SEARCHES = {
    "dense": "premise_dots", "pretrained_dense": "premise_searches", "pretrained_similar_ps": "state_searches", "similar_theorem": "theorem_neighbors", "similar_theorem_llm": "theorem_neighbors_llm", **dict.fromkeys(EXPANSIONS, "state_dots"),
}
