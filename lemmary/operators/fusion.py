"""Expansion of neighbours into items and reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The weight of a vote by the rank and score of its neighbour.
MODES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "rank": lambda rank, score: 1.0 / rank,
    "sim": lambda rank, score: np.maximum(0.0, score),
    "rank_sim": lambda rank, score: np.maximum(0.0, score) / rank,
}


def expand_all(neighbors: DataFrame, edges: DataFrame, variants: dict[str, tuple[int, str]], k: int = 100) -> DataFrame:
    """(source, query_id, item_id, rank, score): items of the first neighbours, for every variant (neighbours, mode) in one pass.

    A vote weighs by rank, similarity (negative: 0) or both. ``edges``: (neighbor_id, item_id), distinct. A neighbour
    without items gives none; an unknown mode is a ValueError.
    """
    for _, mode in variants.values():
        if mode not in MODES:
            raise ValueError(f"unknown expansion mode: {mode}")
    near = neighbors.where(F.col("rank") <= max(first for first, _ in variants.values())).select("query_id", F.col("item_id").alias("neighbor_id"), "rank", "score")
    votes = near.join(edges, "neighbor_id").select(F.lit("").alias("source"), "query_id", "item_id", "rank", "score")

    def each(x: _Lists) -> Iterator[list[pa.Array]]:
        for n, (first, mode) in variants.items():
            m = x.ranks <= first
            yield x.rows(n, *x.summed(x.pair[m], MODES[mode](x.ranks[m], x.scores[m]), k))

    return _by_query(votes, [], each, "source string, query_id string, item_id string, rank int, score double")


def expand(neighbors: DataFrame, edges: DataFrame, k_neighbors: int, k: int = 100, mode: str = "rank") -> DataFrame:
    """(query_id, item_id, rank, score) of one variant of :func:`expand_all`."""
    return expand_all(neighbors, edges, {"one": (k_neighbors, mode)}, k).drop("source")


#: The weights of the named fusions, by source.
PRESETS: dict[str, dict[str, float]] = {
    "balanced": {"dense": 1.0, "lexical": 1.0, "symbol": 0.7, "similar_ps": 1.0},
    "lexical_ps": {"dense": 0.8, "lexical": 1.2, "symbol": 0.4, "similar_ps": 1.4},
    "ps_heavy": {"dense": 0.7, "lexical": 1.0, "symbol": 0.3, "similar_ps": 2.0},
    "ps_heavy_k50": {"dense": 0.7, "lexical": 1.0, "symbol": 0.3, "similar_ps_k50": 2.0},
    "ps_heavy_k100": {"dense": 0.7, "lexical": 1.0, "symbol": 0.3, "similar_ps_k100": 2.0},
    "ps_heavy_k100_sim": {"dense": 0.7, "lexical": 1.0, "symbol": 0.3, "similar_ps_k100_sim": 2.0},
    "ps_heavy_k100_rank_sim": {"dense": 0.7, "lexical": 1.0, "symbol": 0.3, "similar_ps_k100_rank_sim": 2.0},
    "tuned_frontier": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5},
    "tuned_recall": {"dense": 1.0, "lexical": 1.2, "symbol": 0.0, "similar_ps_k100_rank_sim": 2.5},
    "theorem_source": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem": 1.0},
    "theorem_heavy": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem": 2.0},
    "theorem_frontier": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem": 0.75},
    "theorem_tuned": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem": 2.5},
    "llm_theorem_source": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem_llm": 1.0},
    "llm_theorem_tuned": {"dense": 1.0, "lexical": 1.2, "symbol": 0.2, "similar_ps_k100_rank_sim": 2.5, "similar_theorem_llm": 2.5},
    "pretrained_tuned": {"dense": 0.6, "lexical": 1.0, "pretrained_dense": 1.4, "pretrained_similar_ps": 1.8, "similar_ps_k100_rank_sim": 1.8, "similar_theorem": 1.2},
    "llm_pretrained_tuned": {"dense": 0.6, "lexical": 1.0, "pretrained_dense": 1.4, "pretrained_similar_ps": 1.8, "similar_ps_k100_rank_sim": 1.8, "similar_theorem_llm": 2.0},
}


def active_presets(llm: bool, pretrained: bool) -> dict[str, dict[str, float]]:
    """The presets whose sources exist: those with an '_llm' source need ``llm``, those with a 'pretrained_' one ``pretrained``."""
    need = lambda w: (any(s.endswith("_llm") for s in w), any(s.startswith("pretrained_") for s in w))
    return {n: w for n, w in PRESETS.items() if need(w)[0] <= llm and need(w)[1] <= pretrained}


def presets_table(spark: SparkSession, presets: dict[str, dict[str, float]]) -> DataFrame:
    """(preset, source, weight); weights of 0 or less are left out, so such sources don't take part."""
    rows = [(n, s, float(w)) for n, ws in presets.items() for s, w in ws.items() if w > 0]
    return spark.createDataFrame(rows, "preset string, source string, weight double")


#: Rows of ranked lists that a task holds at a time (whole queries, so one with more is held too).
BATCH = 100_000
#: Stands for a source in rows that mark gold items.
GOLD = "\0gold"


def _whole_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by query as tables of about BATCH rows, cut between queries."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= BATCH:
            t = pa.Table.from_batches(held)
            first = pc.index(t.column("query_id"), t.column("query_id")[-1]).as_py()
            if first:
                yield t.slice(0, first)
                held, n = t.slice(first).to_batches(), n - first
    if n:
        yield pa.Table.from_batches(held)


class _Lists:
    """The ranked lists of some queries: every source's and, by weights, every fusion's."""

    def __init__(self, t: pa.Table, sources: list[str]) -> None:
        q, items, names = (t.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "item_id", "source"))
        self.query_ids, order = q.dictionary, pc.sort_indices(items.dictionary).to_numpy()
        self.item_ids, place = items.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = np.array([sources.index(x) if x in sources else -2 if x == GOLD else -1 for x in names.dictionary.to_pylist()])
        self.source, self.ranks = of[names.indices.to_numpy()], t.column("rank").to_numpy()
        self.scores = t.column("score").to_numpy() if "score" in t.column_names else None
        key = q.indices.to_numpy().astype(np.int64) * len(order) + place[items.indices.to_numpy()]
        keys, self.pair = np.unique(key, return_inverse=True)  # pairs by query, then item
        self.query, self.item = np.divmod(keys, max(1, len(order)))
        self.gold = np.zeros(len(keys), bool)
        self.gold[self.pair[self.source == -2]] = True
        m = self.source >= 0
        self.votes = np.bincount(self.pair[m] * len(sources) + self.source[m], 1.0 / self.ranks[m], len(keys) * len(sources)).reshape(len(keys), len(sources))

    def of_source(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, their ranks) of a source, by query and rank."""
        m = self.source == s
        pair, rank = self.pair[m], self.ranks[m]
        o = np.lexsort((pair, rank, self.query[pair]))
        return pair[o], rank[o]

    def fused(self, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, their ranks, scores) by the sum of weight / rank, the first k of each query."""
        return self._first(np.flatnonzero((self.votes[:, weights > 0] > 0).any(axis=1)), self.votes @ weights, k)

    def summed(self, pair: np.ndarray, vote: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the sum of a vote for each of ``pair``."""
        return self._first(np.unique(pair), np.bincount(pair, vote, len(self.query)), k)

    def _first(self, pair: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By score to 9 decimals (halves up) descending, then by item."""
        score = np.floor(score * 1e9 + 0.5) / 1e9
        pair = pair[np.lexsort((-score[pair], self.query[pair]))]
        q = self.query[pair]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        m = rank <= k
        return pair[m], rank[m], score[pair[m]]

    def rows(self, method: str, pair: np.ndarray, rank: np.ndarray, *score: np.ndarray) -> list[pa.Array]:
        """The columns method, query, item, rank(, score)."""
        return [pa.array([method] * len(pair), pa.string()), self.query_ids.take(pa.array(self.query[pair])), self.item_ids.take(pa.array(self.item[pair])), pa.array(rank.astype(np.int32)), *[pa.array(x) for x in score]]

    def texts(self, pair: np.ndarray) -> pa.Array:
        """The items of every query in the order of ``pair`` as one text with commas."""
        at = np.searchsorted(self.query[pair], np.arange(len(self.query_ids) + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), self.item_ids.take(pa.array(self.item[pair]))), ",")


def _by_query(sources: DataFrame, names: list[str], each: Callable[[_Lists], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """``each`` over the lists of whole queries: one shuffle, whatever the number of fusions."""
    rows = sources.select([c for c in ("source", "query_id", "item_id", "rank", "score") if c in sources.columns]).repartition("query_id").sortWithinPartitions("query_id")
    columns = [c.split(" ")[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_queries(batches):
            for arrays in each(_Lists(t, names)):
                yield from pa.table(arrays, names=columns).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, schema)


def _matrix(weights: dict[str, dict[str, float]]) -> tuple[list[str], dict[str, np.ndarray]]:
    """The sources that any fusion weighs, and the weights of each in that order; weights of 0 or less are left out."""
    names = sorted({s for w in weights.values() for s, x in w.items() if x > 0})
    return names, {n: np.array([max(0.0, w.get(s, 0.0)) for s in names]) for n, w in weights.items()}


def fuse(sources: DataFrame, presets: DataFrame, k: int = 100) -> DataFrame:
    """(preset, query_id, item_id, rank, score): sum of weight / rank over the sources, all presets in one pass.

    ``sources``: (source, query_id, item_id, rank). An item that stands twice in a list counts twice.
    """
    weights: dict[str, dict[str, float]] = {}
    for r in presets.collect():  # some weights for each of the named fusions
        weights.setdefault(r["preset"], {})[r["source"]] = r["weight"]
    names, vectors = _matrix(weights)

    def each(x: _Lists) -> Iterator[list[pa.Array]]:
        for n, w in vectors.items():
            yield x.rows(n, *x.fused(w, k))

    return _by_query(sources.where(F.col("source").isin(names)).select("source", "query_id", "item_id", "rank"), names, each, "preset string, query_id string, item_id string, rank int, score double")


def rank_union(sources: DataFrame, names: list[str], k: int = 100) -> DataFrame:
    """(query_id, item_id, rank, score): unweighted fusion of the named sources."""
    return fuse(sources, presets_table(sources.sparkSession, {"one": dict.fromkeys(names, 1.0)}), k).drop("preset")


def hits(sources: DataFrame, names: list[str], weights: dict[str, dict[str, float]], gold: DataFrame, k: int = 100) -> DataFrame:
    """(method, query_id, item_id, rank) of the gold items alone that the sources ``names`` and the fusions by ``weights`` rank."""
    vectors = {n: np.array([max(0.0, w.get(s, 0.0)) for s in names]) for n, w in weights.items()}
    marks = gold.select(F.lit(GOLD).alias("source"), "query_id", "item_id", F.lit(0).alias("rank"))

    def each(x: _Lists) -> Iterator[list[pa.Array]]:
        for n, (pair, rank) in [*((n, x.of_source(i)) for i, n in enumerate(names)), *((n, x.fused(w, k)[:2]) for n, w in vectors.items())]:
            m = x.gold[pair]
            yield x.rows(n, pair[m], rank[m])

    return _by_query(sources.select(*marks.columns).unionByName(marks), names, each, "method string, query_id string, item_id string, rank int")


def lists(sources: DataFrame, names: list[str], weights: dict[str, dict[str, float]], k: int = 100) -> DataFrame:
    """(query_id, and a text of ids with commas for each of ``names`` and of the fusions by ``weights``), for queries that a source ranks anything for."""
    vectors = {n: np.array([max(0.0, w.get(s, 0.0)) for s in names]) for n, w in weights.items()}

    def each(x: _Lists) -> Iterator[list[pa.Array]]:
        yield [x.query_ids, *[x.texts(x.of_source(i)[0]) for i in range(len(names))], *[x.texts(x.fused(w, k)[0]) for w in vectors.values()]]

    return _by_query(sources.select("source", "query_id", "item_id", "rank"), names, each, ", ".join(f"{c} string" for c in ["query_id", *names, *weights]))
