"""Top-k retrieval: a stated set of queries against all candidates, in blocks, exactly.

Queries are hashed into blocks; a block and all candidates (or, if there are fewer blocks than cores, a share of them) are a
cell, one task. It reads the candidates in blocks of their own, scores them with numpy (BLAS for dense columns, merged postings
for rare terms) and holds the k best so far of every query, which alone leave it. A last window takes the k best over cells.
Blocks have a fixed size, so a task's memory doesn't grow with the data, nor do the rows that leave it with the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 32_768, 16_384
#: Queries of a block that are scored at once: bounds the score matrix of a task to CHUNK x CANDIDATE_BLOCK doubles.
CHUNK = 1024
#: Terms that meet in more than this part of all pairs of a block are multiplied densely, the others by merged postings.
DENSE_SHARE = 0.0005


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks from 1 by score (9 decimals) descending, then item id; the first ``k`` of each ``by``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("item_id"))
    rounded = scored.withColumn("score", F.round("score", 9))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "item_id", "rank", "score")


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and their lengths per row."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


#: Of a block of candidates, what scores a table of queries with it.
Scorer = Callable[[pa.Table], np.ndarray]


def _vectors(t: pa.Table) -> np.ndarray:
    return _flat(t.column("v"))[0].reshape(t.num_rows, -1).astype(np.float64)


def dense_scores(c: pa.Table) -> Scorer:
    cv = _vectors(c).T
    return lambda q: _vectors(q) @ cv


def cosine_scores(c: pa.Table) -> Scorer:
    def unit(t: pa.Table) -> np.ndarray:
        x = _vectors(t)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    cv = unit(c).T
    return lambda q: unit(q) @ cv


def sparse_scores(c: pa.Table) -> Scorer:
    """Inner products of (t: term ids, w: weights) rows. The postings of a block are sorted once for all its queries."""
    ct, n = _flat(c.column("t"))
    o = np.argsort(ct, kind="stable")
    ci, cw = np.repeat(np.arange(c.num_rows), n)[o], _flat(c.column("w"))[0][o]
    known, start = np.unique(ct[o], return_index=True)
    nc = np.diff(np.append(start, len(ct)))

    def postings(k: np.ndarray) -> np.ndarray:
        """The places of the postings of terms ``k``, one term after the other."""
        n = nc[k]
        return np.repeat(start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def scores(q: pa.Table) -> np.ndarray:
        out = np.zeros((q.num_rows, c.num_rows))
        if not len(known):
            return out
        qt, n = _flat(q.column("t"))
        qk = np.minimum(np.searchsorted(known, qt), len(known) - 1)
        m = known[qk] == qt
        qi, qk, qw = np.repeat(np.arange(q.num_rows), n)[m], qk[m], _flat(q.column("w"))[0][m]
        dense = np.bincount(qk, minlength=len(known)) * nc > DENSE_SHARE * out.size
        which = np.nonzero(dense)[0]
        for at in range(0, len(which), 512):
            some = which[at : at + 512]
            part = np.full(len(known), -1)
            part[some] = np.arange(len(some))
            a, b = np.zeros((q.num_rows, len(some))), np.zeros((c.num_rows, len(some)))
            m, pos = part[qk] >= 0, postings(some)
            a[qi[m], part[qk[m]]] = qw[m]
            b[ci[pos], np.repeat(np.arange(len(some)), nc[some])] = cw[pos]
            out = out + a @ b.T if at else a @ b.T
        flat, m = out.reshape(-1), ~dense[qk]
        qi, qk, qw = qi[m], qk[m], qw[m]
        for at in range(0, len(qi), 20_000):
            a, k, w = qi[at : at + 20_000], qk[at : at + 20_000], qw[at : at + 20_000]
            pos = postings(k)
            cell = np.repeat(a, nc[k]) * c.num_rows + ci[pos]
            o = np.argsort(cell, kind="stable")
            cell, value = cell[o], (np.repeat(w, nc[k]) * cw[pos])[o]
            first = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0] if len(cell) else np.zeros(0, np.int64)
            if len(first):
                flat[cell[first]] += np.add.reduceat(value, first)
        return out

    return scores


def block_top_k(queries: DataFrame, candidates: DataFrame, k: int, measures: dict[str, Callable[[pa.Table], Scorer]], columns: list[str], keep_zero: bool) -> DataFrame:
    """(measure, query_id, item_id, rank, score): the k best candidates of every query by each of ``measures`` over ``columns``.

    All measures are taken in one pass over the pairs of blocks. ``keep_zero``: whether candidates without any score count
    (dense: always k; sparse: only what has a term in common). No queries or no candidates give no rows.
    """
    n_candidates = candidates.count()
    spread = min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_candidates / 256))  # small inputs use all cores too
    nq = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    nc = max(1, math.ceil(spread / nq))
    chunk, block = CHUNK, CANDIDATE_BLOCK
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.lit(0).alias("side"), "id", *columns, place(nq).alias("left"), each(nc).alias("right"))
    c = candidates.select(F.lit(1).alias("side"), "id", *columns, place(nc).alias("right"), each(nq).alias("left"))
    cells = q.unionByName(c).repartitionById(nq * nc, F.col("left") * nc + F.col("right")).drop("left", "right").sortWithinPartitions("side", "id")
    schema = pa.schema([("measure", pa.string()), ("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64())])

    def better(row: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The at most k best places of a row and their rounded scores above ``least``, in order; of equal scores the first.

        Only what can be among them is rounded.
        """
        at = np.flatnonzero(row > least - 1e-9)
        if not keep_zero:
            at = at[np.abs(row[at]) > 5e-10]
        if len(at) > k:
            kth = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= kth - 1e-9]
        v = np.round(row[at], 9)
        m = (v > least) & (keep_zero | (v != 0))
        at, v = at[m], v[m]
        o = np.argsort(-v, kind="stable")[:k]
        return at[o], v[o]

    def found(asked: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        """Blocks of candidates in order of their ids against all queries of a cell; k places per query and measure are held."""
        shape = (len(measures), asked.num_rows, k)
        score, item, ids, n_ids = np.full(shape, -np.inf), np.zeros(shape, np.int64), [], 0
        for some in blocks:
            for m, of in enumerate(measures.values()):
                scores = of(some)
                for at in range(0, asked.num_rows, chunk):
                    for r, row in enumerate(scores(asked.slice(at, chunk)), at):
                        new, values = better(row, score[m, r, -1])
                        if len(new):
                            both = np.concatenate([score[m, r], values])
                            o = np.argsort(-both, kind="stable")[:k]
                            score[m, r], item[m, r] = both[o], np.concatenate([item[m, r], n_ids + new])[o]
            ids, n_ids = [*ids, some.column("id").combine_chunks()], n_ids + some.num_rows
            if n_ids > 2 * item.size + block:  # ids that no place holds are dropped
                used, at = np.unique(item, return_inverse=True)
                ids, n_ids, item = [pa.chunked_array(ids).take(pa.array(used)).combine_chunks()], len(used), at.reshape(shape)
        for m, name in enumerate(measures):
            for at in range(0, asked.num_rows, chunk):
                i, j = np.nonzero(score[m, at : at + chunk] > -np.inf)
                items = pa.chunked_array(ids).take(pa.array(item[m, at + i, j]))
                yield from pa.table([pa.array([name] * len(i), pa.string()), asked.column("id").take(pa.array(at + i)), items, pa.array(score[m, at + i, j])], schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a cell, the queries and then the candidates."""
        asked, rest = [], []
        for b in batches:
            first = int(np.count_nonzero(b.column("side").to_numpy() == 0))
            asked += [b.slice(0, first)] if first else []
            rest += [b.slice(first)] if first < b.num_rows else []
            if rest:
                break

        def blocks() -> Iterator[pa.Table]:
            held = rest
            for b in batches:
                if sum(x.num_rows for x in held) + b.num_rows > block:
                    yield from cut_up(held)
                    held = []
                held.append(b)
            yield from cut_up(held)

        def cut_up(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
            t = pa.Table.from_batches(held)
            yield from (t.slice(at, block) for at in range(0, t.num_rows, block))

        if asked and rest:
            yield from found(pa.Table.from_batches(asked).combine_chunks(), blocks())

    return top_k(cells.mapInArrow(run, "measure string, query_id string, item_id string, score double"), k, ("measure", "query_id"))


def dense_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """By inner product of ``v`` (double); always min(k, candidates) rows per query, negative scores included."""
    return block_top_k(queries, candidates, k, {"dot": dense_scores}, ["v"], True).drop("measure")


def dense_and_cosine_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(measure, query_id, item_id, rank, score) by inner product ('dot') and by cosine ('cosine') of ``v``, in one pass."""
    return block_top_k(queries, candidates, k, {"dot": dense_scores, "cosine": cosine_scores}, ["v"], True)


def sparse_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """By inner product of sparse rows (t, w); candidates without a common term are left out."""
    return block_top_k(queries, candidates, k, {"dot": sparse_scores}, ["t", "w"], False).drop("measure")
