"""Problem 2: the most similar vectors of every vector, by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``width``-wide slots along ``hashes`` Gaussian directions. Every vector is indexed in
its own bucket of each table and looks into that bucket and ``probes`` neighbouring ones, visited in the order of their
estimated success (the template of Lv et al. over the sorted distances to the slot borders). Candidates of all tables are
merged, thinned by a 192-bit sign sketch whose bound lies 3.5 standard deviations beyond the threshold, and ranked by
exact cosine. Equal vectors form one class; a list can hold no more than the k + 1 smallest ids of a class (ties go to the
smaller id), so classes of any size stay exact without pairs inside them. A bucket that holds very many rows (nearly equal
vectors) is cut into blocks on both sides; every pair of blocks is a matrix product that keeps the best of each query, so
neither its pairs nor its rows meet in one task.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.llm.joins import hash_joins
from lemmary.operators.cut import cut, release

SKETCH_BITS = 192
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Buckets of more rows are ranked in blocks of fixed size instead of pair by pair.
LARGE_BUCKET, QUERY_BLOCK, INDEX_BLOCK = 1024, 2048, 4096


def probe_template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` perturbation sets of least expected score, as ranks (from 1) of the 2 * hashes border distances."""
    k = hashes

    def expected(j: int) -> float:
        if j <= k:
            return j * (j + 1) / (4 * (k + 1) * (k + 2))
        m = 2 * k + 1 - j
        return 1 - m / (k + 1) + m * (m + 1) / (4 * (k + 1) * (k + 2))

    scored = []
    for size in range(1, 5):
        for c in itertools.combinations(range(1, min(2 * k, 14) + 1), size):
            if all(2 * k + 1 - x not in c for x in c):
                scored.append((sum(expected(x) for x in c), c))
    return [c for _, c in sorted(scored)[:probes]]


def default_hashes(n: int) -> int:
    """Directions per table for ``n`` vectors: one more per doubling beyond 2**16, so that buckets keep their size."""
    return 9 + max(0, math.ceil(math.log2(max(n, 1) / 65536)))


class Hasher:
    """The random directions, the same on every executor for one seed."""

    def __init__(self, dim: int, hashes: int, width: float, tables: int, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.w, self.l = hashes, width, tables
        self.a = rng.normal(size=(dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.mult = rng.integers(1, 2**62, (tables, hashes), dtype=np.int64) | 1
        self.sign = rng.normal(size=(dim, SKETCH_BITS))
        self.template = probe_template(hashes, probes)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.sign > 0, axis=1).view(">i8").astype(np.int64)

    def buckets(self, x: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own buckets (n, tables) and probed ones (n, tables, 1 + probes); ``salt`` keeps the kinds of entities apart."""
        f = ((x @ self.a + self.b) / self.w).reshape(len(x), self.l, self.k)
        slot = np.floor(f)
        frac, slot = f - slot, slot.astype(np.int64)
        with np.errstate(over="ignore"):
            own = (slot * self.mult).sum(2) + salt[:, None] + np.arange(self.l, dtype=np.int64) * 0x1E3779B97F4A7C15
            score = np.concatenate([frac, 1 - frac], 2)
            order = np.argsort(score, 2)
            step = np.concatenate([-self.mult, self.mult], 1)
            sorted_step = np.take_along_axis(np.broadcast_to(step, score.shape), order, 2)
            probed = [own] + [own + sum(sorted_step[:, :, j - 1] for j in c) for c in self.template]
        return own, np.stack(probed, 2)


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(kind, id, v) of rows whose vector has ``dim`` finite values that aren't all zero, each entity once."""
    v = F.col("embedding")
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(ok).select(clean_key("entity_type").alias("kind"), clean_key("entity_id").alias("id"), v.alias("v"))
    return rows.where(F.col("kind").isNotNull() & F.col("id").isNotNull()).groupBy("kind", "id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, scaled to unit length."""
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(col), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _large_buckets(query: DataFrame, index: DataFrame, sizes: DataFrame, classes: DataFrame, best: int, min_cosine: float) -> DataFrame:
    """(a, b, cosine): for the queries of large buckets the ``best`` others of each block of a bucket, by cosine, then id."""
    asked = cut(query.select("bucket", "c").join(sizes, "bucket"))
    both = sizes.join(asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("nq")), "bucket")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    both = cut(both.select("bucket", blocks("nq", QUERY_BLOCK).alias("qn"), blocks("n", INDEX_BLOCK).alias("xn")))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("bucket", "c").join(both, "bucket").select("bucket", "c", part("c", "qn").alias("qb"), every("xn").alias("xb"))
    right = index.select("bucket", F.col("i_c").alias("c")).join(both, "bucket").select("bucket", "c", part("c", "xn").alias("xb"), every("qn").alias("qb"))
    left = left.join(classes.select("c", "v"), "c").select("bucket", "qb", "xb", F.col("c").alias("q_c"), F.col("v").alias("q_v"))
    right = right.join(classes.select("c", "cid", "v"), "c").select(F.col("bucket").alias("x_bucket"), F.col("qb").alias("x_qb"), F.col("xb").alias("x_xb"), F.col("c").alias("x_c"), "cid", F.col("v").alias("x_v"))

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])
        if not q.num_rows or not x.num_rows:
            return schema.empty_table()
        x = x.sort_by("cid")
        qc, xc, y = q.column("q_c").to_numpy(), x.column("x_c").to_numpy(), _matrix(x.column("x_v"))
        out = []
        for at in range(0, q.num_rows, 256):
            cos = np.round(_matrix(q.column("q_v").slice(at, 256)) @ y.T, 6)
            cos[qc[at : at + 256, None] == xc] = -9
            for r, row in enumerate(cos):
                near = np.nonzero(row >= min_cosine)[0]
                if len(near) > best:
                    near = near[row[near] >= np.partition(row[near], len(near) - best)[len(near) - best]]
                near = near[np.argsort(-row[near], kind="stable")][:best]
                out.append(pa.table([np.full(len(near), qc[at + r]), xc[near], row[near]], schema=schema))
        return pa.concat_tables(out)

    groups = left.groupBy("bucket", "qb", "xb").cogroup(right.groupBy("x_bucket", "x_qb", "x_xb"))
    return groups.applyInArrow(rank, "a long, b long, cosine double")


def nearest_lists(vectors: DataFrame, k: int = 10, min_cosine: float = 0.8, dim: int = 64, hashes: int | None = None, width: float | None = None, tables: int = 8, probes: int = 10, seed: int = 7) -> DataFrame:
    """(kind, id, other, cosine, rank): of every entity the k others of its kind with the highest cosine, from ``min_cosine`` on.

    Cosines are doubles rounded to 6 decimals; ties go to the smaller id. Null vectors, vectors of another length and zero
    vectors are neither queries nor answers. ``hashes`` defaults to
    :func:`default_hashes`, ``width`` grows with its root, which keeps the chance of a hit. Recall is below 1 by the nature
    of the method (measured: see README); what is returned has exact cosines.
    """
    entities = cut(usable_vectors(vectors, dim).withColumn("vm", F.md5(F.to_json("v").cast("binary"))))
    classes = entities.groupBy("kind", "vm").agg(F.min("id").alias("cid"), F.first("v").alias("v"))
    classes = cut(classes.select("kind", "vm", F.xxhash64("kind", "cid").alias("c"), "cid", "v"))
    spark, n = classes.sparkSession, classes.count()
    hashes = hashes or default_hashes(n)
    hasher = Hasher(dim, hashes, width or 0.6 * math.sqrt(hashes), tables, probes, seed)

    def salt(kinds: pa.Array) -> np.ndarray:
        seen = {x: (zlib.crc32(str(x).encode()) << 29) for x in set(kinds.to_pylist())}
        return np.array([seen[x] for x in kinds.to_pylist()], dtype=np.int64)

    def emit(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x = _matrix(b.column("v"))
                own, probed = hasher.buckets(x, salt(b.column("kind")))
                keys = probed.reshape(len(x), -1) if probing else own
                s = hasher.sketch(x)
                rep = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(b.column("c").to_numpy(), rep)), *[pa.array(np.repeat(s[:, i], rep)) for i in range(len(_SKETCH))]],
                    names=["bucket", "c", *_SKETCH],
                )

    schema = "bucket long, c long, " + ", ".join(f"{x} long" for x in _SKETCH)
    source = classes.select("kind", "c", "v")
    index = cut(source.mapInArrow(lambda it: emit(it, False), schema).select("bucket", *[F.col(x).alias(f"i_{x}") for x in ("c", *_SKETCH)]))
    query = source.mapInArrow(lambda it: emit(it, True), schema)
    sizes = cut(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_BUCKET))
    has_large = not sizes.isEmpty()
    small = index.join(sizes.select("bucket"), "bucket", "left_anti") if has_large else index
    p = math.acos(min_cosine) / math.pi
    far = math.ceil(SKETCH_BITS * p + 3.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))
    apart = reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"i_{x}"))) for x in _SKETCH])
    found = (
        query.join(small, "bucket")
        .where((F.col("c") != F.col("i_c")) & (apart <= far))
        .select(F.least("c", "i_c").alias("a"), F.greatest("c", "i_c").alias("b"))
        .distinct()
    )
    va, vb = classes.select(F.col("c").alias("a"), F.col("v").alias("va")), classes.select(F.col("c").alias("b"), F.col("v").alias("vb"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                t = whole.slice(at, 4000)
                cos = np.round((_matrix(t.column("va")) * _matrix(t.column("vb"))).sum(1), 6)
                keep = cos >= min_cosine
                yield pa.RecordBatch.from_arrays([pa.array(t.column("a").to_numpy()[keep]), pa.array(t.column("b").to_numpy()[keep]), pa.array(cos[keep])], names=["a", "b", "cosine"])

    with hash_joins(spark):
        close = cut(found.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(rank, "a long, b long, cosine double"))
    if not has_large:
        release(index, sizes)
    members = entities.select("kind", "id", "vm").join(classes.select("kind", "vm", "c"), ["kind", "vm"]).select("kind", "id", "c")
    by_class = Window.partitionBy("c").orderBy("id")
    first = cut(members.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1))
    own = first.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("cosine"))
    turned = lambda d: d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    sides = turned(close)
    if has_large:
        sides = sides.unionByName(_large_buckets(query, index, sizes, classes, k + 1, min_cosine)).dropDuplicates(["a", "b"])
    sides = sides.unionByName(own)
    # per class: the k + 1 best other entities, then per member without itself
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), F.asc("other"))
    answers = first.select(F.col("c").alias("b"), F.col("id").alias("other"))
    per_class = sides.join(answers, "b").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select(F.col("a").alias("c"), "other", "cosine")
    mine = Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), F.asc("other"))
    return (
        members.join(per_class, "c").where("id != other").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("kind", "id", "other", "cosine", "rank")
    )


def list_pairs(lists: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one is in the other's list."""
    return lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
