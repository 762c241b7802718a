"""Problem 5: texts of val and test that occur again in train, the same or nearly so, by an edit-distance segment join.

An evaluation text is cut into consecutive segments. Edits that leave two texts at a Jaccard similarity of t or more (over
substrings of 5 characters) break at most k segments (:func:`allowed_breaks`), so of any k + 1 segments at least one stands
unbroken in the training text, at a position that can differ by no more than the characters inserted or left out before it.
The k + 1 segments with the rarest substrings are matched with all substrings of the training texts at allowed positions,
and banded dynamic programming gives the edit distance of what matches.

The cases are defined by substring sets, and two sets can be alike although no edits connect the texts: blocks moved further
than edits could, or repetitions in another order. Such pairs come from an exact path beside it: two sets at t share one of
the k + 1 rarest substrings of either, k being the number of substrings a text may lose. Both paths are one join under one
pair of sound bounds, on sizes and on the parity of hashed substrings (two sets differ in at least as many elements as their
parities in bits); the exact sets decide at the end. Every pair tells its path, so what the segment join finds alone is known.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.llm.joins import hash_joins
from lemmary.operators.cut import cut, drop_shuffles, release

#: Tables that are broadcast, of fixed size however large the corpus: 2**20 counts, 2**26 bits.
COUNT_BITS, SEEN_BITS = 20, 26
#: Texts of a batch, whose number takes so many bits of a sort key; the substring keeps what rarity (8 bits) leaves.
TEXT_BITS = 10
#: Bits of the parity sketch of a text's set of substrings.
PARITY_BITS = 256
#: Texts of so many characters are joined in one pass over all keys; n squared times as many in n, each over a share of the keys.
PASS_CHARS = 1 << 24
_SKETCH = [f"s{i}" for i in range(PARITY_BITS // 64)]
_EPS = 1e-9
_REST = np.uint64(0xD6E8FEB86659FD93)


def normal_text(text: str) -> str:
    """Lower case, each run of white space one space, ends trimmed."""
    return " ".join(text.lower().split())


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def substring_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of every substring of ``size`` characters of the texts, in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    n = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(lengths) - lengths, n) + pos
    h = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[i : i + len(h)]
            h += np.uint64(1)
            h ^= h >> np.uint64(29)
        return _mix(h[at]), owner, pos


def allowed_breaks(n: np.ndarray, threshold: float, size: int) -> np.ndarray:
    """How many consecutive segments of 2 * size - 1 characters edits can break in a text of ``n`` substrings that stays at ``threshold``.

    A text may lose (1 - threshold) * n substrings, those it gains counting ``threshold`` each. Leaving out b characters
    inside costs b + (size - 1) * (1 + threshold) and breaks one segment for b = 1, two for b = 2, which is the most that a
    cost buys (other edits and larger b break fewer for theirs); at either end leaving out one costs 1 and breaks one.
    """
    room = np.floor((1 - threshold) * n + _EPS)
    one = 1 + (size - 1) * (1 + threshold)
    inside = np.maximum(room - 2, 0)
    return (np.minimum(room, 2) + 2 * np.floor(inside / (one + 1)) + (inside % (one + 1) >= one)).astype(np.int64)


def banded_distances(pairs: list[tuple[str, str]], band: list[int]) -> list[int | None]:
    """Edit distances by dynamic programming over a diagonal band of each pair; None where it exceeds the pair's band.

    Pairs of similar length are computed together, one row of the tables at a time; insertions along a row become a
    running minimum.
    """
    out: list[int | None] = [None] * len(pairs)
    todo = sorted((i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= band[i]), key=lambda i: (len(pairs[i][0]), band[i]))
    for at in range(0, len(todo), 64):
        part = todo[at : at + 64]
        a, b, w = [pairs[i][0] for i in part], [pairs[i][1] for i in part], max(band[i] for i in part)
        la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        rows, n = int(la.max()), len(part)
        ca = np.full((n, rows), 0, np.uint32)
        cb = np.full((n, rows + 2 * w + 2 + max(0, int(lb.max()) - rows)), 1, np.uint32)  # 0 and 1 never equal a character in use
        for r, (x, y) in enumerate(zip(a, b, strict=True)):
            ca[r, : la[r]] = np.frombuffer(x.encode("utf-32-le"), np.uint32) + 2
            cb[r, w : w + lb[r]] = np.frombuffer(y.encode("utf-32-le"), np.uint32) + 2
        far = 1 << 20
        offs = np.arange(2 * w + 1)
        d = np.broadcast_to(np.where(offs >= w, offs - w, far), (n, 2 * w + 1)).astype(np.int64)
        result = np.where(la == 0, lb, far)
        for i in range(1, rows + 1):
            j = i + offs - w  # column of each cell
            window = cb[:, i - 1 : i + 2 * w]
            if window.shape[1] < 2 * w + 1:
                window = np.pad(window, ((0, 0), (0, 2 * w + 1 - window.shape[1])), constant_values=1)
            step = d + (window != ca[:, i - 1 : i])
            up = np.concatenate([d[:, 1:] + 1, np.full((n, 1), far)], 1)
            d = np.minimum(step, up)
            d[:, j < 0] = far
            if 0 <= w - i:
                d[:, w - i] = i
            d = np.minimum.accumulate(d - offs, axis=1) + offs
            done = la == i
            if done.any():
                col = lb[done] - i + w
                result[done] = d[done, np.clip(col, 0, 2 * w)]
        for r, i in enumerate(part):
            if result[r] <= band[i]:
                out[i] = int(result[r])
    return out


def text_classes(rows: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (kind, id, text, split): members (kind, id, side, k) with side 'train' or 'eval'; texts (k, i, kind, text, in_train, in_eval), each text of a kind once, ``i`` its number."""
    split = F.trim(F.col("split"))
    side = F.when(split == "train", "train").when(split.isin("val", "test"), "eval")
    sided = rows.select("kind", clean_key("id").alias("id"), side.alias("side"), "text").where("id IS NOT NULL AND side IS NOT NULL AND text IS NOT NULL")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normal_text(t) for t in b.column("text").to_pylist()]
            keys = [hashlib.md5(f"{kind}\u0001{t}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for kind, t in zip(b.column("kind").to_pylist(), texts, strict=True)]
            made = pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), b.column("side"), pa.array(texts, pa.string()), pa.array(keys, pa.binary())], names=["kind", "id", "side", "text", "k"])
            yield made.filter(pa.array([len(t) >= min_chars for t in texts], pa.bool_()))

    kept = cut(sided.mapInArrow(normalise, "kind string, id string, side string, text string, k binary"))
    texts = kept.groupBy("k").agg(
        F.first("kind").alias("kind"), F.first("text").alias("text"), F.bool_or(F.col("side") == "train").alias("in_train"), F.bool_or(F.col("side") == "eval").alias("in_eval")
    )
    return kept.select("kind", "id", "side", "k").distinct(), cut(texts.withColumn("i", F.monotonically_increasing_id()))


def _segments(h: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index in ``h`` of its first substring) of every run of 2 * size - 1 characters: two substrings one after the other."""
    whole = np.nonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])[0] if len(owner) >= size else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return _mix(h[whole] * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(whole + size - 1, len(h) - 1)]), whole


def _count_at(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def corpus_table(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], op: np.ufunc) -> np.ndarray:
    """One array of 64-bit words for all rows: ``make`` gives that of a task, ``op`` combines them, piece by piece on the executors.

    Its size is fixed, so what reaches the driver doesn't grow with the rows. Without rows it is empty.
    """
    piece = 4096

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = make(batches).reshape(-1, piece)
        at = np.nonzero(words.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([words[i].tobytes() for i in at], pa.binary()), pa.array(np.full(len(at), len(words), np.int32))], names=["at", "words", "of"])

    def merge(t: pa.Table) -> pa.Table:
        words = op.reduce([np.frombuffer(w, np.int64) for w in t.column("words").to_pylist()])
        return pa.table({"at": t.column("at")[:1], "words": pa.array([words.tobytes()], pa.binary()), "of": t.column("of")[:1]})

    schema = "at int, words binary, of int"
    few = 2 * rows.sparkSession.sparkContext.defaultParallelism  # each task gives a whole table
    found = rows.coalesce(few).mapInArrow(task, schema).groupBy("at").applyInArrow(merge, schema).collect()
    out = np.zeros((found[0]["of"] if found else 0, piece), np.int64)
    for r in found:
        out[r["at"]] = np.frombuffer(r["words"], np.int64)
    return out.ravel()


def rarity_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often substrings (row 0) and segments (row 1) of each of 2**COUNT_BITS hash ranges occur, in quarters of powers of two."""
    width = 1 << COUNT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * width, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                h, owner, _ = substring_hashes(b.column("text").slice(at, 2000).to_pylist(), size)
                total[:width] += np.bincount(_count_at(h), minlength=width)
                total[width:] += np.bincount(_count_at(_segments(h, owner, size)[0]), minlength=width)
        return total

    total = corpus_table(texts.select("text"), count, np.add)
    total = (total if len(total) else np.zeros(2 * width, np.int64)).reshape(2, width)
    return np.minimum(np.log2(total + 1.0) * 4, 255).astype(np.uint8)


def _seen(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def _is_set(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _seen(h)
    if not len(words):
        return np.zeros(len(h), bool)
    return (words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes of sets by tenths: 1.1 ** class."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.1) + _EPS).astype(np.int64)


def sizes_met(n: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and most size of the sets that a set of ``n`` reaches ``threshold`` with if its ``rank``-th rarest substring is the first they share."""
    return n * threshold - _EPS, np.minimum(n / threshold, (n - rank) * ((1 + threshold) / threshold) - n) + _EPS


def _of_size(h: np.ndarray, cls: np.ndarray, met: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h + (cls * 2 + met).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def size_marks(h: np.ndarray, n: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """What a key of the evaluation side marks: itself with each size it can meet."""
    low, high = sizes_met(n, rank, threshold)
    first = size_class(np.floor(low))
    times = np.where(high >= low, size_class(high) - first + 1, 0)
    row = np.repeat(np.arange(len(h)), times)
    met = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return _of_size(h[row], met, True)


def size_match(words: np.ndarray, h: np.ndarray, n: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a training key of this size may meet an evaluation key: true for all that do."""
    ok = _is_set(words, _of_size(h, size_class(n), True))
    at = np.nonzero(ok)[0]
    low, high = sizes_met(n[at], rank[at], threshold)
    first, last = size_class(np.floor(low)), size_class(high)
    met = np.zeros(len(at), bool)
    for step in range(int((last - first).max(initial=-1)) + 1):
        met |= (first + step <= last) & (high >= low) & _is_set(words, _of_size(h[at], first + step, False))
    ok[at] = met
    return ok


class Keys:
    """The join keys of a batch of texts: segments (``at`` is their position) and rarest substrings of the set (``at`` is -1).

    Without ``seen`` those of the evaluation side: of the cut the k + 1 rarest segments. With ``seen``, the marks of the
    evaluation side, those of training: all substrings of segment length, as far as one may meet a key of the other side.
    ``share`` (part, parts): only keys whose hash falls to this part.
    """

    def __init__(self, texts: list[str], kinds: list[str], counts: np.ndarray, threshold: float, size: int, seen: np.ndarray | None, share: tuple[int, int] = (0, 1)) -> None:
        h, owner, pos = substring_hashes(texts, size)
        f = counts[0][_count_at(h)]
        seg_h, whole = _segments(h, owner, size)
        seg_f = counts[1][_count_at(seg_h)]
        # texts of different kinds never meet
        kind_h = {x: np.uint64(zlib.crc32(x.encode()) << 20) for x in set(kinds)}
        of_kind = np.fromiter((kind_h[x] for x in kinds), np.uint64, len(kinds))
        h ^= of_kind[owner]
        seg_h ^= of_kind[owner[whole]]
        # one sort key: text, rarity, substring
        order = (owner.astype(np.uint64) << np.uint64(64 - TEXT_BITS)) | (f.astype(np.uint64) << np.uint64(56 - TEXT_BITS)) | (h >> np.uint64(8 + TEXT_BITS))
        order.sort()
        if len(order):
            order = order[np.append(True, order[1:] != order[:-1])]
        so, gram = (order >> np.uint64(64 - TEXT_BITS)).astype(np.int64), order & np.uint64((1 << (56 - TEXT_BITS)) - 1)
        n = np.bincount(so, minlength=len(texts))
        bits = np.bincount(so * PARITY_BITS + (gram & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=len(texts) * PARITY_BITS) & 1
        self.sketch = np.packbits(bits.reshape(len(texts), PARITY_BITS).astype(bool), axis=1).view(np.int64)
        rank = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
        rare = rank <= (n - np.ceil(threshold * n - _EPS))[so]
        with np.errstate(over="ignore"):
            rare_h, rare_o, rank = _mix(gram[rare] ^ _REST), so[rare], rank[rare]
        of_share = lambda x: x % np.uint64(share[1]) == np.uint64(share[0]) if share[1] > 1 else np.ones(len(x), bool)
        mine = of_share(rare_h)
        rare_h, rare_o, rank = rare_h[mine], rare_o[mine], rank[mine]
        seg_o, seg_p = owner[whole], pos[whole]
        if seen is None:
            lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
            width = 2 * size - 1
            slots = lengths // width
            before = np.cumsum(slots) - slots
            slot_o = np.repeat(np.arange(len(texts)), slots)
            start = (np.arange(slots.sum()) - before[slot_o]) * lengths[slot_o] // np.maximum(slots[slot_o], 1)
            runs = np.maximum(lengths - width + 1, 0)
            cut_at = (np.cumsum(runs) - runs)[slot_o] + start
            o = np.lexsort((start, seg_f[cut_at], slot_o))
            chosen = cut_at[o[np.arange(len(o)) - before[slot_o] <= allowed_breaks(n, threshold, size)[slot_o]]]
            mine = of_share(seg_h[chosen])
            seg_h, seg_o, seg_p = seg_h[chosen][mine], seg_o[chosen][mine], seg_p[chosen][mine]
        else:
            keep = np.nonzero(of_share(seg_h))[0]
            keep = keep[_is_set(seen, seg_h[keep])]
            keep = keep[_is_set(seen, _of_size(seg_h[keep], size_class(n)[seg_o[keep]], True))]
            seg_h, seg_o, seg_p = seg_h[keep], seg_o[keep], seg_p[keep]
            keep = size_match(seen, rare_h, n[rare_o], rank, threshold)
            rare_h, rare_o, rank = rare_h[keep], rare_o[keep], rank[keep]
        self.h, self.owner = np.concatenate([seg_h, rare_h]), np.concatenate([seg_o, rare_o])
        self.at = np.concatenate([seg_p, np.full(len(rare_h), -1)]).astype(np.int32)
        self.rank, self.n = np.concatenate([np.zeros(len(seg_h), np.int64), rank]), n

    def marks(self, threshold: float) -> np.ndarray:
        """Segments mark themselves and, with each size they can meet, again; rarest substrings the latter and their own size."""
        n, rest = self.n[self.owner], self.at < 0
        return np.concatenate([size_marks(self.h, n, self.rank, threshold), self.h[~rest], _of_size(self.h[rest], size_class(n[rest]), False)])


def _pairs_of_share(texts: DataFrame, counts, threshold: float, size: int, share: tuple[int, int]) -> DataFrame:  # noqa: ANN001
    """(i_eval, i_train, by_segment) of the texts that meet in a key of a share and pass the bounds. ``counts``: broadcast."""
    spark = texts.sparkSession

    def each(batches: Iterator[pa.RecordBatch], seen) -> Iterator[tuple[pa.RecordBatch, Keys]]:  # noqa: ANN001
        for b in batches:
            for at in range(0, b.num_rows, 1 << TEXT_BITS):
                part = b.slice(at, 1 << TEXT_BITS)
                yield part, Keys(part.column("text").to_pylist(), part.column("kind").to_pylist(), counts.value, threshold, size, seen and seen.value, share)

    def marks(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """2**SEEN_BITS bits, packed: one is set for the hash range of each mark."""
        bits = np.zeros(1 << SEEN_BITS, bool)
        for _, keys in each(batches, None):
            bits[_seen(keys.marks(threshold))] = True
        return np.packbits(bits, bitorder="little").view(np.int64)

    def rows(seen) -> object:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in each(batches, seen):
                cols = [pa.array(x.h.view(np.int64)), pa.array(x.at), pa.array(x.n[x.owner].astype(np.int32)), part.column("i").take(pa.array(x.owner))]
                cols += [pa.array(np.ascontiguousarray(x.sketch[x.owner, i])) for i in range(len(_SKETCH))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "at", "n", "i", *_SKETCH])

        return run

    schema = "h long, at int, n int, i long, " + ", ".join(f"{x} long" for x in _SKETCH)
    asked = texts.where("in_eval").select("i", "kind", "text")
    seen = spark.sparkContext.broadcast(corpus_table(asked, marks, np.bitwise_or))
    e = asked.mapInArrow(rows(None), schema)
    t = texts.where("in_train").select("i", "kind", "text").mapInArrow(rows(seen), schema)
    e, t = (d.select("h", *[F.col(c).alias(f"{x}_{c}") for c in d.columns if c != "h"]) for d, x in ((e, "e"), (t, "t")))
    close = F.least("e_n", "t_n") >= F.greatest("e_n", "t_n") * threshold - _EPS
    apart = sum((F.bit_count(F.col(f"e_{x}").bitwiseXOR(F.col(f"t_{x}"))) for x in _SKETCH[1:]), F.bit_count(F.col(f"e_{_SKETCH[0]}").bitwiseXOR(F.col(f"t_{_SKETCH[0]}"))))
    alike = apart <= (F.col("e_n") + F.col("t_n")) * ((1 - threshold) / (1 + threshold)) + _EPS
    shift = F.col("t_at") - F.col("e_at")
    allowed = (shift >= -(F.col("e_n") * (1 - threshold)) - _EPS) & (shift <= F.col("e_n") * (1 / threshold - 1) + _EPS)
    by_set = (F.col("e_at") < 0) & (F.col("t_at") < 0)
    by_segment = (F.col("e_at") >= 0) & (F.col("t_at") >= 0) & allowed
    met = e.join(t, "h").where(close & (by_set | by_segment) & (F.col("e_i") != F.col("t_i")) & alike)
    return met.groupBy(F.col("e_i").alias("i_eval"), F.col("t_i").alias("i_train")).agg(F.bool_or(F.col("e_at") >= 0).alias("by_segment"))


def segment_join(texts: DataFrame, threshold: float = 0.75, size: int = 5) -> DataFrame:
    """(k_eval, k_train, path, jaccard, edits) of all pairs of different texts, one in train and one in val or test, from ``threshold`` on.

    ``path``: 'edits' (found by the segment join, the banded distance is within a quarter of the longer text), 'segments'
    (found by it, but further apart), 'sets' (found by the exact path alone). ``edits`` is the distance where it is within
    that band, else null. A key that very many texts have is one skewed join key, which adaptive execution splits. Large
    corpora are joined in passes, each over a share of the keys, so that the rows of all keys never lie on disk at once.
    """
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(rarity_counts(texts, size))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, round(math.sqrt(chars / PASS_CHARS)))
    passes = []
    for part in range(parts):
        with hash_joins(spark):
            passes.append(cut(_pairs_of_share(texts, counts, threshold, size, (part, parts))))
        drop_shuffles(spark)
    pairs = passes[0]
    if parts > 1:
        pairs = cut(reduce(DataFrame.unionByName, passes).groupBy("i_eval", "i_train").agg(F.bool_or("by_segment").alias("by_segment")))
        release(*passes)
    both = pairs.join(texts.select(F.col("i").alias("i_eval"), F.col("k").alias("k_eval"), F.col("text").alias("te")), "i_eval")
    both = both.join(texts.select(F.col("i").alias("i_train"), F.col("k").alias("k_train"), F.col("text").alias("tt")), "i_train")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            similar = []
            for a, b in zip(f["te"], f["tt"], strict=True):
                x, y = ({s[i : i + size] for i in range(len(s) - size + 1)} for s in (a, b))
                common = len(x & y)
                similar.append(common / max(1, len(x) + len(y) - common))
            f["jaccard"] = similar
            f = f[f["jaccard"] >= threshold - _EPS]
            ab = list(zip(f["te"], f["tt"], strict=True))
            edits = banded_distances(ab, [max(8, max(len(a), len(b)) // 4) for a, b in ab])
            path = [("sets" if not s else "edits" if d is not None else "segments") for s, d in zip(f["by_segment"], edits, strict=True)]
            yield pd.DataFrame({"k_eval": f["k_eval"], "k_train": f["k_train"], "path": path, "jaccard": f["jaccard"], "edits": pd.array(edits, dtype="Int32")})

    found = cut(both.drop("i_eval", "i_train").mapInPandas(verify, "k_eval binary, k_train binary, path string, jaccard double, edits int"))
    release(pairs)
    return found


def cross_split_pairs(rows: DataFrame, threshold: float = 0.75, size: int = 5, min_chars: int = 40) -> DataFrame:
    """(kind, eval_id, train_id, path, jaccard, edits): of rows (kind, id, text, split) all pairs of different ids of one kind, one in
    train and one in val or test, with equal or close texts.

    Null texts and ids, texts under ``min_chars`` normal characters and rows without a split are no cases; repeated rows
    count once. The ``path`` of equal texts is 'equal'.
    """
    members, texts = text_classes(rows, min_chars)
    close = segment_join(texts, threshold, size)
    equal = (F.lit("equal").alias("path"), F.lit(1.0).alias("jaccard"), F.lit(0).alias("edits"))
    same = texts.where("in_train AND in_eval").select(F.col("k").alias("k_eval"), F.col("k").alias("k_train"), *equal)
    e = members.where("side = 'eval'").select(F.col("k").alias("k_eval"), "kind", F.col("id").alias("eval_id"))
    t = members.where("side = 'train'").select(F.col("k").alias("k_train"), F.col("id").alias("train_id"))
    return close.unionByName(same).join(e, "k_eval").join(t, "k_train").where("eval_id != train_id").select("kind", "eval_id", "train_id", "path", "jaccard", "edits")


def cross_split_names(rows: DataFrame) -> DataFrame:
    """(kind, eval_id, train_id, path): of rows (kind, id, text, split) the pairs of different ids whose names are equal in lower case without all but letters and digits."""
    split = F.trim(F.col("split"))
    key = F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]", "")
    kept = rows.select("kind", clean_key("id").alias("id"), key.alias("name"), F.when(split == "train", "train").when(split.isin("val", "test"), "eval").alias("side"))
    kept = kept.where("id IS NOT NULL AND name != '' AND side IS NOT NULL").distinct()
    e = kept.where("side = 'eval'").select("kind", "name", F.col("id").alias("eval_id"))
    t = kept.where("side = 'train'").select("kind", "name", F.col("id").alias("train_id"))
    return e.join(t, ["kind", "name"]).where("eval_id != train_id").select("kind", "eval_id", "train_id").distinct().withColumn("path", F.lit("equal"))


def pair_paths(pairs: DataFrame) -> DataFrame:
    """(table_name, path, n_pairs): how many pairs of different ids each path found; a pair found by several counts at the first of them."""
    order = F.when(F.col("path") == "equal", 0).when(F.col("path") == "edits", 1).when(F.col("path") == "segments", 2).otherwise(3)
    best = pairs.groupBy(F.col("kind").alias("table_name"), F.least("eval_id", "train_id").alias("a"), F.greatest("eval_id", "train_id").alias("b")).agg(F.min_by("path", order).alias("path"))
    return best.groupBy("table_name", "path").agg(F.count(F.lit(1)).alias("n_pairs"))


def found_pairs(pairs: DataFrame) -> DataFrame:
    """(table_name, id_a, id_b), id_a < id_b."""
    return pairs.select(F.col("kind").alias("table_name"), F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()
