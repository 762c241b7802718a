"""Problem 7: encoding with a public byte-level BPE vocabulary.

Boundaries come from codepoint-class arrays and a scan of transition functions, without regular expressions: each
character maps the states of a small automaton to states, the functions of a block are composed for all blocks at once,
the block results are chained, and a second pass gives every character its state and whether a piece starts there. The
slices are encoded by pair merging with a cache; their offsets are kept, so ids can be decoded and located again.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Default vocabulary; a parameter of every operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# character classes
_L, _N, _O, _SPACE, _WS, _EOT = range(6)
# classes as the automaton sees them, with what follows taken into account
L, N, O, LEAD, WS_START, WS_MORE, SHORT, LONG = range(8)  # noqa: E741
# states: in letters, in digits, in other, after a leading space, between pieces, one or two letters of a contraction to come
IN_L, IN_N, IN_O, AFTER_LEAD, FREE, ONE, TWO = range(7)
_STATES = 7


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and piece start by (class, state)."""
    to, start = np.zeros((8, _STATES), np.uint8), np.ones((8, _STATES), bool)
    for cls, inside in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[cls] = inside
        start[cls, [inside, AFTER_LEAD]] = False
    to[L, TWO], to[L, ONE] = ONE, FREE
    start[L, [ONE, TWO]] = False
    to[LEAD], to[WS_START], to[WS_MORE] = AFTER_LEAD, FREE, FREE
    start[WS_MORE] = False
    for cls, open_ in ((SHORT, ONE), (LONG, TWO)):
        to[cls] = open_
        to[cls, [IN_O, AFTER_LEAD]] = IN_O
        start[cls, [IN_O, AFTER_LEAD]] = False
    return to, start


_TO, _START = _automaton()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode general categories and the White_Space property."""
    letters = {"Lu": _L, "Ll": _L, "Lt": _L, "Lm": _L, "Lo": _L, "Nd": _N, "Nl": _N, "No": _N, "Zs": _WS, "Zl": _WS, "Zp": _WS}
    category = unicodedata.category
    table = np.fromiter((letters.get(category(chr(c)), _O) for c in range(0x110000)), np.uint8, 0x110000)
    table[[0x9, 0xA, 0xB, 0xC, 0xD, 0x85]] = _WS
    table[0x20] = _SPACE
    return np.append(table, _EOT).astype(np.uint8)


def seen_classes(codes: np.ndarray) -> np.ndarray:
    """The automaton's class of each character; code 0x110000 separates texts."""
    c = class_table()[codes]
    after = np.append(c[1:], _EOT)
    space = (c == _SPACE) | (c == _WS)
    after_space, ends = (after == _SPACE) | (after == _WS), after == _EOT
    out = np.take(np.array([L, N, O, WS_MORE, WS_MORE, WS_START], np.uint8), c)
    before_space = np.append(False, space[:-1])
    out[space & (~before_space | (~after_space & ~ends))] = WS_START
    out[(c == _SPACE) & ~after_space & ~ends] = LEAD
    quote = np.nonzero(codes == 0x27)[0]
    if len(quote):
        padded = np.append(codes, [0x110000, 0x110000])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quote[short]], out[quote[long]] = SHORT, LONG
    return out


def piece_starts(codes: np.ndarray, block: int = 128) -> np.ndarray:
    """Whether a piece starts at each character, by a blocked scan over the characters' transition functions."""
    cls = seen_classes(codes)
    n = len(cls)
    blocks = -(-n // block)
    grid = np.full(blocks * block, WS_START, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    flat = _TO.ravel()
    f = np.broadcast_to(np.arange(_STATES, dtype=np.uint8), (blocks, _STATES))
    for row in grid:  # composition within all blocks at once
        f = flat[row[:, None].astype(np.int16) * _STATES + f]
    first = np.empty(blocks, np.uint8)
    state = FREE
    for b, g in enumerate(f.tolist()):  # chaining of the blocks
        first[b] = state
        state = g[state]
    starts = np.empty((block, blocks), bool)
    now, flat_start = first, _START.ravel()
    for r, row in enumerate(grid):
        at = row.astype(np.int16) * _STATES + now
        starts[r] = flat_start[at]
        now = flat[at]
    return starts.T.reshape(-1)[:n]


class Encoder:
    """Pair merging by rank, cached per piece; the cache is emptied when it holds ``cache_size`` pieces."""

    def __init__(self, vocabulary: bytes, cache_size: int = 300_000) -> None:
        """``vocabulary``: the content of a file with one base64 token and its rank per line."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}
        self.cache_size = cache_size

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self._merge(raw)

    def _merge(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left; a heap keeps long pieces near-linear."""
        ranks, n = self.ranks, len(raw)
        parts, after, before = [raw[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b or not a:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [ranks[p] for p in parts if p]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, character offset in its text of each id's piece) of the texts, one after the other."""
        joined = "".join(texts)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        text_at = np.cumsum(lengths) - lengths
        separated = np.insert(codes, np.cumsum(lengths), 0x110000)
        keep = separated != 0x110000
        at = np.nonzero(piece_starts(separated)[keep])[0]
        bounds = np.append(at, len(codes)).tolist()
        cache, out, sizes = self.cache, [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            p = joined[a:b]
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= self.cache_size:
                    cache.clear()
                ids = self.piece(p)
                if b - a <= 64:
                    cache[p] = ids
            out += ids
            sizes.append(len(ids))
        piece_sizes = np.array(sizes, np.int64)
        owner = np.searchsorted(text_at, at, side="right") - 1
        # texts of length 0 share their start with the next one: searchsorted gives the last, which is the one with characters
        per_text = np.bincount(owner, weights=piece_sizes, minlength=len(texts)).astype(np.int64)
        return np.array(out, np.int32), per_text, np.repeat(at - text_at[owner], piece_sizes)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def read_vocabulary(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shipped(docs: DataFrame, ranks_path: str) -> Broadcast:
    """The vocabulary (about a megabyte) read by the driver, so that executors need no file of their own."""
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks_path))


def _chunks(batch: pa.RecordBatch, max_chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``max_chars`` characters each, with their texts ('' for null)."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, offsets: bool = False) -> DataFrame:
    """(doc_id, ids[, offsets]) of every row: token ids without special tokens, whose literal strings are ordinary text.

    Null and empty texts give empty arrays; rows aren't merged, repeated ones come out as often. ``offsets`` adds the
    character position of the piece each id belongs to. A narrow operation: no shuffle.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type, vocabulary = rows.schema["doc_id"].dataType.simpleString(), _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            for part, texts in _chunks(batch):
                ids, sizes, at = enc.encode_batch(texts)
                edges = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                cols = [part.column("doc_id"), pa.ListArray.from_arrays(edges, pa.array(ids))]
                names = ["doc_id", "ids"]
                if offsets:
                    cols, names = [*cols, pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int32)))], [*names, "offsets"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>" + ", offsets array<int>" * offsets)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens): sizes of all texts; the ids stay in the Python workers."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type, vocabulary = rows.schema["doc_id"].dataType.simpleString(), _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            for part, texts in _chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(enc.encode_batch(texts)[1])], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long")
