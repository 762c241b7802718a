"""Problem 9: texts cut off by a field limit or in transfer.

One pass over the corpus builds three tables of counts, summed per task before the shuffle: how often each word occurs
(the vocabulary, whose proper prefixes form a trie kept as a table of nodes), how often each sequence of three tokens is
followed by more of its line or ends it, and how many different texts each source has of each length in characters and
bytes. A text is cut if, with the reason given for it,
- 'limit': its length is one at which its source piles up (a field limit), or
- 'fence', 'character', 'omission': a code block stays open, or it ends in half a character, or in a mark of omission after
  a usual end or nothing, or
- 'word': its last token is an unknown proper prefix of known words, or
- 'continuation': what it ends with is, in the corpus, followed by more rather than an end.
The first and the fifth are the method's own evidence, the others extend it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.llm.joins import hash_joins
from lemmary.operators.cut import cut

FENCE = "```"
_TOKEN = re.compile(r"[^\W_](?:[\w./'’-]*[\w'’])?|[^\w\s]|_")
_OMITTED = re.compile(r"(?:\.\.\.|…|\[\s*(?:…|\.\.\.|[^\W\d_]{1,12})\s*\])$")
_END = ".?!。！？؟।∎"
_CLOSE = "\"'”’»)]*_"
_IDENT = re.compile(r"[._/\d]|[^\W\d_][^\W\d_]*[a-zà-ÿ][A-ZÀ-Þ]")


def shape(token: str) -> str:
    """The token as it is counted: numbers as 0, names with inner marks, digits or capitals as X."""
    if token.isdigit():
        return "0"
    if len(token) > 1 and _IDENT.search(token):
        return "0" if token[0].isdigit() and not any(c.isalpha() for c in token) else "X"
    return token


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its beginning and its last part."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


_START = _word_hashes(["^"])[0]
#: The context of a first token.
_LONE = int(_chain(np.array([_START]), np.array([_START])).view(np.int64)[0])


def stripped(text: str) -> str:
    """The text without white space, half characters and marks without width after its end."""
    return text.rstrip().rstrip("\ufffd\u200b\ufeff\x00").rstrip()


def prose_lines(text: str) -> list[str]:
    """The lines outside code blocks."""
    if FENCE not in text:
        return text.splitlines()
    out = []
    for i, part in enumerate(text.split(FENCE)):
        if i % 2 == 0:
            out += part.splitlines()
    return out


def _bare(line: str) -> str:
    """The line without white space and a mark of omission at its end."""
    line = line.rstrip()
    return _OMITTED.sub("", line) if line[-1:] in (".", "…", "]") else line


def ending(text: str) -> tuple[str, list[str]]:
    """The state of a text's end and, if it is to be asked about, the last three token shapes and the last token.

    States: 'fence', 'character' and 'omission' (cut, for that reason), 'done', 'ask', with ' long' after more than 8 tokens
    of a line.
    """
    t = stripped(text)
    if t.count(FENCE) % 2:
        return "fence", []
    if not t or t.endswith(FENCE):
        return "done", []
    if "\ufffd" in text[len(t) :]:
        return "character", []
    short = _OMITTED.sub("", t).rstrip()
    if short != t and (not short or short.endswith(FENCE) or short.rstrip(_CLOSE)[-1:] in _END):
        return "omission", []
    t = short
    tokens = _TOKEN.findall(t.rsplit("\n", 1)[-1])
    shapes = ["^", "^", *map(shape, tokens[-3:])][-3:]
    last = tokens[-1] if tokens else ""
    bare = t.rstrip(_CLOSE)
    if bare[-1:] and bare[-1] in _END and not (bare[-1] == "." and t == bare):
        return "done", []
    return "ask" + (" long" if len(tokens) > 8 else ""), [*shapes, last]


#: Stands between the lines of a batch; no character of a text.
_BREAK = "\ufdd0"


def _coded(parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, the number of each token of the parts in order, its part)."""
    tokens = _TOKEN.findall(f"\n{_BREAK}\n".join(p.replace(_BREAK, " ") if _BREAK in p else p for p in parts))
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    code = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    stop = code == number.get(_BREAK, -1)
    return list(number), code[~stop], np.cumsum(stop)[~stop]


def _opens(token: str) -> bool:
    """Whether a sentence may begin with the token."""
    return token[0].isupper() or token[0].isdigit() or token[0] in "¿¡`\"(«“|-*•#—>‹"


def batch_counts(texts: list[str]) -> tuple[list[str], np.ndarray, list[str], list[np.ndarray]]:
    """The counts of a batch of texts.

    (words, texts of each; the last tokens of the sequences of three, [hash, context, ends, goes on] of these, then [context,
    ends, goes on] of the first two). After a full stop only what can't begin a sentence counts as going on.
    """
    lines, owner, codes_, code_owner = [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for line in prose_lines(stripped(text)):
            bare = _bare(line)
            if bare:
                lines.append(bare)
                owner.append(i)
        if FENCE in text:
            codes_.append("\n".join(text.split(FENCE)[1::2]))
            code_owner.append(i)
    tokens, code, line = _coded(lines)
    other, other_code, part = _coded(codes_)
    known = {t: i for i, t in enumerate(tokens)}
    place = np.fromiter((known.setdefault(t, len(known)) for t in other), np.int64, len(other))
    words = list(known)
    text_of = np.concatenate([np.array(owner, np.int64)[line], np.array(code_owner, np.int64)[part]])
    pairs = np.unique((text_of << 32) | np.concatenate([code, place[other_code] if len(other) else other_code]))
    n_texts = np.bincount(pairs & 0xFFFFFFFF, minlength=len(words))
    if not len(code):
        none = np.zeros(0, np.int64)
        return words, n_texts, [], [none] * 7
    shapes = [shape(t) for t in tokens]
    hashes = _word_hashes(shapes)[code]
    opens = np.fromiter(map(_opens, tokens), bool, len(tokens))[code]
    stops = np.fromiter((x == "." for x in shapes), bool, len(shapes))[code]
    before = lambda k: np.where(np.append(np.full(min(k, len(line)), False), line[k:] == line[:-k]), np.append(np.full(min(k, len(line)), _START), hashes[:-k]), _START) if len(line) > k else np.full(len(line), _START)
    ctx = _chain(before(2), before(1))
    tri = _chain(ctx, hashes)
    last = np.append(line[1:] != line[:-1], True)
    goes = ~last & ~(stops & np.append(opens[1:], False))

    def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return found, first, np.bincount(which, last, len(found)).astype(np.int64), np.bincount(which, goes, len(found)).astype(np.int64)

    three, first, ends, more = summed(tri)
    two, _, ends2, more2 = summed(ctx)
    return words, n_texts, [shapes[c] for c in code[first].tolist()], [three.view(np.int64), ctx[first].view(np.int64), ends, more, two.view(np.int64), ends2, more2]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, h, a, b, word, ctx): 'w' words (a: texts), 'g' and 'h' token sequences (a: at the end of a line, b: before more of it).

    'g' counts three tokens (the last is ``word``, the others hash to ``ctx``), 'h' the first two of three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                words, n, lasts, (g, ctx, ends, more, h, ends2, more2) = batch_counts(whole.column("text").slice(at, 4000).to_pylist())
                zero = np.zeros(len(words), np.int64)
                kinds = pa.DictionaryArray.from_arrays(pa.array(np.repeat([0, 1, 2], [len(words), len(g), len(h)]).astype(np.int8)), pa.array(["w", "g", "h"])).cast(pa.string())
                columns = [
                    kinds, pa.array(np.concatenate([zero, g, h])), pa.array(np.concatenate([n, ends, ends2])), pa.array(np.concatenate([zero, more, more2])),
                    pa.array([*words, *lasts, *[None] * len(h)], pa.string()),
                    pa.array(np.concatenate([zero, ctx, np.zeros(len(h), np.int64)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "h", "a", "b", "word", "ctx"])

    counted = docs.select("text").mapInArrow(run, "kind string, h long, a long, b long, word string, ctx long")
    return counted.groupBy("kind", "h", "word", "ctx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _source_key() -> Column:
    """The source as a key; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def length_limits(docs: DataFrame, min_texts: int = 8, times: float = 8.0) -> DataFrame:
    """(source, unit, length): lengths (``source`` as a key) at which a source has at least ``min_texts`` different texts and ``times`` as many as usual nearby.

    ``unit`` is 'chars' or, over the texts with characters of several bytes, 'bytes'. Usual is the larger of two means: of
    the four lengths on either side, and of the lengths within a tenth of this one; a field limit stands alone, common
    lengths of short texts don't. In practice the result has a few rows per source.
    """
    sized = docs.select(_source_key().alias("source"), F.xxhash64("text").alias("t"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).where("chars > 0")
    unit = lambda u: F.struct(F.lit(u).alias("unit"), F.col(u).alias("length"))
    units = F.when(F.col("chars") < F.col("bytes"), F.array(unit("chars"), unit("bytes"))).otherwise(F.array(unit("chars")))
    # repeated texts count once
    sized = sized.distinct().select("source", F.explode(units).alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(sized)
    # first what stands out among its direct neighbours, a narrow frame per source; only those few are compared with the wider range
    by = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-4, 4)
    peaks = counts.withColumn("beside", F.sum("n").over(by) - F.col("n")).where((F.col("n") >= min_texts) & (F.col("n") >= F.lit(times) * (F.col("beside") / 8 + 1)))
    peaks = peaks.withColumn("width", F.greatest(F.lit(20), (F.col("length") / 10).cast("int")))
    near = counts.select(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("length").alias("l"), F.col("n").alias("m"))
    away = F.abs(F.col("l") - F.col("length"))
    around = peaks.join(near, (F.col("source") == F.col("s")) & (F.col("unit") == F.col("u")) & (away <= F.col("width")) & (away > 4), "left")
    usual = F.coalesce(F.sum("m"), F.lit(0)) / (2 * F.first("width") - 8)
    found = around.groupBy("source", "unit", "length").agg(F.first("n").alias("n"), usual.alias("usual"))
    return found.where(F.col("n") >= F.lit(times) * (F.col("usual") + 1)).select("source", "unit", "length")


def truncated(docs: DataFrame, known: int = 2) -> DataFrame:
    """(doc_id, source, is_cut, reason) of every row whose text isn't null, empty or blank; ``reason`` is null for whole texts.

    Rows are judged each by itself, repeated ones alike. A null source is a source of its own. ``known``: texts that must
    hold a word for it to be known.
    """
    rows = docs.select("doc_id", "source", "text").where(F.col("text").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
    counts = cut(corpus_counts(rows))
    limits = cut(length_limits(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [ending(t) for t in texts]
            none = np.array([not t[1] for t in found], bool)
            tails = [t[1] or ["", "", "", ""] for t in found]
            one, two, three = (_word_hashes([t[i] for t in tails]) for i in range(3))
            ctx = _chain(one, two)
            cols = [
                b.column("doc_id"),
                b.column("source"),
                pa.array([f[0] for f in found]),
                pa.array(_chain(ctx, three).view(np.int64), mask=none),
                pa.array(ctx.view(np.int64), mask=none),
                pa.array([t[3] or None for t in tails], pa.string()),
                pa.array([len(t) for t in texts], pa.int32()),
                pa.array([len(t.encode()) for t in texts], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "state", "g", "h", "last", "chars", "bytes"])

    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    marked = cut(rows.mapInArrow(run, f"doc_id {id_type}, source {source_type}, state string, g long, h long, last string, chars int, bytes int"))
    at = lambda unit: limits.where(F.col("unit") == unit).select(F.col("source").alias("key"), F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}"))
    flagged = marked.withColumn("key", _source_key()).join(at("chars"), ["key", "chars"], "left").join(at("bytes"), ["key", "bytes"], "left")
    flagged = flagged.withColumn("limited", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))
    ask = F.col("state").startswith("ask")
    sure = flagged.where(~ask | F.col("limited")).select("doc_id", "source", F.when(F.col("limited"), "limit").when(F.col("state") != "done", F.col("state")).alias("reason"))
    asked = flagged.where(ask & ~F.col("limited"))
    # the same endings are asked about once, however many texts have them
    tails = cut(asked.select("g", "h", "last", (F.col("h") == F.lit(_LONE)).alias("lone"), F.col("state").endswith("long").alias("long")).distinct())
    g = counts.where("kind = 'g'").select(F.col("h").alias("g"), F.col("a").alias("g_end"), F.col("b").alias("g_more"))
    h = counts.where("kind = 'h'").select("h", F.col("a").alias("h_end"), F.col("b").alias("h_more"))
    words = counts.where("kind = 'w'").select("word", F.col("a").alias("w_n"))
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, F.lit(1), i)))
    nodes = (
        words.where((F.col("w_n") >= known) & (F.length("word") > 1))
        .select(prefixes("word").alias("last"), "w_n")
        .join(tails.select("last").distinct(), "last", "left_semi")
        .groupBy("last")
        .agg(F.sum("w_n").alias("below"))
    )
    # of the words that follow the two tokens before, those that the last one is a proper prefix of
    asked_tails = tails.where(~F.col("lone")).select("h", "last").distinct()
    follow = counts.where("kind = 'g' AND b > 0 AND length(word) > 1").select(F.col("ctx").alias("h"), F.col("word").alias("next"), F.col("b").alias("next_n"))
    follow = follow.join(asked_tails.select("h").distinct(), "h", "left_semi")
    grown = follow.select("h", prefixes("next").alias("last"), "next_n").join(asked_tails, ["h", "last"], "left_semi").groupBy("h", "last").agg(F.sum("next_n").alias("grown"))
    judged = tails.join(g, "g", "left").join(h, "h", "left").join(words, F.col("last") == F.col("word"), "left").join(nodes, "last", "left").join(grown, ["h", "last"], "left")
    ends, more, h_ends, h_more, seen, below, longer = (F.coalesce(c, F.lit(0)) for c in ("g_end", "g_more", "h_end", "h_more", "w_n", "below", "grown"))
    # what is never continued and ends several texts is an end; what is seen only here is judged by the tokens before it
    rare = F.when(F.col("lone"), False).when(F.col("long"), True).otherwise(h_more > h_ends)
    goes_on = F.when(more > 0, more >= ends).when(longer > ends, True).when(ends >= 3, False).otherwise(rare)
    half_word = (F.col("last") != ".") & (below >= known) & (seen < F.greatest(F.lit(float(known)), 0.001 * below))
    verdict = F.when(half_word, "word").when(F.when(F.col("last") == ".", more > ends).otherwise(goes_on), "continuation")
    with hash_joins(docs.sparkSession):
        judged = cut(judged.select(F.col("g").alias("j_g"), F.col("h").alias("j_h"), F.col("last").alias("j_last"), F.col("long").alias("j_long"), verdict.alias("reason")))
    same = F.col("g").eqNullSafe(F.col("j_g")) & F.col("h").eqNullSafe(F.col("j_h")) & F.col("last").eqNullSafe(F.col("j_last")) & (F.col("state").endswith("long") == F.col("j_long"))
    answered = asked.join(judged, same, "left").select("doc_id", "source", "reason")
    return sure.unionByName(answered).select("doc_id", "source", F.col("reason").isNotNull().alias("is_cut"), "reason")


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share) over the rows of :func:`truncated`; a null source is one."""
    per = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("is_cut").cast("long")).alias("n_cut"))
    return per.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def truncation_reasons(judged: DataFrame) -> DataFrame:
    """(reason, n_cut) over the cut rows of :func:`truncated`."""
    return judged.where("is_cut").groupBy("reason").agg(F.count(F.lit(1)).alias("n_cut"))
