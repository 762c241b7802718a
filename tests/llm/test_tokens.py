import os
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from lemmary.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="vocabulary files are absent")
SCHEMA = "doc_id long, text string, ids string, lang string"
CASES = [
    "", "don't", "'s'S 'sa  b\n\n c \n", "x'll've're're", "!'s  's", "a  b", "\t\t ?", "it's 5'd ''d", "   ", "\n", "a  ", "👍🏽 é½ h₁ x", "'", "' s", "　a 　b", "<|endoftext|> hi", "123abc 12 ab", "a\u0085b", "\x1c a", "áe", " " * 50 + "x", "e" * 3000, "a\n", "\n\na",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.RANKS), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def encode(texts):
    ids, per, off = tokens.encoder(tokens.read_vocabulary()).encode_batch(texts)
    out, at = [], 0
    for n in per:
        out.append((ids[at : at + n].tolist(), off[at : at + n].tolist()))
        at += n
    return out


def test_cases(reference):
    r = random.Random(1)
    more = ["".join(r.choice("a's tdmrelv \n\t1!é '") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    for text, (ids, _) in zip(CASES + more, encode(CASES + more), strict=True):
        assert ids == reference(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    [(ids, off)] = encode([text])
    assert tokens.encoder(tokens.read_vocabulary()).decode(ids) == text
    assert off == sorted(off) and (not off or off[0] == 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab 's\nll1é!", max_size=40), max_size=8), st.integers(1, 9))
def test_blocks_dont_matter(texts, block):
    import numpy as np

    codes = np.frombuffer("".join(t + "\U0010ffff" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == 0x10FFFF, 0x110000, codes)
    if len(codes):
        assert (tokens.piece_starts(codes, block) == tokens.piece_starts(codes, 1024)).all()


def test_dataframe(spark, reference):
    data = [(i, t, "x", None) for i, t in enumerate(CASES)] + [(98, None, "x", None), (1, CASES[1], "x", None), (99, "word " * 60_000, "x", None), (None, "a", "x", None)]
    got = tokens.encode(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "ids"] and dict(got.dtypes)["ids"] == "array<int>"
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted(((i, reference(t or "")) for i, t, *_ in data), key=repr)
    counts = {(r[0], r[1]) for r in tokens.token_counts(spark.createDataFrame(data, SCHEMA)).collect()}
    assert counts == {(i, len(reference(t or ""))) for i, t, *_ in data}
    off = {r["doc_id"]: r for r in tokens.encode(spark.createDataFrame(data, SCHEMA), offsets=True).collect()}
    assert len(off[1]["offsets"]) == len(off[1]["ids"]) and off[1]["offsets"][0] == 0
    assert rows(tokens.encode(spark.createDataFrame([], SCHEMA))) == []
