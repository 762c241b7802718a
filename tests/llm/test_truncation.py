import random

from conftest import rows
from lemmary.llm import truncation

SCHEMA = "doc_id long, text string, source string, chars int, h long"
WORDS = "lattice kernel chain witness hypothesis induction inequality profile closure bounded regular partial".split()


def sentence(r):
    return f"The {r.choice(WORDS)} of every {r.choice(WORDS)} follows from a {r.choice(WORDS)} of the {r.choice(WORDS)}, e.g., by {r.choice(WORDS)} steps."


def corpus(seed, n=600):
    r = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        t = " ".join(sentence(r) for _ in range(r.randrange(2, 7)))
        kind = r.randrange(10)
        source = r.choice(["a", "b", None])
        if kind == 0:
            at = r.randrange(len(t) // 2, len(t) - 3)
            while t[at - 1] in ". ":
                at += 1
            t = t[:at] + r.choice(["", "\n", " \r\n"])
            cut.add(i)
        elif kind == 1:
            t += "\n\n" + r.choice(["Best wishes", "Thanks in advance", "QED", f"See also: Foo.{r.choice(WORDS)}"])
        elif kind == 2:
            t += "\n\n```\ntheorem Foo.bar := by\n  simp\n```"
        elif kind == 3 and len(t) > 300:
            t, source = t[:300], "limited"
            cut.add(i)
        docs.append((i, t, source, 1, 1))
    return docs, cut


def test_found(spark):
    docs, cut = corpus(1)
    extra = [(900, None, "a", 1, 1), (901, "", "a", 1, 1), (902, " \n\t", "a", 1, 1), (903, "Intro.\n\n```\ntheorem x := by\n  simp", "a", 1, 1), (904, "It ends in half of a letter �", "a", 1, 1), (905, docs[3][1], None, 1, 1), (906, "word " * 50_000 + "end.", "a", 1, 1)]
    if 3 in cut:
        cut.add(905)
    cut |= {903, 904}
    judged = {r["doc_id"]: r["is_cut"] for r in truncation.truncated(spark.createDataFrame(docs + extra, SCHEMA)).collect()}
    assert not {900, 901, 902} & set(judged)
    got = {i for i, x in judged.items() if x}
    assert len(got & cut) / len(cut) > 0.95 and len(got & cut) / len(got) > 0.95, (sorted(got - cut), sorted(cut - got))


def test_report_and_empty(spark):
    docs = [(1, "Done.", "a", 1, 1), (2, "Open ```\ncode", "a", 1, 1), (2, "Open ```\ncode", "a", 1, 1), (3, "Done!", None, 1, 1)]
    got = rows(truncation.truncation_by_source(truncation.truncated(spark.createDataFrame(docs, SCHEMA))))
    assert got == sorted([("a", 3, 2, 0.666667), (None, 1, 0, 0.0)], key=repr)
    assert rows(truncation.truncated(spark.createDataFrame([], SCHEMA))) == []


def test_length_limits_stand_alone(spark):
    r = random.Random(2)
    docs = [(i, "x" * 100 + f"{i:04}" + "y" * r.randrange(300), "a", 1, 1) for i in range(500)] + [(1000 + i, f"{i:04}" + "z" * 246, "a", 1, 1) for i in range(60)]
    docs += [(2000 + i, f"{i:03}" + "é" * 100 + "q" * 57, "b", 1, 1) for i in range(30)] + [(3000 + i, f"{i:04}" + "e" * (20 + i % 5), "c", 1, 1) for i in range(400)]
    got = rows(truncation.length_limits(spark.createDataFrame(docs, SCHEMA)))
    assert ("=a", "chars", 250) in got and ("=b", "bytes", 260) in got and not [x for x in got if x[0] == "=c"]


def test_ending():
    e = lambda t: truncation.ending(t)[0]
    assert e("All is well!") == "done" and e("x ```\ncode") == "fence" and e("done. […]") == "omission" and e("and so on...") == "ask" and e("the") == "ask" and e("(all of it?)") == "done"
    assert e("half \ufffd") == "character" and e("one two three four five six seven eight nine") == "ask long"
    assert truncation.ending("x " * 3000 + "y" * 5000)[1][3] == "y" * 5000  # the whole last token, however long


def test_null_source_is_its_own(spark):
    docs = [(i, f"{i:04}" + "z" * 246 + ".", None, 1, 1) for i in range(60)] + [(100 + i, "q" * (i + 20) + ".", "", 1, 1) for i in range(300)]
    got = rows(truncation.length_limits(spark.createDataFrame(docs, SCHEMA)))
    assert got == [("null", "chars", 251)]


def test_counts_against_a_plain_count():
    from collections import Counter

    texts = ["A cat sat. Then 12 cats sat...\nthe end", "", None, "one\n\n```\ncode x\n```\nFoo.bar it", "the end", "x"]
    ends, more, words = Counter(), Counter(), Counter()
    for t in texts:
        seen = set()
        for line in truncation.prose_lines(truncation.stripped(t or "")):
            tokens = truncation._TOKEN.findall(truncation._bare(line))
            seen.update(tokens)
            s = ["^", "^", *map(truncation.shape, tokens)]
            for i, x in enumerate(tokens):
                k = tuple(s[i : i + 3])
                if i + 1 == len(tokens):
                    ends[k] += 1
                elif x != "." or not truncation._opens(tokens[i + 1]):
                    more[k] += 1
                else:
                    more[k] += 0
        for part in (t or "").split("```")[1::2]:
            seen.update(truncation._TOKEN.findall(part))
        words.update(seen)
    got_words, n, lasts, (g, ctx, e, m, h, e2, m2) = truncation.batch_counts(texts)
    assert dict(zip(got_words, n.tolist(), strict=True)) == words | {w: 0 for w in got_words if w not in words}
    key = lambda k: int(truncation._chain(truncation._chain(*(truncation._word_hashes([x]) for x in k[:2])), truncation._word_hashes([k[2]])).view("i8")[0])
    want = {key(k): (k[2], ends[k], more[k]) for k in ends.keys() | more.keys()}
    assert {a: (w, b, c) for a, w, b, c in zip(g.tolist(), lasts, e.tolist(), m.tolist(), strict=True)} == want
    assert e.sum() == e2.sum() and m.sum() == m2.sum() and set(ctx.tolist()) == set(h.tolist())
    assert truncation.batch_counts([])[0] == [] and len(truncation.batch_counts(["", None])[3][0]) == 0
