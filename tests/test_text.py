import re

from conftest import rows
from lemmary.functions import text as T
from lemmary.functions.keys import clean_key, clean_values
from pyspark.sql import functions as F

CASES = ["h₁", "α_x.foo'", ".bar", "a₀'", "é½", "éx", "(x", "", "Foo.bar_baz ≤ 'q", "a b", "x:y..z"]


def test_tokens_match_the_word_boundary_form(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    got = [r[0] for r in d.orderBy("i").select(T.tokens("t")).collect()]
    assert got == [re.findall(r"\b[\w'.:]+|\S", c.lower()) for c in CASES]
    assert spark.range(1).select(T.tokens(F.lit(None).cast("string"))).first()[0] == []


def test_symbol_tokens(spark):
    d = spark.createDataFrame([("Foo.bar_Baz x 'qu' (ab)", None)], "a string, b string")
    assert sorted(d.select(T.symbol_tokens("a", "b")).first()[0]) == ["ab", "bar", "baz", "foo", "qu"]


def test_lines_and_lists(spark):
    d = spark.createDataFrame([("a", None, "", [" x", None, " ", "y"])], "a string, b string, c string, l array<string>")
    r = d.select(T.lines("a", "b", "c", F.lit("z")), T.words("l"), T.tags("b", "a"), T.numbered("l"), T.truncate(F.lit("abcdef"), 3), T.truncate(F.lit("abc"), 3)).first()
    assert tuple(r) == ("a\nz", " x y", "a", "1.  x\n4. y", "abc...", "abc")
    assert d.select(T.words(F.lit(None).cast("array<string>"))).first()[0] is None


def test_names(spark):
    r = spark.range(1).select(T.file_name(F.lit("a/b:c")), T.model_slug(F.lit("org/model x!")), T.model_slug(F.lit("///")), T.markdown(F.lit("a|b\nc")), T.prompt_hash(F.lit("m"), F.lit("p"))).first()
    import hashlib

    assert tuple(r) == ("a_b_c", "org_model_x", "model", "a\\|b c", hashlib.sha256(b"m\np").hexdigest())


def test_keys(spark):
    d = spark.createDataFrame([(" a ",), ("  ",), (None,), ("\t",), ("b",)], "k string")
    assert [r[0] for r in d.select(clean_key("k")).collect()] == ["a", None, None, None, "b"]
    v = spark.createDataFrame([([" b", "a", None, "b ", " "],), (None,), ([],)], "v array<string>")
    assert rows(v.select(clean_values("v"))) == sorted([(["a", "b"],), ([],), ([],)], key=repr)
