"""Text expressions: tokens, symbol normalisation, profile parts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word starts with a letter, digit or underscore and goes on with these, quotes, dots and colons; else one character.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'.:]*|[^\s\x0b\x1c-\x1f\x85\p{Z}]"
#: What is no word character at either end of a symbol.
SYMBOL_EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """The lower-cased tokens of a text in order, with repeats; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def symbol_tokens(*parts: Column | str) -> Column:
    """Distinct lower-case symbol parts of texts: cut at dots, underscores, quotes and spaces, two characters or more, bare ends."""
    text = F.lower(F.translate(F.concat_ws(" ", *[F.coalesce(_c(p), F.lit("")) for p in parts]), "._'", "   "))
    words = F.filter(F.split(text, SPACES), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.filter(F.transform(words, lambda x: F.regexp_replace(x, SYMBOL_EDGES, "")), lambda x: x != ""))


def lines(*parts: Column | str) -> Column:
    """The non-empty parts, one per line; null parts are empty."""
    return F.array_join(F.filter(F.array(*[F.coalesce(_c(p), F.lit("")) for p in parts]), lambda x: x != ""), "\n")


def tags(domain: Column | str, subdomain: Column | str) -> Column:
    return F.trim(F.concat(F.coalesce(_c(domain), F.lit("")), F.lit(" "), F.coalesce(_c(subdomain), F.lit(""))))


def words(c: Column | str) -> Column:
    """The values of an array that aren't null or blank, as they are, with spaces between."""
    return F.array_join(F.filter(_c(c), lambda x: x.isNotNull() & x.rlike(r"\S")), " ")


def facet_text(c: Column | str) -> Column:
    """Facet, target and direction of every strategy, blank ones skipped."""
    flat = F.flatten(F.transform(_c(c), lambda s: F.array(s["facet"], s["target"], s["direction_or_action"])))
    return words(flat)


def truncate(c: Column | str, limit: int) -> Column:
    """The text, or its first ``limit`` characters and three dots if it is longer."""
    return F.when(F.length(_c(c)) > limit, F.concat(F.substring(_c(c), 1, limit), F.lit("..."))).otherwise(_c(c))


def numbered(c: Column | str) -> Column:
    """'1. a', '2. b', ... one per line; blank values are skipped, the others keep their number."""
    line = F.transform(_c(c), lambda x, i: F.when(x.rlike(r"\S"), F.concat((i + 1).cast("string"), F.lit(". "), x)))
    return F.array_join(F.filter(line, lambda x: x.isNotNull()), "\n")


def prompt_hash(model: Column | str, prompt: Column | str) -> Column:
    return F.sha2(F.concat(_c(model), F.lit("\n"), _c(prompt)), 256)


def file_name(c: Column | str) -> Column:
    return F.translate(_c(c), "/:", "__")


def model_slug(c: Column | str) -> Column:
    """Runs of anything but letters, digits, dots, dashes and underscores as one underscore, none at the ends; 'model' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "model").otherwise(slug)


def markdown(c: Column | str) -> Column:
    return F.replace(F.replace(_c(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
