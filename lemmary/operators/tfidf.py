"""TF-IDF: 1 + ln(tf), idf = ln((1 + n) / (1 + df)) + 1, rows of unit length; vocabulary and idf from the fitted side only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.text import symbol_tokens, tokens
from lemmary.operators.cut import cut, store
from lemmary.operators.retrieval import sparse_top_k

#: Vocabulary sizes of the text and the symbol sources; they also bound the broadcast idf table.
TEXT_FEATURES, SYMBOL_FEATURES = 300_000, 250_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, text). Whole texts are shuffled, which are smaller than their terms with an id each."""
    return docs.select("id", "text").repartition("id").select("id", F.explode(tokens("text")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, max_features: int) -> DataFrame:
    """(term, df, total): the ``max_features`` terms with the highest total count, ties by term."""
    return most_frequent(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), max_features)


def most_frequent(terms: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of ``terms`` (term, total, ...; each term once) with the highest total, ties by term; computed once and cut.

    Nothing is sorted as a whole: a histogram of totals (few distinct values) gives the total of the last row, which all
    above pass. Rows of that total are range-partitioned by term and numbered within their ranges.
    """
    terms = store(terms)
    if terms.count() <= limit:
        return terms
    sums = terms.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    running = sums.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("total"))))
    last = running.where(F.col("upto") >= limit).orderBy("upto").first()
    above, room = terms.where(F.col("total") > last["total"]), limit - (last["upto"] - last["n"])
    tied = cut(terms.where(F.col("total") == last["total"]).repartitionByRange("term").withColumn("__range", F.spark_partition_id()))
    sizes, before, offset = tied.groupBy("__range").count().orderBy("__range").collect(), 0, F.lit(0)
    for r in sizes:  # as many as partitions
        offset = F.when(F.col("__range") == r["__range"], before).otherwise(offset)
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("__range").orderBy("term")) + offset
    return store(above.unionByName(tied.withColumn("__place", place).where(F.col("__place") <= room).drop("__range", "__place")))


def idf_of(counts: DataFrame, n: int, max_features: int = TEXT_FEATURES) -> DataFrame:
    """(term, df, idf) from (id, term, tf) rows of ``n`` documents, those without tokens included."""
    return vocabulary(counts, max_features).select("term", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def fit(docs: DataFrame, max_features: int = TEXT_FEATURES) -> DataFrame:
    """(term, df, idf) over docs (id, text)."""
    return idf_of(term_counts(docs), docs.count(), max_features)


def _weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Terms out of vocabulary are dropped; the idf table has at most ``max_features`` rows, whose size decides how it is joined."""
    return counts.join(idf, "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def weights(docs: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, w): unit-length weights of docs (id, text)."""
    raw = _weighted(term_counts(docs), idf)
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_rows(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, t, w): unit-length sparse rows with hashed term ids. A row is as long as its document."""
    raw = _weighted(counts, idf).select("id", F.xxhash64("term").alias("t"), "w")
    rows = raw.groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("p"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    return rows.select("id", F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["w"] / F.col("norm")).alias("w"))


def lexical_top_k(queries: DataFrame, candidates: DataFrame, k: int, max_features: int = TEXT_FEATURES) -> DataFrame:
    """The k candidates (id, text) with the highest TF-IDF cosine for every query (id, text)."""
    counts = term_counts(candidates)  # twice, for the vocabulary and for the weights: kept, they would be many times the texts
    idf = idf_of(counts, candidates.count(), max_features)
    return sparse_top_k(store(sparse_rows(term_counts(queries), idf)), store(sparse_rows(counts, idf)), k)


def symbol_terms(docs: DataFrame, parts: list) -> DataFrame:
    """(id, term) of the symbol tokens of ``parts``, each once."""
    return docs.select("id", F.explode(symbol_tokens(*parts)).alias("term"))


def symbol_vocabulary(terms: DataFrame, max_features: int = SYMBOL_FEATURES) -> DataFrame:
    """(term) of the ``max_features`` symbol tokens that most documents have."""
    return most_frequent(terms.groupBy("term").agg(F.count(F.lit(1)).alias("total")), max_features).select("term")


def symbol_rows(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, t, w): binary sparse rows of the terms in the vocabulary."""
    sets = terms.join(vocabulary, "term", "left_semi").groupBy("id").agg(F.collect_list(F.xxhash64("term")).alias("t"))
    return sets.withColumn("w", F.transform("t", lambda x: F.lit(1.0)))
