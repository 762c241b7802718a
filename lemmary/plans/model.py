"""The proof graph as clean DataFrames: one whole row per id, links of states to all their theorems, distinct edges, usable vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_key
from lemmary.sources.files import exists, optional_table
from lemmary.sources.tables import table

DIM = 64
#: Tables that a folder may lack; what they hold is derived then.
OPTIONAL = {
    "proof_state_techniques": "proof_state_id string, technique_id string, label string",
    "theorem_features": "theorem_id string, theorem_complexity_score double, difficulty_bucket string",
}


def in_file_order(rows: DataFrame) -> Column:
    """The place of a row of a Parquet table: its file, then its number in it."""
    return F.struct(rows["_metadata.file_name"].alias("file"), rows["_metadata.row_index"].alias("row"))


def whole_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of ``rows`` for each ``by``: the first in ``order``, values before nulls. The values of a row stay together."""
    key = [x for c in order for x in (F.col(c).isNull().alias(f"__{c}"), F.col(c))]
    return rows.groupBy(*by).agg(F.min(F.struct(*key)).alias("__row")).select(*by, *[F.col(f"__row.{c}").alias(c) for c in order])


class Model:
    """Lazy views of the tables of one folder. Ids are cleaned first; repeated rows count once."""

    def __init__(self, spark: SparkSession, folder: str, answers: DataFrame | None = None) -> None:
        """``answers``: rows of an enrichment run to be used instead of the folder's ``theorem_enrichment``."""
        self.spark, self.folder, self.answers = spark, folder, answers

    def raw(self, name: str) -> DataFrame:
        """A table of the folder; one that may be missing is empty then, any other is an error (FileNotFoundError)."""
        if name == "theorem_enrichment" and self.answers is not None:
            return self.answers.where("status = 'ok'")
        if name in OPTIONAL:
            return optional_table(self.spark, f"{self.folder}/{name}.parquet", OPTIONAL[name])
        return table(self.spark, self.folder, name)

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}.parquet")

    def _one_per_id(self, name: str, id_col: str, order: list[str]) -> DataFrame:
        rows = self.raw(name).withColumn(id_col, clean_key(id_col)).where(F.col(id_col).isNotNull())
        return whole_rows(rows, [id_col], order)

    def theorems(self) -> DataFrame:
        return self._one_per_id("theorems", "id", ["split", "full_name", "file_path", "domain_tag", "subdomain_tag"])

    def theorem_order(self) -> DataFrame:
        """(id, seq): the first place of each theorem in its file."""
        t = self.raw("theorems")
        return t.select(clean_key("id").alias("id"), in_file_order(t).alias("seq")).where("id IS NOT NULL").groupBy("id").agg(F.min("seq").alias("seq"))

    def _state_table(self) -> DataFrame:
        return self.raw("proof_states").withColumns({"id": clean_key("id"), "theorem_id": clean_key("theorem_id")}).where("id IS NOT NULL")

    def states(self) -> DataFrame:
        """One row per state; of several theorems the smallest id."""
        rest = ["split", "full_name", "tactic_idx", "goal_text", "tactic", "domain_tag", "subdomain_tag", "symbols", "local_hypotheses"]
        return whole_rows(self._state_table(), ["id"], ["theorem_id", *rest])

    def theorem_states(self) -> DataFrame:
        """One row per theorem and state: a state under several theorems has one for each."""
        rest = ["split", "full_name", "tactic_idx", "goal_text", "tactic", "domain_tag", "subdomain_tag", "symbols", "local_hypotheses"]
        return whole_rows(self._state_table().where("theorem_id IS NOT NULL"), ["id", "theorem_id"], rest)

    def links(self) -> DataFrame:
        """(proof_state_id, theorem_id, split): all that the rows of the states tell, each once."""
        return self._state_table().where("theorem_id IS NOT NULL").select(F.col("id").alias("proof_state_id"), "theorem_id", "split").distinct()

    def premises(self) -> DataFrame:
        return self._one_per_id("premises", "id", ["split", "full_name", "file_path", "domain_tag", "subdomain_tag", "code"])

    def enrichment(self) -> DataFrame:
        arrays = ["mathematical_objects", "key_symbols", "useful_lemma_types", "strategy_facets", "likely_tactics", "difficulty_reasons"]
        texts = ["prompt_version", "prompt_hash", "model", "split", "full_name", "topic", "goal_pattern", "difficulty_bucket_hint"]
        return self._one_per_id("theorem_enrichment", "theorem_id", [*texts, *arrays])

    def edges(self) -> DataFrame:
        """(proof_state_id, premise_id), distinct, both known."""
        e = self.raw("positive_edges").select(clean_key("proof_state_id").alias("proof_state_id"), clean_key("premise_id").alias("premise_id"))
        return e.where("proof_state_id IS NOT NULL AND premise_id IS NOT NULL").distinct()

    def techniques(self) -> DataFrame:
        """(proof_state_id, theorem_id, label, split): labels of states, of a table or else the first word of a state's tactic."""
        if self.has("proof_state_techniques"):
            t = self.raw("proof_state_techniques").select(clean_key("proof_state_id").alias("proof_state_id"), F.trim("label").alias("label"))
            return self.links().join(t.where("label != ''").distinct(), "proof_state_id").select("proof_state_id", "theorem_id", "label", "split")
        label = F.split(F.trim("tactic"), " ")[0]
        return self._state_table().select(F.col("id").alias("proof_state_id"), "theorem_id", label.alias("label"), "split").where("label != ''").distinct()

    def premise_votes(self, split: str) -> DataFrame:
        """(theorem_id, item_id, seq): a vote for every row of the edges, in file order; rows repeated whole count once."""
        e = self.raw("positive_edges")
        e = e.select(clean_key("proof_state_id").alias("proof_state_id"), clean_key("premise_id").alias("item_id"), "recorded_at", in_file_order(e).alias("seq"))
        e = e.where("proof_state_id IS NOT NULL AND item_id IS NOT NULL").groupBy("proof_state_id", "item_id", "recorded_at").agg(F.min("seq").alias("seq"))
        return e.join(self.links().where(F.col("split") == split).drop("split"), "proof_state_id").select("theorem_id", "item_id", "seq")

    def label_votes(self, split: str) -> DataFrame:
        """(theorem_id, item_id, seq): a vote for the label of every state, in the file order of the states."""
        s = self.raw("proof_states")
        s = s.select(clean_key("id").alias("proof_state_id"), clean_key("theorem_id").alias("theorem_id"), "split", in_file_order(s).alias("seq"))
        s = s.where((F.col("split") == split) & F.col("theorem_id").isNotNull()).groupBy("proof_state_id", "theorem_id").agg(F.min("seq").alias("seq"))
        labels = self.techniques().where(F.col("split") == split).select("proof_state_id", "theorem_id", F.col("label").alias("item_id"))
        return s.join(labels, ["proof_state_id", "theorem_id"]).select("theorem_id", "item_id", "seq")

    def features(self) -> DataFrame:
        """(theorem_id, num_proof_states, theorem_complexity_score, difficulty_bucket) of a table or else from the theorem's proof states."""
        n, top = F.count_distinct("id"), F.max(F.coalesce("tactic_idx", F.lit(0)))
        d = self._state_table().where("theorem_id IS NOT NULL").groupBy("theorem_id").agg(n.alias("num_proof_states"), (n + top / 10).alias("theorem_complexity_score"))
        bucket = F.when(F.col("num_proof_states") <= 2, "easy").when(F.col("num_proof_states") <= 6, "medium").otherwise("hard")
        d = d.withColumn("difficulty_bucket", bucket)
        if not self.has("theorem_features"):
            return d
        given = self.raw("theorem_features").withColumn("theorem_id", clean_key("theorem_id")).where("theorem_id IS NOT NULL")
        given = whole_rows(given, ["theorem_id"], ["theorem_complexity_score", "difficulty_bucket"])
        return given.join(d.select("theorem_id", "num_proof_states"), "theorem_id", "left").select(d.columns)

    def vectors(self, entity_type: str) -> DataFrame:
        """(id, row_index, v) of the entities of a type with a usable vector: 64 values, none null, not all zero."""
        ok = (F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0)
        rows = self.raw("entity_vectors").where((F.col("entity_type") == entity_type) & ok)
        return rows.select(clean_key("entity_id").alias("id"), "row_index", F.col("embedding").alias("v")).groupBy("id").agg(F.min("row_index").alias("row_index"), F.min("v").alias("v"))

    def pool(self) -> DataFrame:
        """(id): premises of train."""
        return self.premises().where("split = 'train'").select("id")

    def gold(self, split: str) -> DataFrame:
        """(query_id, item_id): premises used by the states of a split."""
        s = self.states().where(F.col("split") == split).select(F.col("id").alias("proof_state_id"))
        return self.edges().join(s, "proof_state_id", "left_semi").select(F.col("proof_state_id").alias("query_id"), F.col("premise_id").alias("item_id"))

    def edges_by_theorem(self, split: str) -> DataFrame:
        links = self.links().where(F.col("split") == split).select("proof_state_id", "theorem_id")
        return self.edges().join(links, "proof_state_id").select("theorem_id", "premise_id").distinct()

    def strategies_by_theorem(self, split: str) -> DataFrame:
        return self.techniques().where((F.col("split") == split) & F.col("theorem_id").isNotNull()).select("theorem_id", "label").distinct()
