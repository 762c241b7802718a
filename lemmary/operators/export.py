"""Enriched tables, their manifest and their layout on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split names in the hub layout.
HUB_SPLITS = {"train": "train", "val": "validation", "test": "test"}
#: The tables of a dataset besides theorems and their profiles; those of the second line may be missing.
TABLES = ["positive_edges", "premises", "proof_states"]
MORE_TABLES = ["file_modules", "negative_edges", "premise_techniques", "proof_state_features", "proof_state_techniques", "proof_techniques", "theorem_features"]


def prefixed(enrichment: DataFrame, key: str = "theorem_id") -> DataFrame:
    """All columns but the key with the prefix 'llm_'."""
    return enrichment.withColumnsRenamed({c: f"llm_{c}" for c in enrichment.columns if c != key})


def enriched_theorems(theorems: DataFrame, features: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Theorems with features and enrichment (null where missing) and whether there is one; an empty topic counts as one."""
    f = features.withColumnRenamed("theorem_id", "id")
    e = prefixed(enrichment).withColumnRenamed("theorem_id", "id")
    return theorems.join(f, "id", "left").join(e, "id", "left").withColumn("llm_enrichment_available", F.col("llm_topic").isNotNull())


def manifest(enriched: DataFrame) -> DataFrame:
    """Per split: theorems, enriched theorems, coverage, sorted models and prompt versions."""
    has = F.col("llm_enrichment_available")
    return enriched.groupBy("split").agg(
        F.count(F.lit(1)).alias("theorems"), F.count(F.when(has, 1)).alias("llm_enriched_theorems"), F.round(F.avg(has.cast("double")), 6).alias("llm_enrichment_coverage"),
        F.array_join(F.sort_array(F.collect_set("llm_model")), ",").alias("llm_models"), F.array_join(F.sort_array(F.collect_set("llm_prompt_version")), ",").alias("llm_prompt_versions"),
    )


def versions(enriched: DataFrame) -> DataFrame:
    """One row: the sorted models and prompt versions of all splits together."""
    union = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return enriched.agg(union("llm_model").alias("llm_models"), union("llm_prompt_version").alias("llm_prompt_versions"))


def of_split(rows: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with a column ``split``: their own, or that of the first of ``keys`` (column name -> (key, split)) they have.

    A row whose key has several splits stands in each. Rows of a table without any of the keys stand in every split.
    """
    if "split" in rows.columns:
        return rows
    for column, owner in keys.items():
        if column in rows.columns:
            k = owner.columns[0]
            return rows.join(owner.withColumnRenamed(k, "__key").where("__key IS NOT NULL").distinct(), F.trim(rows[column]) == F.col("__key")).drop("__key")
    return rows.withColumn("split", F.explode(F.array(*[F.lit(s) for s in HUB_SPLITS])))


def split_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, split, n) of tables with a split."""
    parts = [d.where(F.col("split").isin(*HUB_SPLITS)).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "split", "n") for n, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_splits(df: DataFrame, folder: str, name: str) -> None:
    """``folder/{split}/{name}.parquet`` and ``folder/hf/{name}/{hub split}``, one pair per split."""
    for split, hub in HUB_SPLITS.items():
        part = df.where(F.col("split") == split)
        part.write.mode("overwrite").parquet(f"{folder}/{split}/{name}.parquet")
        part.write.mode("overwrite").parquet(f"{folder}/hf/{name}/{hub}")


def card(version: str, splits: dict[str, dict]) -> str:
    """A description of the dataset: what it holds, its columns, its limits, and a table of its sizes."""
    lines = [
        f"# Enriched proof-graph dataset {version}", "",
        "Splits of a proof graph (theorems, proof states, premises and the edges between them) with descriptions of theorems by a text model.", "",
        "## Tables", "",
        "- `theorems`: theorems with difficulty features and enrichment (columns `llm_*`; `llm_enrichment_available` says whether there is one)",
        "- `theorem_profiles`: profile texts without (`base_profile_text`) and with enrichment (`profile_text`)",
        "- `proof_states`, `premises`, `positive_edges` and, where given, further tables, as they were", "",
        "`{split}/{table}.parquet` holds a split of a table, `hf/{table}/{split}` the same under the names of the hub.", "",
        "## Sizes", "", "| Split | Theorems | Proof states | Premises | Positive edges | Enriched theorems | Coverage |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |",
    ]
    for split, x in splits.items():
        t = x["tables"]
        lines.append(f"| {split} | {t.get('theorems', 0)} | {t.get('proof_states', 0)} | {t.get('premises', 0)} | {t.get('positive_edges', 0)} | {x['llm_enriched_theorems']} | {x['llm_enrichment_coverage']:.1%} |")
    return "\n".join([*lines, "", "## Limits", "", "Enrichment is written by a model and may be wrong. Strategy labels and difficulty are derived, not judged by people.", ""])
