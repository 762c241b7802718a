"""Enrichment of theorems by a text model behind a pluggable client, with a cache keyed by theorem, prompt hash and model; embedding by a pluggable encoder."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.functions.keys import clean_values
from lemmary.functions.text import numbered, prompt_hash, truncate
from lemmary.operators.profiles import first_states

#: The fields of an answer, the names of strategies, the difficulty hints.
FIELDS = ["topic", "mathematical_objects", "goal_pattern", "key_symbols", "useful_lemma_types", "strategy_facets", "likely_tactics", "difficulty_reasons", "difficulty_bucket_hint"]
FACETS = [
    "rewrite_transport", "case_analysis", "induction_recursion", "typeclass_instance_resolution", "order_inequality_reasoning",
    "algebraic_computation", "set_membership_reasoning", "theorem_application", "other",
]
HINTS = ["easy", "medium", "hard", "unknown"]
_LISTS = {"mathematical_objects", "key_symbols", "useful_lemma_types", "likely_tactics", "difficulty_reasons"}
_FACET_TYPE = "array<struct<facet:string,target:string,direction_or_action:string,confidence:double>>"
_TYPES = {f: "array<string>" if f in _LISTS else _FACET_TYPE if f == "strategy_facets" else "string" for f in FIELDS}
PROMPT_VERSION = "v2"
#: How many answers a summary lists errors of.
LISTED_ERRORS = 20


def prompt_rows(theorems: DataFrame, theorem_states: DataFrame, max_states: int = 5) -> DataFrame:
    """``theorems`` (id, ...) with what a prompt shows of their first states: goals and hypotheses of at most 500 characters each, up to 80 sorted symbols."""
    s = F.struct("n", "goal_text", "local_hypotheses", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))
    st = first_states(theorem_states, max_states).groupBy("theorem_id").agg(F.array_sort(F.collect_list(s)).alias("st"))
    shown = st.select(
        "theorem_id",
        F.transform("st", lambda x: truncate(x["goal_text"], 500)).alias("goals"),
        F.transform("st", lambda x: truncate(F.array_join(F.slice(F.filter(x["local_hypotheses"], lambda h: h.isNotNull()), 1, 4), " | "), 500)).alias("hypotheses"),
        F.slice(clean_values(F.flatten(F.transform("st", lambda x: x["symbols"]))), 1, 80).alias("symbols"),
    )
    return theorems.withColumnRenamed("id", "theorem_id").join(shown, "theorem_id", "left")


def prompt() -> Column:
    """The request for one theorem from the columns of :func:`prompt_rows`."""
    shape = ", ".join(f'"{f}": [{{"facet", "target", "direction_or_action", "confidence"}}]' if f == "strategy_facets" else f'"{f}": [text]' if f in _LISTS else f'"{f}": text' for f in FIELDS)
    named = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws(
        "\n", F.lit("Describe the formal theorem below for search. Rely on what is shown alone; name no lemma that isn't shown, but say what kind of lemma would help."),
        F.lit("Answer with one JSON object and nothing else."), F.lit(""),
        named("Id", F.col("theorem_id")), named("Name", F.col("full_name")), named("File", F.col("file_path")), named("Area", F.concat_ws(" / ", "domain_tag", "subdomain_tag")),
        F.lit("Goals:"), numbered("goals"), F.lit("Hypotheses:"), numbered("hypotheses"), named("Symbols", F.array_join("symbols", ", ")),
        F.lit(""), F.lit("Keys: {" + shape + "}"), F.lit("Facets: " + ", ".join(FACETS)), F.lit("Difficulty: " + ", ".join(HINTS)),
    )


def requests(shown: DataFrame, model: str) -> DataFrame:
    """(theorem_id, full_name, split, prompt, prompt_hash, model, prompt_version)."""
    p = shown.select("theorem_id", "full_name", "split", prompt().alias("prompt"), F.lit(model).alias("model"), F.lit(PROMPT_VERSION).alias("prompt_version"))
    return p.withColumn("prompt_hash", prompt_hash("model", "prompt"))


_KEY = ["theorem_id", "prompt_hash", "model"]


def uncached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that no cached answer fits: same theorem, prompt hash and model. A changed prompt is asked again."""
    return wanted.join(cache.select(*_KEY).distinct(), _KEY, "left_anti")


def extract_json(text: str) -> dict:
    """The JSON object of an answer: fences are removed, else the part from the first to the last brace; ValueError if there is none."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text or "")
    try:
        found = json.loads(body)
    except ValueError:
        start, end = body.find("{"), body.rfind("}")
        if start < 0 or end <= start:
            raise ValueError("no JSON object in the answer") from None
        found = json.loads(body[start : end + 1])
    if not isinstance(found, dict):
        raise ValueError("the answer isn't a JSON object")
    return found


def stub_client(text: str) -> str:
    """A deterministic offline client: an answer made from the hash of the prompt."""
    h = hashlib.sha256(text.encode()).hexdigest()
    facet = {"facet": FACETS[int(h[9], 16) % len(FACETS)], "target": h[:4], "direction_or_action": "rewrite", "confidence": 0.5}
    return "```json\n" + json.dumps({"topic": f"topic {h[:4]}", "goal_pattern": "rewrite", "key_symbols": [h[4:8]], "strategy_facets": [facet], "difficulty_bucket_hint": HINTS[int(h[8], 16) % 3]}) + "\n```"


def _field(name: str, v: object) -> object:
    if v is None:
        return None
    if name == "strategy_facets":
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        text = lambda x: None if x is None else str(x)
        return [{**{k: text(x.get(k)) for k in ("facet", "target", "direction_or_action")}, "confidence": number(x.get("confidence"))} for x in v if isinstance(x, dict)] if isinstance(v, list) else []
    if name in _LISTS:
        return [str(x) for x in v] if isinstance(v, list) else [str(v)]
    return v if isinstance(v, str) else json.dumps(v)


def enrich(wanted: DataFrame, client: Callable[[str], str] = stub_client, retries: int = 3, concurrency: int = 8) -> DataFrame:
    """(theorem_id, full_name, split, prompt_hash, model, prompt_version, created_at, status, error, raw_response, <fields>).

    ``concurrency`` requests of a task are under way at once. Failures become rows with status 'error', the run goes on.
    Missing fields are null; ``created_at`` is the time of the answer in UTC.
    """
    head = "theorem_id string, full_name string, split string, prompt_hash string, model string, prompt_version string, created_at string, status string, error string, raw_response string"
    schema = head + ", " + ", ".join(f"{f} {t}" for f, t in _TYPES.items())
    names = [c.split()[0] for c in head.split(", ")] + FIELDS

    def one(text: str) -> tuple[dict, str | None, str | None]:
        last, raw = "", None
        for _ in range(retries):
            try:
                raw = client(text)
                return extract_json(raw), None, raw
            except Exception as e:  # noqa: BLE001
                last = str(e)[:300]
        return {}, last, raw

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for f in frames:
                out = []
                for r, (found, error, raw) in zip(f.itertuples(index=False), pool.map(one, f["prompt"]), strict=True):
                    now = datetime.datetime.now(datetime.UTC).isoformat()
                    row = [r.theorem_id, r.full_name, r.split, r.prompt_hash, r.model, r.prompt_version, now, "error" if error else "ok", error, raw]
                    out.append(row + [_field(n, found.get(n)) for n in FIELDS])
                yield pd.DataFrame(out, columns=names)

    return wanted.mapInPandas(run, schema)


def enrichment_run(wanted: DataFrame, cache: DataFrame | None, client: Callable[[str], str] = stub_client, limit: int | None = None, force: bool = False, retries: int = 3, concurrency: int = 8) -> DataFrame:
    """Answers to ``wanted``, the cached ones (rows of an earlier run with status 'ok') as they are and new ones for the rest.

    ``limit``: only the first requests by theorem id, as a pilot. ``force``: ask for all again.
    """
    if limit is not None:
        wanted = wanted.orderBy("theorem_id").limit(limit)
    if cache is None or force:
        return enrich(wanted, client, retries, concurrency)
    good = cache.where("status = 'ok'").dropDuplicates(_KEY)
    return enrich(uncached(wanted, good), client, retries, concurrency).unionByName(good.join(wanted.select(*_KEY), _KEY, "left_semi"))


def enrichment_summary(answers: DataFrame) -> DataFrame:
    """One row: requested, succeeded, failed and the first errors by theorem id, as 'id: error' lines."""
    first = answers.where("status = 'error'").orderBy("theorem_id").limit(LISTED_ERRORS).select(F.lit(None).cast("string").alias("status"), F.concat_ws(": ", "theorem_id", "error").alias("line"))
    rows = answers.select("status", F.lit(None).cast("string").alias("line")).unionByName(first)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return rows.agg(F.count("status").alias("requested"), n("ok").alias("succeeded"), n("error").alias("failed"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("errors"))


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in for an encoder: signed word counts in ``dim`` hash slots, unit length; zeros without words."""
    words = [t.lower().split() for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    h = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known), np.uint64, len(known))
    rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    code = np.fromiter((known[w] for ws in words for w in ws), np.int64, len(rows))
    slot, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(rows * dim + slot[code], sign[code], len(texts) * dim).reshape(len(texts), dim)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def embed(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_words, batch_size: int = 256) -> DataFrame:
    """``docs`` (text and other columns) with ``embedding`` (array<float>) instead of ``text``: ``encoder`` gets up to ``batch_size`` texts and gives a row each.

    Null texts count as empty.
    """
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                v = np.asarray(encoder([t or "" for t in b.column("text").to_pylist()]), np.float32)
                edges = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.ListArray.from_arrays(edges, pa.array(v.ravel()))], names=[*kept, "embedding"])

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{types}, embedding array<float>")
