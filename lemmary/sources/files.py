"""Other sources and sinks: optional and required tables, JSON, JSON lines, text, environment files, an HTTP text model."""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a local or remote path exists, by the session's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one with ``schema`` where there is none. Missing columns come as nulls, others are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found, want = spark.read.parquet(path), spark.createDataFrame([], schema).schema
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def required_table(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"missing table: {path}")
    return spark.read.parquet(path)


def read_json(path: str, default: Any = None) -> Any:
    """The JSON document of a small local file, ``default`` where there is none."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def plain(value: Any) -> Any:
    """NaN and infinities as null, rows as objects, array scalars as Python numbers."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(value: Any, path: str) -> None:
    """Indented, with sorted keys."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(value), f, indent=2, sort_keys=True, ensure_ascii=False)


def write_json_lines(df: DataFrame, folder: str) -> None:
    """One record per line, in as many files as ``df`` has partitions."""
    df.write.mode("overwrite").json(folder)


def nested(value: Any, path: str, default: Any = "") -> Any:
    """The value at a dotted path of nested dictionaries."""
    for key in path.split("."):
        if not isinstance(value, dict) or key not in value:
            return default
        value = value[key]
    return value


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines, quotes removed; blank lines and comments are skipped; variables that are set keep their value."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, mark, value = line.strip().partition("=")
                if mark and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("'\"")
    for key, value in found.items():
        os.environ.setdefault(key, value)
    return found


def http_client(url: str, headers: dict[str, str], body: Callable[[str], dict], answer: Callable[[dict], str], retries: int = 3, timeout: float = 60.0, wait: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A client for :func:`lemmary.operators.enrich.enrich`: posts JSON, waits 1, 2, 4, at most 8 seconds between tries."""

    def call(text: str) -> str:
        data = json.dumps(body(text)).encode()
        for attempt in range(retries + 1):
            try:
                request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **headers})
                with urllib.request.urlopen(request, timeout=timeout) as response:
                    return answer(json.loads(response.read()))
            except (urllib.error.URLError, OSError, ValueError):
                if attempt == retries:
                    raise
                wait(min(2**attempt, 8))
        raise RuntimeError("unreachable")

    return call
