"""How joins of an operator are carried out."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Partitions of a join's smaller side up to this size are joined by a hash table, larger ones by sorting; checked at run time.
HASH_JOIN_BYTES = "64MB"


@contextlib.contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Within, adaptive execution may join by hash table what it has measured to be small enough. For plans that are run inside."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, HASH_JOIN_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)
