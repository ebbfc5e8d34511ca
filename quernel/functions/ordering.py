"""Orders and draws that depend on hashes only, so that every engine and every run draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.plans.scan import prefix_sum

#: Rows are ranked in buckets by the first hex digits of their hash.
DIGITS = 3


def hash_of(seed: str | Column, *keys: Column) -> Column:
    """md5 of the seed and the keys, as 32 hex digits."""
    head = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws("|", head, *[k.cast("string") for k in keys]))


def hash_int(seed: str | Column, *keys: Column) -> Column:
    """The first 32 bits of ``hash_of``."""
    return F.conv(F.substring(hash_of(seed, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed: str | Column, *keys: Column) -> Column:
    """``hash_int`` scaled to [0, 1)."""
    return hash_int(seed, *keys) / F.lit(4294967296.0)


def hash_ranked(df: DataFrame, seed: str, key: str, partition: list[str] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with each row's rank, from 1, in the hash order of ``key`` (unique) within ``partition``.

    Buckets of equal leading hash digits are ranked apart and offset by the rows before them, so no task
    sorts more than one bucket even without a partition.
    """
    hashed = df.withColumn("__hash", hash_of(seed, F.col(key))).withColumn("__one", F.lit(1))
    bucket = F.conv(F.substring("__hash", 1, DIGITS), 16, 10).cast("int")
    ranked = prefix_sum(hashed, partition or [], [F.col("__hash"), F.col(key)], "__one", out, bucket)
    return ranked.drop("__hash", "__one").withColumn(out, (F.col(out) + 1).cast("long"))


def budget_trim(df: DataFrame, size: str, target: Column, seed: str, key: str, partition: list[str]) -> DataFrame:
    """Rows in hash order while the sizes before them sum to less than ``target``; the row that crosses it is kept."""
    hashed = df.withColumn("__hash", hash_of(seed, F.col(key)))
    bucket = F.conv(F.substring("__hash", 1, DIGITS), 16, 10).cast("int")
    summed = prefix_sum(hashed, partition, [F.col("__hash"), F.col(key)], size, "__before", bucket)
    return summed.where(F.col("__before") < target).drop("__hash", "__before")
