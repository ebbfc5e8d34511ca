"""Ordered prefix sums that no single task carries, however hot one key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, bucket: Column) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before each row of the same ``keys``.

    ``order`` must start with ``bucket`` (an ascending integer), so that all rows of a bucket follow those of
    the bucket before. Sums inside buckets and sums of whole buckets are two scans: a key that holds a third
    of all rows is split over its buckets, and what one task sorts is a bucket, or the list of a key's
    buckets. Null values count as 0.
    """
    spread = df.withColumn("__b", bucket).withColumn("__v", F.coalesce(F.col(value), F.lit(0)))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = spread.groupBy(*keys, "__b").agg(F.sum("__v").alias("__whole"))
    before = whole.withColumn("__before", F.coalesce(F.sum("__whole").over(across), F.lit(0))).drop("__whole")
    local = spread.withColumn("__local", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    same = F.lit(True)
    for key in [*keys, "__b"]:
        left, right = F.col(f"l.{key}"), F.col(f"r.{key}")
        # A null-safe condition costs another shuffle, as it hides how the rows lie; it is for keys that can be null.
        same = same & (left.eqNullSafe(right) if spread.schema[key].nullable else left == right)
    joined = local.alias("l").join(before.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l.__local") + F.coalesce(F.col("r.__before"), F.lit(0))).alias(out))


def neighbour(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, bucket: Column, ahead: bool = False) -> DataFrame:
    """``df`` with ``out``, the ``value`` of the row before each row of the same ``keys`` (after it, if ``ahead``).

    ``order`` must start with ``bucket``, as in ``prefix_sum``: neighbours are found inside buckets, and the
    bucket's edge gets its neighbour from a list of the key's buckets. First (last) rows get null.
    """
    spread = df.withColumn("__b", bucket)
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("__b")
    near = spread.withColumn("__near", step(F.struct(value)).over(inside))
    ends = spread.groupBy(*keys, "__b").agg(edge(F.struct(value), F.struct(*order)).alias("__end"))
    border = ends.withColumn("__over", step("__end").over(across)).drop("__end")
    same = F.lit(True)
    for key in [*keys, "__b"]:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = near.alias("l").join(border.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(F.col("l.__near"), F.col("r.__over"))[value].alias(out))
