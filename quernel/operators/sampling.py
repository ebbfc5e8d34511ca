"""Splits, balances, interleavings and draws, all ordered by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.ordering import hash_of, hash_ranked, uniform
from quernel.plans.scan import prefix_sum


def split(df: DataFrame, key: str, fraction: float, seed: str, partition: list[str] | None = None) -> DataFrame:
    """``df`` with ``part``: ``val`` for the hash order's first max(1, floor(n * fraction)) rows, else ``train``."""
    partition = partition or []
    ranked = hash_ranked(df, seed, key, partition, "__rank")
    sizes = df.groupBy(*partition).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("__n"))
    joined = ranked.join(sizes, partition) if partition else ranked.crossJoin(F.broadcast(sizes))  # one row per group, or one
    return joined.withColumn("part", F.when(F.col("__rank") <= F.col("__n"), "val").otherwise("train")).drop("__rank", "__n")


def balanced(df: DataFrame, size: str, group: str, side: str, key: str, seed: str) -> DataFrame:
    """Each group's two sides trimmed to the smaller side's size; groups with an empty side are left out.

    Sides are summed first, so only two numbers per group are joined back.
    """
    totals = df.groupBy(group, side).agg(F.sum(size).alias("__total"))
    least = totals.where("__total > 0").groupBy(group).agg(F.min("__total").alias("__target"), F.count(F.lit(1)).alias("__sides")).where("__sides > 1")
    hashed = df.join(least.select(group, "__target"), group).withColumn("__hash", hash_of(seed, F.col(key)))
    bucket = F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int")
    summed = prefix_sum(hashed, [group, side], [F.col("__hash"), F.col(key)], size, "__before", bucket)
    return summed.where("__before < __target").drop("__hash", "__before", "__target")


def round_robin(df: DataFrame, stream: str, stream_order: str, order: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``turn`` (each stream's own count) and the global place ``seq`` of the interleaving.

    A stream that is exhausted drops out. ``bucket``, ascending with ``order``, splits a long stream's count. The place needs no global sort: it is the number of rows of
    earlier turns, known from the streams' lengths, plus those of the same turn and earlier streams.
    """
    ones = df.withColumn("__one", F.lit(1))
    counted = prefix_sum(ones, [stream], [F.col(order)], "__one", "__before", F.lit(0) if bucket is None else bucket)
    turned = counted.withColumn("turn", (F.col("__before") + 1).cast("long")).drop("__one", "__before")
    lengths = df.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.first(stream_order).alias("o"))
    plan = lengths.agg(F.collect_list(F.struct("n", "o")).alias("plan"))  # one entry per stream
    placed = turned.crossJoin(F.broadcast(plan))
    earlier = F.aggregate("plan", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], F.col("turn") - 1))
    same = F.aggregate("plan", F.lit(0).cast("long"), lambda a, x: a + F.when((x["n"] >= F.col("turn")) & (x["o"] < F.col(stream_order)), 1).otherwise(0))
    return placed.withColumn("seq", earlier + same + 1).drop("plan")


def weighted_draws(weights: DataFrame, group: str, item: str, weight: str, draws: int, seed: str) -> DataFrame:
    """(group, draw, item): for every group the item that a hash-uniform point of each draw falls on."""
    w = Window.partitionBy(group).orderBy(item)
    cuts = weights.withColumn("high", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(group)))
    table = cuts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("high", item))).alias("cuts"))  # the catalogue of a group
    each = table.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", uniform(seed, F.col(group), F.col("draw")))
    hit = F.coalesce(F.element_at(F.filter("cuts", lambda c: F.col("u") < c["high"]), 1), F.element_at("cuts", -1))
    return each.select(group, "draw", hit[item].alias(item))


def sized_samples(df: DataFrame, weights: DataFrame, by: str, weight: str, n: int, key: str, seed: str) -> DataFrame:
    """Of each ``by`` the first round(n * weight) rows in hash order."""
    ranked = hash_ranked(df, seed, key, [by], "__rank")
    return ranked.join(weights.select(by, F.round(F.col(weight) * n).alias("__most")), by).where("__rank <= __most").drop("__rank", "__most")


def cyclic(df: DataFrame, n: Column, draws: DataFrame, rank: str = "rank") -> DataFrame:
    """``draws`` (with ``k``) joined to the row whose rank is k modulo ``n``, starting over when a pass ends."""
    return draws.withColumn(rank, F.pmod(F.col("k"), n) + 1).join(df, rank)
