"""Ordered series: smoothing, even downsampling, folds with state, gaps.

A fold needs its series in order; a series is one run's or arm's log, whose length is bounded by the steps of
one training run, not by the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.scan import neighbour


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, half: int, out: str) -> DataFrame:
    """``out``: the centred mean over ``half`` rows on each side, fewer at the ends."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def downsampled(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` evenly spread rows of each series, first and last among them.

    Row i is kept if some j in 0..k-1 has round(j * (n - 1) / (k - 1)) = i, half to even.
    """
    w = Window.partitionBy(*keys)
    placed = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    j = F.floor(F.col("__i") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.lit(False)
    for step in (-1, 0, 1):
        c = j + step
        hit = hit | ((c >= 0) & (c <= k - 1) & (F.bround(c * (F.col("__n") - 1) / F.lit(float(k - 1)), 0) == F.col("__i")))
    return placed.where((F.col("__n") <= k) | hit).drop("__i", "__n")


def _ordered(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v")))).alias("xs"))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, beta: float, out: str = "ema") -> DataFrame:
    """(keys, out): the exponential mean of each series, started at its first value."""
    fold = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1))), F.element_at("xs", 1)["v"], lambda a, x: a * beta + x["v"] * (1 - beta))
    return _ordered(df, keys, order, value).select(*keys, F.when(F.size("xs") == 1, F.element_at("xs", 1)["v"]).otherwise(fold).alias(out))


def controlled(df: DataFrame, keys: list[str], order: list[str], value: str, patience: int = 200, beta: float = 0.98) -> DataFrame:
    """(keys, scale, skipped, ema): the learning-rate controller run over each series.

    A value that isn't finite, or above three times the mean of the last 50 kept values once 25 are kept, is
    skipped. Otherwise the exponential mean is updated; where it improves the scale grows by 2 %, else it
    shrinks by 2 %, and after ``patience`` values without a new best it is halved; it stays in [0.1, 3].
    """
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0).cast("long").alias("skipped"), F.lit(None).cast("double").alias("ema"), F.lit(None).cast("double").alias("best"), F.lit(0).cast("long").alias("since"), F.array().cast("array<double>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        v = x["v"]
        mean = F.aggregate(a["kept"], F.lit(0.0), lambda s, y: s + y) / F.size(a["kept"])
        skip = v.isNull() | F.isnan(v) | (v == float("inf")) | ((F.size(a["kept"]) >= 25) & (v > 3 * mean))
        new = F.when(a["ema"].isNull(), v).otherwise(a["ema"] * beta + v * (1 - beta))
        better = a["best"].isNull() | (new < a["best"])
        since = F.when(better, F.lit(0).cast("long")).otherwise(a["since"] + 1)
        plateau = since >= patience
        scale = F.when(better, a["scale"] * 1.02).otherwise(a["scale"] * 0.98)
        scale = F.least(F.lit(3.0), F.greatest(F.lit(0.1), F.when(plateau, a["scale"] * 0.5).otherwise(scale)))
        kept = F.slice(F.concat(a["kept"], F.array(v)), F.greatest(F.size(a["kept"]) + 1 - 49, F.lit(1)), F.lit(50))
        moved = F.struct(scale.alias("scale"), a["skipped"].alias("skipped"), new.alias("ema"), F.when(better, new).otherwise(a["best"]).alias("best"), F.when(plateau, F.lit(0).cast("long")).otherwise(since).alias("since"), kept.alias("kept"))
        stayed = F.struct(a["scale"].alias("scale"), (a["skipped"] + 1).alias("skipped"), a["ema"].alias("ema"), a["best"].alias("best"), a["since"].alias("since"), a["kept"].alias("kept"))
        return F.when(skip, stayed).otherwise(moved)

    return _ordered(df, keys, order, value).select(*keys, F.aggregate("xs", start, step).alias("s")).select(*keys, "s.scale", "s.skipped", "s.ema")


def gaps(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """(keys, ts, gap_s): rows that come more than ``seconds`` after the one before them; a key's days are scanned apart."""
    timed = df.select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"))
    day = F.floor(F.col("__at") / 86_400_000_000).cast("int")
    told = neighbour(timed, keys, [F.col("__at")], "__at", "__before", day).withColumn("__gap", F.col("__at") - F.col("__before"))
    return told.where(F.col("__gap") > seconds * 1_000_000).select(*keys, ts, F.round(F.col("__gap") / 1e6, 3).alias("gap_s"))
