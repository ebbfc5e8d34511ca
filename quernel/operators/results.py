"""The results store: upserts, latest records, status cycles, run catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with the rows of ``new`` in the place of those of the same keys (the whole row is replaced)."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merged(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upserted``, but fields that are null in ``new`` keep the store's value."""
    a, b = store.alias("a"), new.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "full").select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in store.columns])


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the greatest ``order``; partial maxima are taken before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r"))
    return best.select("r.*")


def status_cycle(current: DataFrame, previous: DataFrame, done: DataFrame, key: str = "arm", step: str = "step") -> DataFrame:
    """One refresh of the status table.

    Readings of the same key keep the largest step; a step never falls below the previous one; keys that
    aren't seen are carried forward; keys already evaluated at their step or later are dropped.
    """
    seen = current.groupBy(key).agg(F.max(step).alias(step))
    both = seen.alias("c").join(previous.select(key, step).alias("p"), key, "full").select(key, F.greatest(F.col(f"c.{step}"), F.col(f"p.{step}")).alias(step))
    evaluated = done.groupBy(key).agg(F.max(step).alias("__done"))
    return both.join(evaluated, key, "left").where(F.col("__done").isNull() | (F.col(step) > F.col("__done"))).drop("__done")


def ancestry(runs: DataFrame, run: str = "arm", parent: str = "parent", most: int = 50) -> DataFrame:
    """(run, ancestor, depth): the chain of parents of every run. The catalogue of runs is a small table; cycles end at ``most``."""
    level = runs.where(F.col(parent).isNotNull()).select(F.col(run).alias("run"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for depth in range(2, most + 1):
        level = level.alias("l").join(runs.alias("r"), F.expr(f"l.ancestor = r.{run}")).where(F.col(f"r.{parent}").isNotNull()).select("l.run", F.col(f"r.{parent}").alias("ancestor"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
