"""Packing ordered streams of items into windows of one size, and the targets inside a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.plans.scan import prefix_sum


def packed(docs: DataFrame, stream: list[str], order: Column, items: str, size: int, bucket: Column) -> DataFrame:
    """(stream, chunk_id, items): the streams' items in windows of exactly ``size``; a stream's rest is dropped.

    ``docs`` has one row per document with an array of items. Documents are laid out by a prefix sum of
    their lengths and sliced at window borders; what is shuffled is at most one slice per document and
    window, and one group is one window. Null and empty arrays take no room.
    """
    sized = docs.select(*stream, order.alias("__o"), bucket.alias("__bucket"), F.col(items).alias("__items"), F.coalesce(F.size(items), F.lit(0)).alias("__n")).where("__n > 0")
    laid = prefix_sum(sized, stream, [F.col("__o")], "__n", "__at", F.col("__bucket"))
    first, last = F.floor(F.col("__at") / size), F.floor((F.col("__at") + F.col("__n") - 1) / size)
    cut = laid.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk_id") * size - F.col("__at"), F.lit(0))
    end = F.least((F.col("chunk_id") + 1) * size - F.col("__at"), F.col("__n"))
    slices = cut.select(*stream, "chunk_id", F.col("__at").alias("at"), F.slice("__items", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    grouped = slices.groupBy(*stream, "chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    whole = grouped.select(*stream, "chunk_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias(items))
    return whole.where(F.size(items) == size)


def with_targets(windows: DataFrame, items: str, target, out: str = "targets") -> DataFrame:
    """``windows`` with the target of every slot but the last: ``target(item, next_item)``."""
    inputs = F.slice(items, 1, F.size(items) - 1)
    return windows.withColumn(out, F.transform(inputs, lambda x, i: target(x, F.element_at(items, i + 2))))


def routed_items(control: Column, tokens: Column, domain: Column, domain_index: Column) -> Column:
    """A span as items: its control token, then its tokens, each with its domain."""
    item = lambda t, c: F.struct(t.alias("token"), domain.alias("domain"), domain_index.alias("domain_index"), F.lit(c).alias("is_control"))
    return F.concat(F.array(item(control, True)), F.transform(tokens, lambda t: item(t, False)))
