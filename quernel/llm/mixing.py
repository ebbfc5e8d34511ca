"""Mixing slices to target weights by a low-discrepancy schedule (problem 5).

A shard is a row of slots of about ``BLOCK`` tokens. Slot k has the golden-ratio point frac(k * 0.618...),
which the cumulative target weights map to a slice; so every stretch of the shard holds the slices in about
their shares. A slice's documents, shuffled anew in every pass and passed over at most ``max_repeats`` times,
form one stream of tokens, cut into as many equal blocks as the slice has slots; the r-th slot takes the r-th
block. A slice that has too few tokens leaves its last slots empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.scan import prefix_sum
from quernel.session import checkpointed

BLOCK = 256
GOLDEN = 0.6180339887498949
#: Slots are ranked in runs of so many, and a slice's documents are summed in so many buckets.
RUN, BUCKETS = 4096, 256

KEY = ["shard_id", "source", "lang"]


def _key() -> Column:
    """A slice's key as one column; null parts are equal to each other, and joins need no null-safe conditions."""
    return F.struct(*KEY).alias("key")


def demands(slices: DataFrame, shards: DataFrame, docs: DataFrame) -> DataFrame:
    """Each slice with its number ``slice``, demand_tokens, its documents' true_tokens, available_tokens and the passes it needs.

    ``docs`` has shard_id, source, lang, doc_id, n_tokens. Null or negative weights, targets and repeats are 0.
    Documents without tokens are no supply. Repeated slice rows count once. The numbers hold for one evaluation.
    """
    supply = docs.where("n_tokens > 0").groupBy(_key()).agg(F.sum("n_tokens").alias("true_tokens"))
    wanted = (
        slices.select(_key(), "shard_id", "target_weight", "max_repeats")
        .join(shards.select("shard_id", "target_tokens"), "shard_id", "left")
        .select("key", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), F.greatest(F.coalesce("target_tokens", F.lit(0)), F.lit(0)).alias("target_tokens"))
    )
    both = wanted.join(supply, "key", "left").withColumn("true_tokens", F.coalesce("true_tokens", F.lit(0))).distinct()
    demand = F.col("target_weight") * F.col("target_tokens")
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("demand_tokens") / F.col("true_tokens")).cast("int"))
    return (
        both.select("key.*", "target_weight", "max_repeats", "target_tokens", "true_tokens")
        .withColumn("demand_tokens", demand)
        .withColumn("available_tokens", F.col("true_tokens") * F.col("max_repeats"))
        .withColumn("passes", F.when(F.col("true_tokens") > 0, passes).otherwise(0))
        .withColumn("slice", F.monotonically_increasing_id())
    )


def slots(wanted: DataFrame) -> DataFrame:
    """(slice, run, slots): the slots of every slice in each run of slots, ascending.

    A slice whose weight no point falls on isn't among them.
    """
    w = Window.partitionBy("shard_id").orderBy("source", "lang", "target_weight", "max_repeats", "target_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy("shard_id")
    shares = wanted.where("demand_tokens > 0").select("slice", *KEY, "target_tokens", (F.sum("target_weight").over(w) / F.sum("target_weight").over(total)).alias("high"))
    plan = shares.groupBy("shard_id").agg(
        F.sort_array(F.collect_list(F.struct("high", "source", "lang", "slice"))).alias("cuts"),
        F.ceil(F.max("target_tokens") / BLOCK).cast("long").alias("n"),
    )  # one entry per slice of the shard: the catalogue, not its documents
    cuts = F.transform("cuts", lambda c: F.struct(c["high"].alias("high"), c["slice"].alias("slice"))).alias("cuts")
    runs = plan.select("shard_id", cuts, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN).cast("long"))).alias("run"))
    point = lambda k: (k + 0.5) * GOLDEN - F.floor((k + 0.5) * GOLDEN)
    hit = lambda k: F.coalesce(F.element_at(F.filter("cuts", lambda c: point(k) < c["high"]), 1), F.element_at("cuts", -1))["slice"]
    each = F.transform(F.sequence(F.col("run") * RUN, F.least(F.col("n") - 1, F.col("run") * RUN + RUN - 1)), lambda k: F.struct(k.alias("slot"), hit(k).alias("slice")))
    # The runs of a large shard are spread before their slots are drawn, and counted where they were drawn.
    drawn = runs.repartition("shard_id", "run").select("shard_id", "run", F.inline(each))
    return drawn.groupBy("shard_id", "run", "slice").agg(F.sort_array(F.collect_list("slot")).alias("slots")).select("slice", "run", "slots")


def _placed(runs: DataFrame, sized: DataFrame) -> DataFrame:
    """(slice, rank, slot): every slot and its rank among its slice's, with one at the shard's end for a slice that drew none."""
    w = Window.partitionBy("slice").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("slice", "run", F.coalesce(F.sum(F.size("slots")).over(w), F.lit(0)).alias("before"))
    ranked = runs.join(before, ["slice", "run"]).select("slice", "before", F.posexplode("slots").alias("at", "slot"))
    tail = sized.where("demand_tokens > 0 AND drawn = 0").select("slice", F.lit(0).cast("long").alias("rank"), F.ceil(F.col("target_tokens") / BLOCK).cast("long").alias("slot"))
    return ranked.select("slice", (F.col("before") + F.col("at")).alias("rank"), "slot").unionByName(tail)


def schedule(slices: DataFrame, shards: DataFrame, docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The demands, and (slice, shard_id, slot, source, lang, doc_id, pass_num, from_token, n_tokens): what fills each slot.

    from_token counts from the document's start; a document that reaches over a block's end goes on in its
    slice's next slot. ``slice`` is the number of a slice in these demands. Slices and slots are each written
    once, so that no plan holds the whole chain of joins: what the driver needs for a plan grows with its length.
    """
    wanted = checkpointed(demands(slices, shards, docs))
    runs = checkpointed(slots(wanted))
    count = runs.groupBy("slice").agg(F.sum(F.size("slots")).alias("drawn"))
    sized = checkpointed(wanted.join(count, "slice", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))))
    n_slots = F.greatest(F.col("drawn"), F.lit(1))
    shuffled = F.xxhash64(F.lit(seed), F.col("pass_num"), F.col("doc_id"))
    fed = sized.where("passes > 0").select("slice", _key(), "demand_tokens", n_slots.alias("n_slots"), (F.col("demand_tokens") / n_slots).alias("block"), "passes")
    spread = (
        docs.where("n_tokens > 0").select(_key(), "doc_id", "n_tokens").join(fed, "key")
        .select("slice", "key.*", "doc_id", "n_tokens", "demand_tokens", "block", "n_slots", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass_num"))
        .withColumn("__h", shuffled)
    )
    bucket = F.col("pass_num") * BUCKETS + F.shiftright("__h", 56) + 128
    stream = prefix_sum(spread, ["slice"], [F.col("pass_num"), F.col("__h"), F.col("doc_id")], "n_tokens", "low", bucket).where(F.col("low") < F.floor(F.col("demand_tokens") + 1e-9))
    high = F.least(F.col("low") + F.col("n_tokens"), F.floor(F.col("demand_tokens") + 1e-9))
    edge = lambda r: F.when(r >= F.col("n_slots"), F.lit(2.0**53)).otherwise(r * F.col("block"))
    last = F.col("n_slots") - 1
    cut = stream.withColumn("high", high).select(
        "*", F.explode(F.sequence(F.least(F.floor(F.col("low") / F.col("block")), last), F.least(F.floor((F.col("high") - 1) / F.col("block")), last))).alias("rank")
    )
    # A block starts at the first whole token that is not before its share of the stream.
    first, after = F.greatest(F.col("low"), F.ceil(edge(F.col("rank")))), F.least(F.col("high"), F.ceil(edge(F.col("rank") + 1)))
    parts = cut.select("slice", *KEY, "rank", "doc_id", "pass_num", (first - F.col("low")).cast("long").alias("from_token"), (after - first).cast("long").alias("n_tokens")).where("n_tokens > 0")
    filled = parts.join(_placed(runs, sized), ["slice", "rank"])
    return sized, filled.select("slice", "shard_id", "slot", "source", "lang", "doc_id", "pass_num", "from_token", "n_tokens")


def mix_report(wanted: DataFrame, filled: DataFrame) -> DataFrame:
    """Each slice with demand_tokens, available_tokens, reached_tokens, and reached_fraction of its shard's tokens."""
    reached = filled.groupBy("slice").agg(F.sum("n_tokens").alias("reached_tokens"))
    rows = wanted.join(reached, "slice", "left").select(*KEY, "target_weight", "demand_tokens", "available_tokens", F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"))
    whole = F.sum("reached_tokens").over(Window.partitionBy("shard_id"))
    return rows.withColumn("reached_fraction", F.when(whole > 0, F.col("reached_tokens") / whole).otherwise(0.0))


def short_slices(report: DataFrame) -> DataFrame:
    """Slices whose schedule ended short of the demand, those checked exactly that are short by a part of a token only."""
    return report.where("reached_tokens < demand_tokens").where("available_tokens < demand_tokens").select(*KEY).distinct()
