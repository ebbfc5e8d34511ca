"""The mixing plan's length, which the driver's memory follows, and slices that are stated more than once."""

from pyspark.sql import functions as F

from quernel.llm import mixing as M

SLICE = "shard_id long, source string, lang string, target_weight double, max_repeats int"
SHARD = "shard_id long, target_tokens long"
DOC = "doc_id long, shard_id long, source string, lang string, n_tokens long"


def frames(spark, slices, shards, docs):
    return spark.createDataFrame(slices, SLICE), spark.createDataFrame(shards, SHARD), spark.createDataFrame(docs, DOC)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_short(spark):
    tables = frames(spark, [(1, "a", "en", 0.6, 2), (1, None, "en", 0.4, 1)], [(1, 900)], [(1, 1, "a", "en", 300), (2, 1, None, "en", 500)])
    report = M.mix_report(*M.schedule(*tables))
    # Long chains of joins took more than the driver's memory, whatever the tables held.
    assert plan(report).count("Exchange ") <= 16
    assert plan(report).count("isnull(") == 0
    assert [(r.source, r.reached_tokens) for r in report.orderBy(F.desc("source")).collect()] == [("a", 540), (None, 360)]


def test_a_slice_stated_twice_is_two_demands(spark):
    slices = [(1, "a", "en", 0.5, 1), (1, "a", "en", 0.1, 8), (1, "b", "en", 0.4, 9)]
    wanted, filled = M.schedule(*frames(spark, slices, [(1, 10_000)], [(1, 1, "a", "en", 600), (2, 1, "b", "en", 3_000)]))
    report = M.mix_report(wanted, filled)
    got = sorted((r.source, r.target_weight, r.available_tokens, r.reached_tokens) for r in report.collect())
    assert got == [("a", 0.1, 4_800, 1_000), ("a", 0.5, 600, 600), ("b", 0.4, 27_000, 4_000)]
    assert [tuple(r) for r in M.short_slices(report).collect()] == [(1, "a", "en")]


def test_keys_of_other_widths_meet(spark):
    slices, shards, docs = frames(spark, [(1, "a", None, 1.0, 1)], [(1, 100)], [(1, 1, "a", None, 300)])
    narrow = slices.withColumn("shard_id", F.col("shard_id").cast("int"))
    assert [r.reached_tokens for r in M.mix_report(*M.schedule(narrow, shards, docs)).collect()] == [100]
