"""Evaluation over predictions. A unigram model stands in for a network: its nats come from counts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.metrics import LN2, calibration_bin
from quernel.functions.text import alpha_words


def unigram_scores(docs: DataFrame, *by: Column) -> DataFrame:
    """(domain, word, *by, n, nll, pred, correct, confidence): the words scored under their domain's counts.

    The prediction is the domain's most frequent word, its confidence the word's count over that word's. Words that
    agree in ``by`` (expressions over doc_id and pos) are one row of weight ``n``: counting comes before any join, within
    tasks first, so that a word that a third of all places hold is a few rows when it meets its domain's counts.
    """
    words = docs.select("doc_id", F.coalesce("domain", F.lit("none")).alias("domain"), F.posexplode(alpha_words(F.col("text"))).alias("pos", "word"))
    counts = words.groupBy("domain", "word", *by).agg(F.count(F.lit(1)).alias("n"))
    per_word = counts.groupBy("domain", "word").agg(F.sum("n").alias("held"))
    totals = per_word.groupBy("domain").agg(F.sum("held").alias("total"), F.max_by("word", F.struct("held", "word")).alias("pred"), F.max("held").alias("most"))
    scored = per_word.join(totals, "domain").select("domain", "word", (-F.log(F.col("held") / F.col("total"))).alias("nll"), "pred", (F.col("held") / F.col("most")).alias("confidence"))
    return counts.join(scored, ["domain", "word"]).withColumn("correct", F.col("word") == F.col("pred"))


def weighted_mean(value: str | Column, where: Column | None = None) -> Column:
    """The mean of ``value`` over rows that stand for ``n`` each."""
    value = F.col(value) if isinstance(value, str) else value
    n = F.col("n") if where is None else F.when(where, F.col("n"))
    return F.sum(value * n) / F.nullif(F.sum(n), F.lit(0))


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with a weight ``n``: each stands for itself where they have none."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))


def by_domain_and_overall(rows: DataFrame, *measures: Column) -> DataFrame:
    """The measures per domain and over all rows (domain null), from one pass of grouping sets."""
    return rows.groupingSets([["domain"], []], "domain").agg(*measures)


def routed_bundle(scores: DataFrame) -> DataFrame:
    """Loss, boundary and interior loss, switch accuracy and counts of ``unigram_scores`` by is_switch and is_boundary."""
    return weighted(scores).agg(
        F.round(weighted_mean("nll"), 6).alias("loss"),
        F.round(weighted_mean("nll", F.col("is_boundary")), 6).alias("boundary_loss"),
        F.round(weighted_mean("nll", ~F.col("is_boundary")), 6).alias("interior_loss"),
        F.round(weighted_mean(F.col("correct").cast("double"), F.col("is_switch")), 6).alias("switch_accuracy"),
        F.coalesce(F.sum(F.when(F.col("is_switch"), F.col("n"))), F.lit(0)).alias("n_switches"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )


def calibration_error(scores: DataFrame) -> DataFrame:
    """(domain, ece): weighted gaps between mean confidence and accuracy over equal-width bins."""
    bins = weighted(scores).groupBy("domain", calibration_bin(F.col("confidence")).alias("bin")).agg(weighted_mean("confidence").alias("c"), weighted_mean(F.col("correct").cast("double")).alias("a"), F.sum("n").alias("n"))
    return bins.groupBy("domain").agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


def bits_per_byte_by_domain(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """(domain, bpb, ppl): nats of the words over the bytes of the documents that hold them; null is all."""
    nats = weighted(scores).groupBy("domain").agg(F.sum(F.col("nll") * F.col("n")).alias("nats"), F.sum("n").alias("n"))
    sizes = docs.where("text is not null").groupBy(F.coalesce("domain", F.lit("none")).alias("domain")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    joined = nats.join(sizes, "domain")
    return by_domain_and_overall(joined, F.round(F.sum("nats") / LN2 / F.sum("bytes"), 6).alias("bpb"), F.round(F.exp(F.sum("nats") / F.sum("n")), 3).alias("ppl"))


def cloze_items(items: DataFrame) -> DataFrame:
    """(item_id, suite, context, answer, guess, rank): cloze items with the suite's most frequent answer as the guess."""
    told = items.where("target is not null").select("item_id", "suite", F.lower("text").alias("context"), F.lower("target").alias("answer"))
    counts = told.groupBy("suite", "answer").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("suite").orderBy(F.desc("n"), "answer")).cast("long"))
    best = ranked.where("rank = 1").select("suite", F.col("answer").alias("guess"))
    return told.join(ranked.select("suite", "answer", "rank"), ["suite", "answer"]).join(best, "suite").select("item_id", "suite", "context", "answer", "guess", "rank")


def cloze_errors(items: DataFrame) -> DataFrame:
    """``items`` with the first fitting class: correct, copy_failure, near_miss or other."""
    copied = F.expr("instr(context, concat(answer, ' ')) > 0")
    return items.withColumn("error", F.when(F.col("answer") == F.col("guess"), "correct").when(copied, "copy_failure").when(F.col("rank") <= 5, "near_miss").otherwise("other"))
