"""Evaluation aggregates, diagnostics and loss formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import metrics as M
from quernel.operators import evaluation as E
from quernel.operators.quality import STOPWORDS
from quernel.plans.scan import neighbour
from quernel.session import table

WORDS = "SELECT doc_id, coalesce(domain, 'none') AS domain, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, domain, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)"
PREDICTIONS = f"""WITH words AS ({WORDS}), counts AS (SELECT domain, word, count(*) AS n FROM words GROUP BY ALL), totals AS (SELECT domain, sum(n) AS total, arg_max(word, (n, word)) AS pred, max(n) AS most FROM counts GROUP BY domain)
    SELECT doc_id, domain, pos, word, -ln(n::DOUBLE / total) AS nll, pred, word = pred AS correct, n::DOUBLE / most AS confidence, pos = 0 AS is_switch FROM words JOIN counts USING (domain, word) JOIN totals USING (domain)"""
CLOZE = """WITH told AS (SELECT item_id, suite, lower(text) AS context, lower(target) AS answer FROM eval_item WHERE target IS NOT NULL), ranked AS (SELECT suite, answer, row_number() OVER (PARTITION BY suite ORDER BY count(*) DESC, answer) AS rank FROM told GROUP BY suite, answer)
    SELECT item_id, suite, context, answer, (SELECT answer FROM ranked b WHERE b.suite = told.suite AND rank = 1) AS guess, rank FROM told JOIN ranked USING (suite, answer)"""
ERRORS = f"SELECT *, CASE WHEN answer = guess THEN 'correct' WHEN contains(context, answer || ' ') THEN 'copy_failure' WHEN rank <= 5 THEN 'near_miss' ELSE 'other' END AS error FROM ({CLOZE})"
CE = "mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) - z[label + 1]"
LOGITS = "SELECT vec_id, label, z, list_max(z) AS mx FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10) AS z FROM embeddings)"


def scores(s, d, *by):
    known = {"is_switch": F.col("pos") == 0, "is_boundary": F.col("pos") < 8, "mode": F.when(F.pmod("doc_id", F.lit(2)) == 0, "single").otherwise("mixed")}
    return E.unigram_scores(table(s, d, "documents"), *[known[b].alias(b) for b in by])


def logits(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("z"))


def losses(s, d):
    return logits(s, d).select("vec_id", "label", "z", M.cross_entropy(F.col("z"), F.col("label")).alias("ce"))


ALL = f"SELECT vec_id, label, z, {CE} AS ce FROM ({LOGITS})"


def with_elapsed(s, d):
    return table(s, d, "history").where("loss is not null and not isnan(loss)").select("run_id", "arm", "step", "loss").distinct()


HISTORY = "SELECT DISTINCT run_id, arm, step, loss FROM history WHERE loss IS NOT NULL AND NOT isnan(loss)"

QUERIES = {
    "a11_loss_by_domain": (
        lambda s, d: E.by_domain_and_overall(scores(s, d), F.round(E.weighted_mean("nll"), 6).alias("loss"), F.sum("n").alias("n")),
        f"SELECT domain, round(avg(nll), 6) AS loss, count(*) AS n FROM ({PREDICTIONS}) GROUP BY GROUPING SETS ((domain), ())",
    ),
    "a13_bits_per_byte": (
        lambda s, d: E.bits_per_byte_by_domain(scores(s, d), table(s, d, "documents")),
        f"""SELECT domain, round(sum(nats) / ln(2.0::DOUBLE) / sum(bytes), 6) AS bpb, round(exp(sum(nats) / sum(n)), 3) AS ppl FROM (SELECT domain, sum(nll) AS nats, count(*) AS n FROM ({PREDICTIONS}) GROUP BY domain)
        JOIN (SELECT coalesce(domain, 'none') AS domain, sum(octet_length(encode(text))) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL) USING (domain) GROUP BY GROUPING SETS ((domain), ())""",
    ),
    "a14_switch_accuracy": (
        lambda s, d: scores(s, d, "is_switch").where("is_switch").groupBy("domain").agg(F.round(E.weighted_mean(F.col("correct").cast("double")), 6).alias("accuracy"), F.sum("n").alias("n")),
        f"SELECT domain, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM ({PREDICTIONS}) WHERE is_switch GROUP BY domain",
    ),
    "a15_boundary_loss": (
        lambda s, d: scores(s, d, "is_boundary").groupBy("is_boundary").agg(F.round(E.weighted_mean("nll"), 6).alias("loss"), F.sum("n").alias("n")),
        f"SELECT pos < 8 AS is_boundary, round(avg(nll), 6) AS loss, count(*) AS n FROM ({PREDICTIONS}) GROUP BY ALL",
    ),
    "a16_exact_match": (
        lambda s, d: E.cloze_items(table(s, d, "eval_item")).groupBy("suite").agg(F.round(F.avg((F.col("answer") == F.col("guess")).cast("double")), 6).alias("exact_match"), F.count(F.lit(1)).alias("n")),
        f"SELECT suite, round(avg(CAST(answer = guess AS DOUBLE)), 6) AS exact_match, count(*) AS n FROM ({CLOZE}) GROUP BY suite",
    ),
    "a17_stopword_filtered_match": (
        lambda s, d: (lambda t: t.join(t.where(~F.col("answer").isin(STOPWORDS)).groupBy("suite", "answer").agg(F.count(F.lit(1)).alias("c")).groupBy("suite").agg(F.min_by("answer", F.struct(-F.col("c"), F.col("answer"))).alias("kept")), "suite").groupBy("suite").agg(F.round(F.avg((F.col("answer") == F.col("kept")).cast("double")), 6).alias("exact_match")))(
            E.cloze_items(table(s, d, "eval_item")).select("suite", "answer")
        ),
        f"""SELECT suite, round(avg(CAST(answer = kept AS DOUBLE)), 6) AS exact_match FROM ({CLOZE}) JOIN (SELECT suite, arg_min(answer, (-c, answer)) AS kept FROM (SELECT suite, answer, count(*) AS c FROM ({CLOZE}) WHERE answer NOT IN ({", ".join(repr(w) for w in STOPWORDS)}) GROUP BY ALL) GROUP BY suite) USING (suite) GROUP BY suite""",
    ),
    "a18_target_perplexity": (
        lambda s, d: scores(s, d).groupBy("domain").agg(F.round(M.perplexity(F.sum(F.col("nll") * F.col("n")), F.sum("n")), 3).alias("ppl"), F.round(E.weighted_mean("nll") / M.LN2, 6).alias("bits")),
        f"SELECT domain, round(exp(sum(nll) / count(*)), 3) AS ppl, round(sum(nll) / ln(2.0::DOUBLE) / count(*), 6) AS bits FROM ({PREDICTIONS}) GROUP BY domain",
    ),
    "a19_single_word_coverage": (
        lambda s, d: table(s, d, "eval_item").where("target is not null").join(table(s, d, "token_vocab").select(F.trim("piece").alias("target")).distinct().withColumn("hit", F.lit(1.0)), "target", "left").groupBy("suite").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("coverage")),
        "SELECT suite, round(avg(CASE WHEN target IN (SELECT trim(piece) FROM token_vocab) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS coverage FROM eval_item WHERE target IS NOT NULL GROUP BY suite",
    ),
    "a20_error_shares": (
        lambda s, d: E.cloze_errors(E.cloze_items(table(s, d, "eval_item"))).where("error <> 'correct'").groupBy("suite", "error").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("suite")), 6)),
        f"SELECT suite, error, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY suite), 6) AS share FROM ({ERRORS}) WHERE error <> 'correct' GROUP BY suite, error",
    ),
    "a20_error_examples": (
        lambda s, d: E.cloze_errors(E.cloze_items(table(s, d, "eval_item"))).withColumn("r", F.row_number().over(Window.partitionBy("error").orderBy("item_id"))).where("r <= 5").select("error", "item_id", "answer"),
        f"SELECT error, item_id, answer FROM ({ERRORS}) QUALIFY row_number() OVER (PARTITION BY error ORDER BY item_id) <= 5",
    ),
    "a21_calibration_error": (
        lambda s, d: E.calibration_error(scores(s, d)),
        f"""SELECT domain, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT domain, floor(least(confidence, 0.9999) * 10) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM ({PREDICTIONS}) GROUP BY ALL) GROUP BY domain""",
    ),
    "f11_switch_and_content": (
        lambda s, d: scores(s, d, "is_switch").groupBy("domain", "is_switch").agg(F.sum("n").alias("n")),
        f"SELECT domain, is_switch, count(*) AS n FROM ({PREDICTIONS}) GROUP BY ALL",
    ),
    "f13_bounded_targets": (
        lambda s, d: logits(s, d).where("label < 6").groupBy("label").agg(F.count(F.lit(1)).alias("n")),
        "SELECT label, count(*) AS n FROM embeddings WHERE label < 6 GROUP BY label",
    ),
    "e3_bits_per_byte_by_mode": (
        lambda s, d: (lambda p, b: p.groupBy("mode").agg(F.sum(F.col("nll") * F.col("n")).alias("nats")).join(b, "mode").select("mode", F.round(F.col("nats") / M.LN2 / F.col("bytes"), 6).alias("bpb")))(
            scores(s, d, "mode"),
            table(s, d, "documents").where("text is not null").groupBy(F.when(F.pmod("doc_id", F.lit(2)) == 0, "single").otherwise("mixed").alias("mode")).agg(F.sum(F.octet_length("text")).alias("bytes")),
        ),
        f"""SELECT mode, round(nats / ln(2.0::DOUBLE) / bytes, 6) AS bpb FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'mixed' END AS mode, sum(nll) AS nats FROM ({PREDICTIONS}) GROUP BY ALL)
        JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'mixed' END AS mode, sum(octet_length(encode(text))) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL) USING (mode)""",
    ),
    "e8_switch_events": (
        lambda s, d: neighbour(table(s, d, "documents").select("shard_id", "doc_id", F.coalesce("domain", F.lit("none")).alias("domain")), ["shard_id"], [F.col("doc_id")], "domain", "before", F.floor(F.col("doc_id") / 4096).cast("int"))
        .where("before <> domain").groupBy("before", "domain").agg(F.count(F.lit(1)).alias("n")),
        "SELECT before, domain, count(*) AS n FROM (SELECT coalesce(domain, 'none') AS domain, lag(coalesce(domain, 'none')) OVER (PARTITION BY shard_id ORDER BY doc_id) AS before FROM documents) WHERE before <> domain GROUP BY ALL",
    ),
    "a33_held_out_cross_entropy": (
        lambda s, d: scores(s, d, "is_switch").where("not is_switch").agg(F.round(E.weighted_mean("nll"), 6).alias("ce"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        f"SELECT round(sum(nll) / count(*), 6) AS ce, count(*) AS n FROM ({PREDICTIONS}) WHERE NOT is_switch",
    ),
    "a34_cost_extrapolation": (
        lambda s, d: table(s, d, "history").groupBy("arm").agg((F.sum("elapsed") / F.sum(F.lit(50))).alias("x")).select("arm", F.round(F.col("x") * 150_000 / 3600, 4).alias("hours"), F.round(F.col("x") * 150_000 / 3600 * 0.59, 4).alias("dollars")),
        "SELECT arm, round(x * 150000 / 3600, 4) AS hours, round(x * 150000 / 3600 * 0.59, 4) AS dollars FROM (SELECT arm, sum(elapsed) / sum(50) AS x FROM history GROUP BY arm)",
    ),
    "c5_error_taxonomy": (
        lambda s, d: E.cloze_errors(E.cloze_items(table(s, d, "eval_item"))).select("item_id", "error"),
        f"SELECT item_id, error FROM ({ERRORS})",
    ),
    "e1_metric_functions": (
        lambda s, d: with_elapsed(s, d).select("run_id", "arm", "step", F.round(M.bits_per_byte(F.col("loss") * 100, F.col("step")), 6).alias("bpb"), F.round(M.perplexity(F.col("loss") * 10, F.lit(10)), 3).alias("ppl")),
        f"SELECT run_id, arm, step, round(loss * 100 / ln(2.0::DOUBLE) / greatest(step, 1), 6) AS bpb, round(exp(loss * 10 / 10), 3) AS ppl FROM ({HISTORY})",
    ),
    "e2_routed_bundle": (
        lambda s, d: E.routed_bundle(scores(s, d, "is_switch", "is_boundary")),
        f"""SELECT round(avg(nll), 6) AS loss, round(avg(nll) FILTER (pos < 8), 6) AS boundary_loss, round(avg(nll) FILTER (pos >= 8), 6) AS interior_loss, round(avg(CAST(correct AS DOUBLE)) FILTER (is_switch), 6) AS switch_accuracy,
        CAST(count_if(is_switch) AS BIGINT) AS n_switches, count(*) AS n FROM ({PREDICTIONS})""",
    ),
    "e4_cloze_report": (
        lambda s, d: E.cloze_items(table(s, d, "eval_item")).groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == F.col("guess")).alias("n_correct"), F.round(F.avg("rank"), 6).alias("mean_rank")),
        f"SELECT suite, count(*) AS n, CAST(count_if(answer = guess) AS BIGINT) AS n_correct, round(avg(rank), 6) AS mean_rank FROM ({CLOZE}) GROUP BY suite",
    ),
    "l1_cross_entropy": (lambda s, d: losses(s, d).select("vec_id", F.round("ce", 6).alias("ce")), f"SELECT vec_id, round(ce, 6) AS ce FROM ({ALL})"),
    "l2_switch_weighted": (
        lambda s, d: losses(s, d).agg(F.round(F.sum(M.switch_weighted(F.col("ce"), F.col("label") == 0)) / F.count(F.lit(1)), 6).alias("loss")),
        f"SELECT round(sum(ce * CASE WHEN label = 0 THEN 50.0::DOUBLE ELSE 1.0 END) / count(*), 6) AS loss FROM ({ALL})",
    ),
    "l3_focal_by_label": (
        lambda s, d: (lambda x: x.agg(F.round(F.avg("m"), 6).alias("loss")))(losses(s, d).groupBy("label").agg(F.avg(M.focal(F.col("ce"))).alias("m"))),
        f"SELECT round(avg(m), 6) AS loss FROM (SELECT label, avg(pow(1 - exp(-ce), 2.0) * ce) AS m FROM ({ALL}) GROUP BY label)",
    ),
    "l4_confidence_bce": (
        lambda s, d: scores(s, d).groupBy("domain").agg(F.round(E.weighted_mean(M.confidence_bce(F.col("confidence"), F.col("correct"))), 5).alias("bce")),
        f"SELECT domain, round(avg(-CASE WHEN correct THEN ln(least(greatest(confidence, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)) ELSE ln(1 - least(greatest(confidence, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)) END), 5) AS bce FROM ({PREDICTIONS}) GROUP BY domain",
    ),
    "l6_split_means": (
        lambda s, d: losses(s, d).agg(F.round(F.avg(F.when(F.col("label") == 0, F.col("ce"))), 6).alias("switch_loss"), F.round(F.avg(F.when(F.col("label") != 0, F.col("ce"))), 6).alias("content_loss")),
        f"SELECT round(avg(ce) FILTER (label = 0), 6) AS switch_loss, round(avg(ce) FILTER (label <> 0), 6) AS content_loss FROM ({ALL})",
    ),
    "l7_uncertainty_weighting": (
        lambda s, d: losses(s, d).groupBy("label").agg(F.avg("ce").alias("m")).select("label", F.round(M.uncertainty_weighted(F.col("m"), F.lit(0.1) + F.col("label") * 0.1), 6).alias("loss")),
        f"SELECT label, round(m / (2 * (0.1::DOUBLE + label * 0.1::DOUBLE) * (0.1::DOUBLE + label * 0.1::DOUBLE)) + ln(0.1::DOUBLE + label * 0.1::DOUBLE), 6) AS loss FROM (SELECT label, avg(ce) AS m FROM ({ALL}) GROUP BY label)",
    ),
    "l8_rebased_targets": (
        lambda s, d: logits(s, d).where("label >= 6").select("vec_id", F.round(M.cross_entropy(F.slice("z", 7, 4), F.col("label") - 6), 6).alias("ce")),
        "SELECT vec_id, round(mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) - z[label - 5], 6) AS ce FROM (SELECT vec_id, label, z, list_max(z) AS mx FROM (SELECT vec_id, label, list_transform(list_slice(embedding, 7, 10), lambda x: x::DOUBLE * 10) AS z FROM embeddings WHERE label >= 6))",
    ),
    "l9_margin": (
        lambda s, d: logits(s, d).select("vec_id", F.round(M.margin(F.col("z"), F.col("label")), 6).alias("loss")),
        f"SELECT vec_id, round(greatest(0.0::DOUBLE, 0.5 - z[label + 1] + list_max(list_concat(list_slice(z, 1, label), list_slice(z, label + 2, 64)))), 6) AS loss FROM ({LOGITS})",
    ),
    "l12_expert_routing": (
        lambda s, d: logits(s, d).select("vec_id", F.posexplode(M.softmax(F.transform(F.slice("z", 1, 8), lambda z, i: z + F.when(i == 7, -20.0).otherwise(0.0)))).alias("expert", "p"))
        .withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("p"), "expert"))).where("r <= 2").withColumn("gate", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("vec_id")), 6)).select("vec_id", F.col("expert").cast("long").alias("expert"), "gate"),
        """SELECT vec_id, expert, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS gate FROM (SELECT vec_id, expert, p FROM (SELECT vec_id, unnest(range(8)) AS expert, unnest(list_transform(z, lambda x: exp(x - mx) / tot)) AS p FROM (SELECT *, list_sum(list_transform(z, lambda x: exp(x - mx))) AS tot FROM (SELECT *, list_max(z) AS mx FROM
        (SELECT vec_id, list_transform(range(8), lambda i: embedding[i + 1]::DOUBLE * 10 + CASE WHEN i = 7 THEN -20.0::DOUBLE ELSE 0.0::DOUBLE END) AS z FROM embeddings)))) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) <= 2)""",
    ),
    "l16_warm_cosine": (
        lambda s, d: s.range(0, 20001, 250).select(F.col("id").alias("step"), F.round(M.warm_cosine(F.col("id"), 500, 20000), 6).alias("lr")),
        "SELECT i AS step, round(CASE WHEN i < 500 THEN i / 500.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1.0, (i - 500) / 19500.0::DOUBLE))) END, 6) AS lr FROM range(0, 20001, 250) t(i)",
    ),
    "l17_ramp": (
        lambda s, d: s.range(0, 20001, 500).select(F.col("id").alias("step"), F.round(M.ramp(F.col("id")), 6).alias("factor")),
        "SELECT i AS step, round(least(1.0, i / 10000.0::DOUBLE), 6) AS factor FROM range(0, 20001, 500) t(i)",
    ),
}
