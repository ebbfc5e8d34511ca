"""The results store, leaderboards, monitors and ordered folds over training histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import ordering as H
from quernel.operators import results as R
from quernel.operators import series as X
from quernel.session import table

CLEAN = "SELECT run_id, arm, step, arg_max(loss, (received_at, loss)) AS loss, arg_max(elapsed, (received_at, loss)) AS elapsed FROM history WHERE loss IS NOT NULL GROUP BY run_id, arm, step"
BOARD = "SELECT arm, max(step) AS step, round(arg_max(loss, (step, -loss)), 5) AS loss, round(min(val_ce), 5) AS val_ce FROM history GROUP BY arm"


def clean(s, d):
    """One reading per run, arm and step: the one received last."""
    h = table(s, d, "history").where("loss is not null")
    best = F.max_by(F.struct("loss", "elapsed"), F.struct("received_at", "loss"))
    return h.groupBy("run_id", "arm", "step").agg(best.alias("b")).select("run_id", "arm", "step", "b.loss", "b.elapsed")


def board(s, d):
    h = table(s, d, "history")
    return h.groupBy("arm").agg(F.max("step").alias("step"), F.round(F.max_by("loss", F.when(F.col("loss").isNotNull(), F.struct(F.col("step"), -F.col("loss")))), 5).alias("loss"), F.round(F.min("val_ce"), 5).alias("val_ce"))


def exact(df):
    """Losses in whole units of their last logged digit, so that sums and roundings are exact in every engine."""
    return df.withColumn("e5", F.round(F.col("loss") * 100_000).cast("long"))


def curves(s, d, k=50):
    """Smoothed, downsampled, rounded half up to thousandths (given as whole thousandths)."""
    keys, order = ["run_id", "arm"], ["step"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-8, 8)
    c = exact(clean(s, d)).withColumn("t", F.sum("e5").over(w)).withColumn("n", F.count("e5").over(w))
    return X.downsampled(c, keys, order, k).select(*keys, *order, F.floor((2 * F.col("t") + 100 * F.col("n")) / (200 * F.col("n"))).alias("milli"))


def bootstrap(s, d, draws=200):
    """Mean loss of each arm under Poisson-like resampling by hash: every reading counts 0 to 3 times per draw."""
    c = clean(s, d).select("arm", "run_id", "step", "loss", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = H.uniform("boot", F.col("draw"), F.col("run_id"), F.col("arm"), F.col("step"))
    w = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).otherwise(3)
    means = c.withColumn("w", w).groupBy("arm", "draw").agg((F.sum(F.col("w") * F.col("loss")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy("arm").agg(F.round(F.percentile("m", 0.025), 4).alias("low"), F.round(F.percentile("m", 0.975), 4).alias("high"))


def runs(s, d):
    """The arms as a catalogue: each arm's parent is the arm before it in its family."""
    arms = table(s, d, "history").select("arm").distinct().where(F.col("arm").rlike("^routed[0-9]+$"))
    n = F.regexp_extract("arm", "([0-9]+)$", 1).cast("int")
    return arms.select("arm", F.when(n > 2, F.concat(F.lit("routed"), (n - 1).cast("string"))).alias("parent"))


QUERIES = {
    "k5_upsert": (
        lambda s, d: (lambda b: R.merged(b, b.where("step >= 4000").select("arm", (F.col("step") + 50).alias("step"), F.lit(None).cast("double").alias("loss"), F.col("val_ce")), ["arm"]))(board(s, d)),
        f"SELECT arm, CASE WHEN step >= 4000 THEN step + 50 ELSE step END AS step, loss, val_ce FROM ({BOARD})",
    ),
    "r1_replace_rows": (
        lambda s, d: (lambda b: R.upserted(b.select("arm", "step"), b.where("val_ce is null").select("arm", F.lit(0).cast("long").alias("step")), ["arm"]))(board(s, d)),
        f"SELECT arm, CASE WHEN val_ce IS NULL THEN 0 ELSE step END AS step FROM ({BOARD})",
    ),
    "a28_latest_result": (
        lambda s, d: R.latest(clean(s, d), "arm", F.struct("step", "run_id")).select("arm", "run_id", "step", "loss"),
        f"SELECT arm, run_id, step, loss FROM ({CLEAN}) QUALIFY row_number() OVER (PARTITION BY arm ORDER BY step DESC, run_id DESC) = 1",
    ),
    "a29_largest_step": (lambda s, d: table(s, d, "history").groupBy("arm").agg(F.max("step").alias("step")), "SELECT arm, max(step) AS step FROM history GROUP BY arm"),
    "a30_best_flag": (
        lambda s, d: board(s, d).withColumn("is_best", F.col("loss") == F.min("loss").over(Window.partitionBy())).select("arm", "loss", "is_best"),
        f"SELECT arm, loss, loss = min(loss) OVER () AS is_best FROM ({BOARD})",
    ),
    "a31_axis_range": (
        lambda s, d: clean(s, d).groupBy("run_id", "arm").agg(F.min("step").alias("a"), F.max("step").alias("b"), F.round(F.min("loss") - 0.05 * (F.max("loss") - F.min("loss")), 8).alias("low"), F.round(F.max("loss") + 0.05 * (F.max("loss") - F.min("loss")), 8).alias("high")),
        f"SELECT run_id, arm, min(step) AS a, max(step) AS b, round(min(loss) - 0.05 * (max(loss) - min(loss)), 8) AS low, round(max(loss) + 0.05 * (max(loss) - min(loss)), 8) AS high FROM ({CLEAN}) GROUP BY ALL",
    ),
    "a32_logged_means": (
        lambda s, d: exact(clean(s, d)).groupBy("run_id", "arm", F.floor((F.col("step") - 1) / 500).alias("bucket")).agg(F.sum("e5").alias("sum_e5"), F.count(F.lit(1)).alias("n")),
        f"SELECT run_id, arm, CAST((step - 1) // 500 AS BIGINT) AS bucket, CAST(sum(CAST(round(loss * 100000) AS BIGINT)) AS BIGINT) AS sum_e5, count(*) AS n FROM ({CLEAN}) GROUP BY ALL",
    ),
    "w6_smoothed": (
        lambda s, d: X.smoothed(exact(clean(s, d)), ["run_id", "arm"], ["step"], "e5", 8, "smooth").select("run_id", "arm", "step", F.round("smooth", 1).alias("smooth_e5")),
        f"SELECT run_id, arm, step, round(avg(CAST(round(loss * 100000) AS BIGINT)) OVER (PARTITION BY run_id, arm ORDER BY step ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 1) AS smooth_e5 FROM ({CLEAN})",
    ),
    "w7_downsampled": (
        lambda s, d: X.downsampled(clean(s, d), ["run_id", "arm"], ["step"], 20).select("run_id", "arm", "step"),
        f"""SELECT run_id, arm, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id, arm ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run_id, arm) AS n FROM ({CLEAN}))
        WHERE n <= 20 OR i IN (SELECT unnest(list_transform(range(20), lambda j: CAST(round_even(j * (n - 1) / 19.0::DOUBLE, 0) AS BIGINT))))""",
    ),
    "r6_curve_refresh": (
        curves,
        f"""SELECT run_id, arm, step, CAST((2 * t + 100 * m) // (200 * m) AS BIGINT) AS milli FROM (SELECT *, sum(CAST(round(loss * 100000) AS BIGINT)) OVER (PARTITION BY run_id, arm ORDER BY step ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS t, count(*) OVER (PARTITION BY run_id, arm ORDER BY step ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS m, row_number() OVER (PARTITION BY run_id, arm ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run_id, arm) AS n FROM ({CLEAN}))
        WHERE n <= 50 OR i IN (SELECT unnest(list_transform(range(50), lambda j: CAST(round_even(j * (n - 1) / 49.0::DOUBLE, 0) AS BIGINT))))""",
    ),
    "w8_composite_rank": (
        lambda s, d: board(s, d).withColumn("rank", F.row_number().over(Window.orderBy(F.col("val_ce").isNull(), F.coalesce("val_ce", "loss", F.lit(9e9)), "arm")).cast("long")).select("arm", "rank"),
        f"SELECT arm, row_number() OVER (ORDER BY val_ce IS NULL, coalesce(val_ce, loss, 9e9), arm) AS rank FROM ({BOARD})",
    ),
    "w10_monotonic_steps": (
        lambda s, d: table(s, d, "history").select("run_id", "arm", "received_at", "step").distinct().withColumn("shown", F.max("step").over(Window.partitionBy("run_id", "arm").orderBy("received_at", "step").rowsBetween(Window.unboundedPreceding, 0))).select("run_id", "arm", "step", "shown").distinct(),
        "SELECT DISTINCT run_id, arm, step, shown FROM (SELECT *, max(step) OVER (PARTITION BY run_id, arm ORDER BY received_at, step ROWS UNBOUNDED PRECEDING) AS shown FROM (SELECT DISTINCT run_id, arm, received_at, step FROM history))",
    ),
    "w12_rolling_mean": (
        lambda s, d: exact(clean(s, d)).select("run_id", "arm", "step", *[f("e5").over(Window.partitionBy("run_id", "arm").orderBy("step").rowsBetween(-50, -1)).alias(n) for f, n in ((F.sum, "rolling_sum"), (F.count, "n"))]),
        f"SELECT run_id, arm, step, CAST(sum(CAST(round(loss * 100000) AS BIGINT)) OVER w AS BIGINT) AS rolling_sum, count(*) OVER w AS n FROM ({CLEAN}) WINDOW w AS (PARTITION BY run_id, arm ORDER BY step ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)",
    ),
    "r3_scoreboard": (
        lambda s, d: board(s, d).select(
            "arm",
            F.when(F.col("val_ce").isNull(), "-").otherwise(F.format_string("%.2f", "val_ce")).alias("shown_ce"),
            F.when(F.col("loss").isNull(), "-").when(F.exp("loss") >= 100, F.format_string("%.1f", F.exp("loss"))).otherwise(F.format_string("%.2f", F.exp("loss"))).alias("shown_ppl"),
        ),
        f"SELECT arm, coalesce(printf('%.2f', val_ce), '-') AS shown_ce, coalesce(CASE WHEN exp(loss) >= 100 THEN printf('%.1f', exp(loss)) ELSE printf('%.2f', exp(loss)) END, '-') AS shown_ppl FROM ({BOARD})",
    ),
    "r4_in_flight": (
        lambda s, d: table(s, d, "history").groupBy("run_id", "arm").agg(F.max("step").alias("step"), F.max("logged_at").alias("at")).select("run_id", "arm", "step", F.when(F.col("step") >= 5000, "done").otherwise("running").alias("state"), F.round(F.col("step") / 60.0, 2).alias("percent")),
        "SELECT run_id, arm, max(step) AS step, CASE WHEN max(step) >= 5000 THEN 'done' ELSE 'running' END AS state, round(max(step) / 60.0::DOUBLE, 2) AS percent FROM history GROUP BY run_id, arm",
    ),
    "r5_pixel_coordinates": (
        lambda s, d: (lambda c: c.join(c.groupBy("run_id", "arm").agg(F.min("step").alias("a"), F.max("step").alias("b"), F.min("loss").alias("lo"), F.max("loss").alias("hi")), ["run_id", "arm"]))(clean(s, d))
        .select("run_id", "arm", "step", F.round((F.col("step") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1)) * 300, 2).alias("x"), F.round(80 - (F.col("loss") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 80, 2).alias("y")),
        f"""SELECT run_id, arm, step, round((step - min(step) OVER w) / greatest(max(step) OVER w - min(step) OVER w, 1)::DOUBLE * 300, 2) AS x, round(80 - (loss - min(loss) OVER w) / greatest(max(loss) OVER w - min(loss) OVER w, 1e-9::DOUBLE) * 80, 2) AS y
        FROM ({CLEAN}) WINDOW w AS (PARTITION BY run_id, arm)""",
    ),
    "r8_status_cycle": (
        lambda s, d: (lambda h: R.status_cycle(h.where("run_id % 2 = 0").select("arm", "step"), h.where("run_id % 2 = 1").groupBy("arm").agg(F.max("step").alias("step")), h.where("val_ce is not null").select("arm", "step")))(table(s, d, "history")),
        """SELECT arm, step FROM (SELECT arm, max(step) AS step FROM history GROUP BY arm) LEFT JOIN (SELECT arm, max(step) AS done FROM history WHERE val_ce IS NOT NULL GROUP BY arm) USING (arm) WHERE done IS NULL OR step > done""",
    ),
    "r9_staleness": (
        lambda s, d: X.gaps(table(s, d, "events"), ["event_type"], "ts", 420).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "gap_s"),
        "SELECT event_type, epoch_us(ts) AS ts_us, round(g / 1e6, 3) AS gap_s FROM (SELECT event_type, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS g FROM events) WHERE g > 420000000",
    ),
    "r10_trends": (
        lambda s, d: (lambda v: v.select("run_id", "arm", "step", F.round(F.col("ce") - F.lag("ce").over(Window.partitionBy("run_id", "arm").orderBy("step")), 6).alias("delta"), F.min("ce").over(Window.partitionBy("run_id", "arm").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("best")))(
            table(s, d, "history").where("val_ce is not null").groupBy("run_id", "arm", "step").agg(F.max("val_ce").alias("ce"))
        ),
        """SELECT run_id, arm, step, round(ce - lag(ce) OVER (PARTITION BY run_id, arm ORDER BY step), 6) AS delta, min(ce) OVER (PARTITION BY run_id, arm ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM (SELECT run_id, arm, step, max(val_ce) AS ce FROM history WHERE val_ce IS NOT NULL GROUP BY ALL)""",
    ),
    "r11_bootstrap_intervals": (
        bootstrap,
        f"""WITH u AS (SELECT arm, loss, draw, CAST(('0x' || substr(md5('boot|' || draw || '|' || run_id || '|' || arm || '|' || step), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM ({CLEAN}), range(200) t(draw)),
        m AS (SELECT arm, draw, sum(w * loss) / nullif(sum(w), 0) AS m FROM (SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 ELSE 3 END AS w FROM u) GROUP BY arm, draw)
        SELECT arm, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m GROUP BY arm""",
    ),
    "o14_status_order": (
        lambda s, d: board(s, d).select("arm", "step", F.row_number().over(Window.orderBy(F.col("step") < 3000, F.desc("step"), "arm")).cast("long").alias("place")),
        f"SELECT arm, step, row_number() OVER (ORDER BY step < 3000, step DESC, arm) AS place FROM ({BOARD})",
    ),
    "c6_run_states": (
        lambda s, d: table(s, d, "history").groupBy("run_id", "arm").agg(F.max("step").alias("m"), F.max("logged_at").alias("t")).select("run_id", "arm", F.when(F.col("m") >= 3000, "done").when(F.col("t") >= F.lit("2025-03-02").cast("timestamp"), "running").otherwise("stopped").alias("state")),
        "SELECT run_id, arm, CASE WHEN max(step) >= 3000 THEN 'done' WHEN max(logged_at) >= TIMESTAMP '2025-03-02' THEN 'running' ELSE 'stopped' END AS state FROM history GROUP BY run_id, arm",
    ),
    "f14_spike_guard": (
        lambda s, d: X.controlled(clean(s, d), ["run_id", "arm"], ["step"], "loss").select("run_id", "arm", "skipped"),
        f"""WITH RECURSIVE c AS (SELECT run_id, arm, list(loss ORDER BY step) AS xs FROM ({CLEAN}) GROUP BY ALL), f AS (SELECT run_id, arm, xs, 0 AS i, CAST(0 AS BIGINT) AS skipped, CAST([] AS DOUBLE[]) AS kept FROM c UNION ALL
        SELECT run_id, arm, xs, i + 1, CASE WHEN len(kept) >= 25 AND xs[i + 1] > 3 * list_sum(kept) / len(kept) THEN skipped + 1 ELSE skipped END, CASE WHEN len(kept) >= 25 AND xs[i + 1] > 3 * list_sum(kept) / len(kept) THEN kept ELSE list_slice(list_append(kept, xs[i + 1]), -50, -1) END FROM f WHERE i < len(xs))
        SELECT run_id, arm, skipped FROM f WHERE i = len(xs)""",
    ),
    "x3_ema_fold": (
        lambda s, d: X.ema(clean(s, d), ["run_id", "arm"], ["step"], "loss", 0.98).withColumn("ema", F.round("ema", 6)),
        f"SELECT run_id, arm, round(list_reduce(list(loss ORDER BY step), lambda a, x: a * 0.98::DOUBLE + x * (1 - 0.98::DOUBLE)), 6) AS ema FROM ({CLEAN}) GROUP BY run_id, arm",
    ),
    "x5_last_good_state": (
        lambda s, d: table(s, d, "history").where("loss is not null and not isnan(loss) and val_ce is not null").groupBy("run_id", "arm").agg(F.max("step").alias("resume_from"))
        .join(table(s, d, "history").groupBy("run_id", "arm").agg(F.max("step").alias("newest")), ["run_id", "arm"], "right"),
        "SELECT run_id, arm, max(step) FILTER (loss IS NOT NULL AND NOT isnan(loss) AND val_ce IS NOT NULL) AS resume_from, max(step) AS newest FROM history WHERE run_id IS NOT NULL AND arm IS NOT NULL GROUP BY run_id, arm",
    ),
    "x4_controller_fold": (
        lambda s, d: X.controlled(clean(s, d), ["run_id", "arm"], ["step"], "loss", patience=20).select("run_id", "arm", F.round("scale", 6).alias("scale"), "skipped", F.round("ema", 6).alias("ema")),
        f"""WITH RECURSIVE c AS (SELECT run_id, arm, list(loss ORDER BY step) AS xs FROM ({CLEAN}) GROUP BY ALL),
        f AS (SELECT run_id, arm, xs, 0 AS i, 1.0::DOUBLE AS scale, 0::BIGINT AS skipped, NULL::DOUBLE AS ema, NULL::DOUBLE AS best, 0::BIGINT AS since, CAST([] AS DOUBLE[]) AS kept FROM c UNION ALL
        SELECT run_id, arm, xs, i + 1, CASE WHEN skip THEN scale ELSE least(3.0::DOUBLE, greatest(0.1::DOUBLE, CASE WHEN since1 >= 20 THEN scale * 0.5::DOUBLE WHEN better THEN scale * 1.02::DOUBLE ELSE scale * 0.98::DOUBLE END)) END,
        CASE WHEN skip THEN skipped + 1 ELSE skipped END, CASE WHEN skip THEN ema ELSE new END, CASE WHEN skip OR NOT better THEN best ELSE new END, CASE WHEN skip THEN since WHEN since1 >= 20 THEN 0 ELSE since1 END, CASE WHEN skip THEN kept ELSE list_slice(list_append(kept, x), -50, -1) END
        FROM (SELECT *, CASE WHEN better THEN 0 ELSE since + 1 END AS since1 FROM (SELECT *, best IS NULL OR new < best AS better FROM (SELECT *, coalesce(len(kept) >= 25 AND x > 3 * list_sum(kept) / len(kept), false) AS skip,
        coalesce(ema * 0.98::DOUBLE + x * (1 - 0.98::DOUBLE), x) AS new FROM (SELECT *, xs[i + 1] AS x FROM f WHERE i < len(xs))))))
        SELECT run_id, arm, round(scale, 6) AS scale, skipped, round(ema, 6) AS ema FROM f WHERE i = len(xs)""",
    ),
    "l5_normalised_losses": (
        lambda s, d: clean(s, d).join(X.ema(clean(s, d), ["run_id", "arm"], ["step"], "loss", 0.98), ["run_id", "arm"]).groupBy("run_id", "arm").agg(F.round(F.sum(F.when(F.abs("ema") > 1e-8, F.col("loss") / F.col("ema"))), 5).alias("total")),
        f"""SELECT run_id, arm, round(sum(loss / ema), 5) AS total FROM ({CLEAN}) JOIN (SELECT run_id, arm, list_reduce(list(loss ORDER BY step), lambda a, x: a * 0.98::DOUBLE + x * (1 - 0.98::DOUBLE)) AS ema FROM ({CLEAN}) GROUP BY run_id, arm) USING (run_id, arm) GROUP BY run_id, arm""",
    ),
    "x6_periodic_triggers": (
        lambda s, d: table(s, d, "history").select("run_id", "step").distinct().select("run_id", "step", (F.col("step") % 500 == 0).alias("evaluates"), (F.col("step") % 1000 == 0).alias("checkpoints")),
        "SELECT DISTINCT run_id, step, step % 500 = 0 AS evaluates, step % 1000 = 0 AS checkpoints FROM history",
    ),
    "l18_parameter_groups": (
        lambda s, d: table(s, d, "history").select("arm").distinct().select("arm", F.when(F.col("arm").startswith("routed"), 1.0).when(F.col("arm").contains("pool"), 0.5).otherwise(0.1).alias("scale")),
        "SELECT DISTINCT arm, CAST(CASE WHEN starts_with(arm, 'routed') THEN 1.0 WHEN contains(arm, 'pool') THEN 0.5 ELSE 0.1 END AS DOUBLE) AS scale FROM history",
    ),
    "l20_run_ancestry": (
        lambda s, d: R.ancestry(runs(s, d)).select("run", "ancestor", F.col("depth").cast("long").alias("depth")),
        """WITH RECURSIVE r AS (SELECT DISTINCT arm, CASE WHEN CAST(arm[7:] AS INT) > 2 THEN 'routed' || (CAST(arm[7:] AS INT) - 1) END AS parent FROM history WHERE regexp_matches(arm, '^routed[0-9]+$')),
        a AS (SELECT arm AS run, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM r WHERE parent IS NOT NULL UNION ALL SELECT a.run, r.parent, depth + 1 FROM a JOIN r ON a.ancestor = r.arm WHERE r.parent IS NOT NULL) SELECT run, ancestor, depth FROM a""",
    ),
}
