"""Joins, windows, orders, samples and set operations over the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import ordering as H
from quernel.functions import text as T
from quernel.operators import sampling as S
from quernel.plans.scan import neighbour, prefix_sum
from quernel.session import bounded_rows, small, table

#: Ids that one bucket of an ordered scan spans.
BUCKET = 4096
USABLE = "regexp_matches(text, '\\S')"
WORDS = "len(regexp_extract_all(text, '\\S+'))"


def usable(s, d, *columns):
    docs = table(s, d, "documents").where(T.not_blank(F.col("text")))
    return docs.select("doc_id", *columns, T.word_count(F.col("text")).alias("n_words"))


def composed(s, d, n_docs=500):
    """Which domains each of ``n_docs`` composed documents takes, in order: 2 to 4 of those with documents."""
    domains = usable(s, d, "domain").where("domain is not null").select("domain").distinct()
    ids = s.range(n_docs).withColumnRenamed("id", "mix_id").withColumn("k", 2 + H.hash_int("k", F.col("mix_id")) % 3)
    listed = bounded_rows(domains, 1000, "the domains")
    pairs = ids.crossJoin(F.broadcast(s.createDataFrame(listed, "domain string")))
    w = Window.partitionBy("mix_id").orderBy(H.hash_of("mix", F.col("mix_id"), F.col("domain")), "domain")
    return pairs.withColumn("pos", F.row_number().over(w).cast("long")).where("pos <= k").select("mix_id", "pos", "domain")


COMPOSED = """SELECT mix_id, pos, domain FROM (SELECT mix_id, k, domain, row_number() OVER (PARTITION BY mix_id ORDER BY md5('mix|' || mix_id || '|' || domain), domain) AS pos
    FROM (SELECT i AS mix_id, 2 + CAST(('0x' || substr(md5('k|' || i), 1, 8)) AS BIGINT) % 3 AS k FROM range(500) t(i)),
    (SELECT DISTINCT domain FROM documents WHERE domain IS NOT NULL AND regexp_matches(text, '\\S'))) WHERE pos <= k"""


def controls(s, d):
    """Documents of each shard in id order as spans: whether the domain changes, and which run of one domain it is."""
    order, bucket = [F.col("doc_id")], F.floor(F.col("doc_id") / BUCKET).cast("int")
    spans = table(s, d, "documents").select("shard_id", "doc_id", F.coalesce("domain", F.lit("none")).alias("domain"), F.lit(1).alias("one"))
    before = neighbour(spans, ["shard_id"], order, "domain", "before", bucket)
    flagged = before.withColumn("is_switch", F.coalesce(F.col("before") != F.col("domain"), F.lit(True))).drop("before").withColumn("step", F.col("is_switch").cast("int"))
    counted = prefix_sum(flagged, ["shard_id"], order, "step", "runs_before", bucket)
    return prefix_sum(counted.withColumn("run", F.col("runs_before") + F.col("step")), ["shard_id"], order, "one", "place", bucket).drop("one", "step", "runs_before")


def boundaries(s, d, width=8):
    """Whether a span lies within ``width`` spans of the start of its run."""
    c = controls(s, d)
    starts = c.groupBy("shard_id", "run").agg(F.min("place").alias("start"))
    return c.join(starts, ["shard_id", "run"]).select("shard_id", "doc_id", (F.col("place") - F.col("start") < width).alias("is_boundary"))


CONTROLS = """SELECT *, CAST(sum(CAST(is_switch AS INT)) OVER (PARTITION BY shard_id ORDER BY doc_id) AS BIGINT) AS run FROM (SELECT shard_id, doc_id, coalesce(domain, 'none') AS domain,
    coalesce(lag(coalesce(domain, 'none')) OVER (PARTITION BY shard_id ORDER BY doc_id) <> coalesce(domain, 'none'), true) AS is_switch FROM documents)"""


def round_robin(s, d):
    dim = small(table(s, d, "domain_dim").select("domain", "domain_index"))
    docs = usable(s, d, "domain").join(dim, "domain").select("domain", "domain_index", "doc_id")
    return S.round_robin(docs, "domain", "domain_index", "doc_id", F.floor(F.col("doc_id") / BUCKET).cast("int")).select("seq", "turn", "domain", "doc_id")


def temperature(s, d, t=0.7):
    weights = table(s, d, "blend").select("domain", "source", F.pow(F.col("weight"), F.lit(1 / t)).alias("weight"))
    return S.weighted_draws(weights, "domain", "source", "weight", 400, "temperature")


QUERIES = {
    "j1_dimension_lookup": (
        lambda s, d: table(s, d, "documents").join(small(table(s, d, "domain_dim")), "domain").groupBy("domain_index", "tag").agg(F.count(F.lit(1)).alias("n")),
        "SELECT domain_index, tag, count(*) AS n FROM documents JOIN domain_dim USING (domain) GROUP BY ALL",
    ),
    "j2_semi_join": (
        lambda s, d: table(s, d, "code_file").join(table(s, d, "repository").where("stars >= 10"), "repo_id", "left_semi").select("file_id"),
        "SELECT file_id FROM code_file WHERE repo_id IN (SELECT repo_id FROM repository WHERE stars >= 10)",
    ),
    "j3_theta_anti_join": (
        lambda s, d: table(s, d, "history").alias("a").select("arm", "step").distinct().alias("a").join(
            table(s, d, "history").where("val_ce is not null").select("arm", "step").distinct().groupBy("arm").agg(F.max("step").alias("seen")).alias("e"), F.expr("a.arm = e.arm and a.step <= e.seen"), "left_anti"
        ),
        """SELECT arm, step FROM (SELECT DISTINCT arm, step FROM history) a WHERE NOT EXISTS (SELECT 1 FROM history e WHERE e.val_ce IS NOT NULL AND a.arm = e.arm AND a.step <= e.step)""",
    ),
    "j4_carry_forward": (
        lambda s, d: table(s, d, "history").where("step >= 1000").groupBy("arm").agg(F.max("step").alias("step")).unionByName(
            table(s, d, "history").groupBy("arm").agg(F.min("step").alias("step")).join(table(s, d, "history").where("step >= 1000").select("arm").distinct(), "arm", "left_anti")
        ),
        """SELECT arm, max(step) AS step FROM history WHERE step >= 1000 GROUP BY arm UNION ALL SELECT arm, min(step) AS step FROM history
        WHERE arm NOT IN (SELECT arm FROM history WHERE step >= 1000) GROUP BY arm""",
    ),
    "j5_range_join": (
        lambda s, d: table(s, d, "token_vocab").join(F.broadcast(s.createDataFrame([(0, 260), (260, 2000), (2000, 5000), (5000, 1_000_000)], "lo int, hi int")), F.expr("token_id >= lo and token_id < hi"))
        .groupBy(F.col("lo").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("token_id") - F.col("lo")).alias("last_local")),
        """SELECT lo AS low, count(*) AS n, max(token_id - lo) AS last_local FROM token_vocab JOIN (VALUES (0, 260), (260, 2000), (2000, 5000), (5000, 1000000)) r(lo, hi) ON token_id >= lo AND token_id < hi GROUP BY ALL""",
    ),
    "j10_last_writer": (
        lambda s, d: table(s, d, "history").where("loss is not null").groupBy("arm", "step").agg(F.max_by("loss", F.struct("received_at", "run_id", "loss")).alias("loss")),
        "SELECT arm, step, arg_max(loss, (received_at, run_id, loss)) AS loss FROM history WHERE loss IS NOT NULL GROUP BY arm, step",
    ),
    "j11_next_row": (
        lambda s, d: neighbour(table(s, d, "documents").select("shard_id", "doc_id"), ["shard_id"], [F.col("doc_id")], "doc_id", "next_doc", F.floor(F.col("doc_id") / BUCKET).cast("int"), ahead=True),
        "SELECT shard_id, doc_id, lead(doc_id) OVER (PARTITION BY shard_id ORDER BY doc_id) AS next_doc FROM documents",
    ),
    "j13_lookup_with_default": (
        lambda s, d: table(s, d, "documents").join(small(table(s, d, "blend").select("domain", "source", "weight")), ["domain", "source"], "left").groupBy("source").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.count(F.lit(1)).alias("n")),
        "SELECT d.source, max(coalesce(weight, 0.0)) AS weight, count(*) AS n FROM documents d LEFT JOIN blend b USING (domain, source) GROUP BY d.source",
    ),
    "j14_newest_parent": (
        lambda s, d: table(s, d, "token_shard").groupBy("domain").agg(F.max_by("shard_id", F.struct("built_at", "shard_id")).alias("parent")),
        "SELECT domain, arg_max(shard_id, (built_at, shard_id)) AS parent FROM token_shard GROUP BY domain",
    ),
    "w1_balance_by_words": (
        lambda s, d: S.balanced(usable(s, d, "domain", "side").where("domain is not null and side is not null"), "n_words", "domain", "side", "doc_id", "balance").select("domain", "side", "doc_id"),
        f"""SELECT domain, side, doc_id FROM (SELECT domain, side, doc_id, coalesce(sum(w) OVER (PARTITION BY domain, side ORDER BY md5('balance|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT *, {WORDS} AS w FROM documents WHERE {USABLE} AND domain IS NOT NULL AND side IS NOT NULL)) JOIN (SELECT domain, min(t) AS target FROM (SELECT domain, side, sum({WORDS}) AS t FROM documents
        WHERE {USABLE} AND domain IS NOT NULL AND side IS NOT NULL GROUP BY domain, side) GROUP BY domain HAVING count(*) > 1) USING (domain) WHERE before < target""",
    ),
    "w2_span_offsets": (
        lambda s, d: composed(s, d).withColumn("size", F.length("domain") + 10).withColumn("char_offset", F.coalesce(F.sum("size").over(Window.partitionBy("mix_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .select("mix_id", "pos", "domain", "char_offset"),
        f"SELECT mix_id, pos, domain, CAST(coalesce(sum(length(domain) + 10) OVER (PARTITION BY mix_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset FROM ({COMPOSED})",
    ),
    "w4_boundary_flags": (
        boundaries,
        f"SELECT shard_id, doc_id, max(CAST(is_switch AS INT)) OVER (PARTITION BY shard_id ORDER BY doc_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1 AS is_boundary FROM ({CONTROLS})",
    ),
    "w11_first_places": (
        lambda s, d: table(s, d, "eval_item").select("item_id", F.posexplode(T.alpha_words(F.col("text"))).alias("pos", "word")).groupBy("item_id", "word").agg(F.min("pos").cast("long").alias("first_pos"), F.count(F.lit(1)).alias("n")),
        "SELECT item_id, word, min(pos) AS first_pos, count(*) AS n FROM (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM eval_item)) GROUP BY ALL",
    ),
    "w13_domain_runs": (
        lambda s, d: controls(s, d).groupBy("shard_id", "run").agg(F.max("domain").alias("domain"), F.count(F.lit(1)).alias("n_docs")),
        f"SELECT shard_id, run, max(domain) AS domain, count(*) AS n_docs FROM ({CONTROLS}) GROUP BY ALL",
    ),
    "w14_prefix_pooling": (
        lambda s, d: (lambda x, w: x.select("run_id", "chunk", F.sum("t").over(w).alias("pooled_sum"), F.sum("n").over(w).alias("n")))(
            table(s, d, "history").distinct().groupBy("run_id", F.floor(F.col("step") / 500).alias("chunk")).agg(F.sum(F.round(F.col("loss") * 100_000).cast("long")).alias("t"), F.count("loss").alias("n")),
            Window.partitionBy("run_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1),
        ),
        """SELECT run_id, chunk, CAST(sum(t) OVER w AS BIGINT) AS pooled_sum, CAST(sum(n) OVER w AS BIGINT) AS n FROM (SELECT run_id, CAST(step // 500 AS BIGINT) AS chunk, sum(CAST(round(loss * 100000) AS BIGINT)) AS t, count(loss) AS n FROM (SELECT DISTINCT * FROM history) GROUP BY ALL)
        WINDOW w AS (PARTITION BY run_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "o1_seeded_shuffle": (
        lambda s, d: H.hash_ranked(table(s, d, "documents").select("doc_id"), "shuffle", "doc_id"),
        "SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle|' || doc_id), doc_id) AS rank FROM documents",
    ),
    "o3_train_val_split": (
        lambda s, d: S.split(usable(s, d, "source"), "doc_id", 0.05, "split", ["source"]).select("source", "doc_id", "part"),
        f"""SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('split|' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.05)) THEN 'val' ELSE 'train' END AS part
        FROM documents WHERE {USABLE}""",
    ),
    "o4_cyclic_cursor": (
        lambda s, d: (lambda ranked: S.cyclic(ranked, F.lit(ranked.count()), s.range(700).withColumnRenamed("id", "k")).select("k", "row_id"))(H.hash_ranked(table(s, d, "subject_label").select("row_id").distinct(), "cycle", "row_id")),
        """SELECT k, row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('cycle|' || row_id), row_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT row_id FROM subject_label)) JOIN range(700) t(k) ON k % n + 1 = r""",
    ),
    "o5_round_robin": (
        round_robin,
        f"""SELECT row_number() OVER (ORDER BY turn, domain_index) AS seq, turn, domain, doc_id FROM (SELECT domain, domain_index, doc_id, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS turn
        FROM documents JOIN domain_dim USING (domain) WHERE {USABLE})""",
    ),
    "o6_interleave_to_budget": (
        lambda s, d: H.budget_trim(table(s, d, "documents").where(T.not_blank(F.col("text"))).select("doc_id", "source", T.byte_count(F.col("text")).alias("n_bytes")), "n_bytes", F.lit(500_000), "interleave", "doc_id", []).select("doc_id", "source"),
        f"""SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY md5('interleave|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM documents WHERE {USABLE}) WHERE before < 500000""",
    ),
    "o7_weighted_draws": (
        lambda s, d: S.weighted_draws(table(s, d, "blend"), "domain", "source", "weight", 400, "draw"),
        """SELECT domain, CAST(draw AS INT) AS draw, arg_min(source, high) AS source FROM (SELECT domain, source, sum(weight) OVER (PARTITION BY domain ORDER BY source ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY domain) AS high FROM blend)
        JOIN (SELECT DISTINCT domain, draw, CAST(('0x' || substr(md5('draw|' || domain || '|' || draw), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM blend, range(400) t(draw)) USING (domain) WHERE u < high GROUP BY domain, draw""",
    ),
    "o8_compose_domains": (composed, COMPOSED),
    "o10_snippet_lengths": (
        lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", T.word_count(T.snippet(F.col("text"), F.when(F.col("domain") == "nlp", 600).otherwise(250))).alias("n")),
        "SELECT doc_id, CAST(least(len(regexp_extract_all(text, '\\S+')), CASE WHEN domain = 'nlp' THEN 600 ELSE 250 END) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL",
    ),
    "o11_domain_share": (
        lambda s, d: usable(s, d, "domain").groupBy("domain").agg(F.sum("n_words").alias("n_words")).withColumn("share", F.round(F.col("n_words") / F.sum("n_words").over(Window.partitionBy()), 6)),
        f"SELECT domain, CAST(sum({WORDS}) AS BIGINT) AS n_words, round(sum({WORDS})::DOUBLE / sum(sum({WORDS})) OVER (), 6) AS share FROM documents WHERE {USABLE} GROUP BY domain",
    ),
    "o12_step_mix": (
        lambda s, d: s.range(1, 2001).select(F.col("id").alias("step"), (H.uniform("step", F.col("id")) < 0.6).alias("mixed"), F.pmod("id", F.lit(4)).alias("turn")),
        "SELECT i AS step, CAST(('0x' || substr(md5('step|' || i), 1, 8)) AS BIGINT) / 4294967296.0 < 0.6 AS mixed, i % 4 AS turn FROM range(1, 2001) t(i)",
    ),
    "o16_curriculum": (
        lambda s, d: s.range(1, 1001).select(F.col("id").alias("step"), F.when(F.col("id") <= 600, "a").otherwise("b").alias("stream"), F.when(F.col("id") <= 600, 0).otherwise(1000).alias("pass_offset")),
        "SELECT i AS step, CASE WHEN i <= 600 THEN 'a' ELSE 'b' END AS stream, CASE WHEN i <= 600 THEN 0 ELSE 1000 END AS pass_offset FROM range(1, 1001) t(i)",
    ),
    "o17_temperature_draws": (
        temperature,
        """WITH w AS (SELECT domain, source, pow(weight, 1 / 0.7::DOUBLE) AS weight FROM blend)
        SELECT domain, CAST(draw AS INT) AS draw, arg_min(source, high) AS source FROM (SELECT domain, source, sum(weight) OVER (PARTITION BY domain ORDER BY source ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY domain) AS high FROM w)
        JOIN (SELECT DISTINCT domain, draw, CAST(('0x' || substr(md5('temperature|' || domain || '|' || draw), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM blend, range(400) t(draw)) USING (domain) WHERE u < high GROUP BY domain, draw""",
    ),
    "o18_sample_sizes": (
        lambda s, d: S.sized_samples(usable(s, d, "source"), table(s, d, "blend").select("source", "weight"), "source", "weight", 100, "doc_id", "sized").select("source", "doc_id"),
        f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('sized|' || doc_id), doc_id) AS r FROM documents WHERE {USABLE}) JOIN blend USING (source) WHERE r <= round(weight * 100)""",
    ),
    "u1_union_sides": (
        lambda s, d: table(s, d, "documents").where("side = 'raw'").select("doc_id", "domain").unionByName(table(s, d, "documents").where("side = 'textbook'").select("doc_id", "domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n")),
        "SELECT domain, count(*) AS n FROM documents WHERE side IN ('raw', 'textbook') GROUP BY domain",
    ),
    "f7_gated_sources": (
        lambda s, d: table(s, d, "documents").join(F.broadcast(s.createDataFrame([("letters",), ("subtitles",)], "source string")), "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
        "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('letters', 'subtitles') GROUP BY source",
    ),
    "u2_pooled_union": (
        lambda s, d: table(s, d, "documents").where("text is not null").select("text", F.lit("documents").alias("origin")).unionByName(table(s, d, "stage2_stream_dataset").where("text is not null").select("text", F.lit("stream").alias("origin"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(T.byte_count(F.col("text"))).alias("n_bytes")),
        "SELECT origin, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM (SELECT text, 'documents' AS origin FROM documents UNION ALL SELECT text, 'stream' FROM stage2_stream_dataset) WHERE text IS NOT NULL GROUP BY origin",
    ),
    "u3_key_difference": (
        lambda s, d: table(s, d, "documents").select("source").distinct().exceptAll(table(s, d, "stage2_stream_dataset").select("source").distinct()).withColumn("side", F.lit("left")).unionByName(
            table(s, d, "stage2_stream_dataset").select("source").distinct().exceptAll(table(s, d, "documents").select("source").distinct()).withColumn("side", F.lit("right"))
        ),
        """SELECT source, 'left' AS side FROM (SELECT source FROM documents EXCEPT SELECT source FROM stage2_stream_dataset) UNION ALL
        SELECT source, 'right' AS side FROM (SELECT source FROM stage2_stream_dataset EXCEPT SELECT source FROM documents)""",
    ),
    "u4_all_domains_used": (
        lambda s, d: table(s, d, "domain_dim").select("domain").where("domain is not null").join(table(s, d, "documents").select("domain").distinct().withColumn("used", F.lit(True)), "domain", "left").select("domain", F.coalesce("used", F.lit(False)).alias("used")),
        "SELECT domain, domain IN (SELECT domain FROM documents WHERE domain IS NOT NULL) AS used FROM domain_dim WHERE domain IS NOT NULL",
    ),
    "u5_distinct_rows": (
        lambda s, d: table(s, d, "history").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("n")),
        "SELECT arm, count(*) AS n FROM (SELECT DISTINCT * FROM history) GROUP BY arm",
    ),
    "u6_missing_sources": (
        lambda s, d: table(s, d, "shard_source").select("source").distinct().join(table(s, d, "blend"), "source", "left_anti"),
        "SELECT DISTINCT source FROM shard_source WHERE source NOT IN (SELECT source FROM blend)",
    ),
    "u7_shared_sources": (
        lambda s, d: table(s, d, "documents").select("source").intersect(table(s, d, "stage2_stream_dataset").select("source")),
        "SELECT source FROM documents INTERSECT SELECT source FROM stage2_stream_dataset",
    ),
}
