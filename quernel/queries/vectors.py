"""Embedding tables: nearest rows, moments, alignment, averaging, routing statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions.text import alpha_words
from quernel.operators import vectors as V
from quernel.session import table

DOUBLES = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
NEAREST = f"""SELECT q.vec_id, v.vec_id AS other_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS cosine, q.label AS a, v.label AS b FROM ({DOUBLES}) q JOIN ({DOUBLES}) v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id"""
FLAT = f"SELECT vec_id, label, unnest(range(64)) AS i, unnest(e) AS x FROM ({DOUBLES})"
COVARIANCE = f"""SELECT a.label, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, avg(a.x) AS mean_i, avg(b.x) AS mean_j, covar_samp(a.x, b.x) AS cov FROM ({FLAT}) a JOIN ({FLAT}) b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL"""


def doubles(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def queries_of(s, d):
    return doubles(s, d).where("vec_id % 100 = 0")


def copy_mass(s, d, band=16, digits=6):
    """Attention from each word to the same-item words at most ``band`` before it, weighted by closeness, summed by word."""
    words = table(s, d, "eval_item").select("item_id", alpha_words(F.col("text")).alias("w"))
    each = words.select("item_id", "w", F.posexplode("w").alias("q", "word")).where("q > 0")
    lo = F.greatest(F.col("q") - band, F.lit(0))
    near = each.select("item_id", "q", F.posexplode(F.slice("w", lo + 1, F.col("q") - lo)).alias("k", "source"), (F.col("q") - lo).alias("n"))
    massed = near.withColumn("e", F.exp(-(F.col("n") - F.col("k")) / 4.0))
    return massed.groupBy("item_id", "q", "source").agg(F.sum("e").alias("e")).withColumn("mass", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("item_id", "q")), digits)).select("item_id", F.col("q").cast("long").alias("q"), "source", "mass")


def verdict(s, d):
    v = doubles(s, d)
    pairs = v.alias("a").join(v.alias("b"), F.expr("a.vec_id + 1 = b.vec_id")).select(F.col("a.label").alias("label"), V.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("c"))
    out = pairs.groupBy("label").agg(F.avg("c").alias("m"), F.round(F.avg((F.col("c") < 0).cast("double")), 6).alias("negative"))
    return out.select("label", F.round("m", 6).alias("mean_cosine"), "negative", F.when(F.col("m") < -0.05, "conflict").when(F.abs("m") <= 0.05, "neutral").otherwise("aligned").alias("verdict"))


QUERIES = {
    "j6_nearest_of_other_labels": (
        lambda s, d: V.nearest(doubles(s, d), queries_of(s, d), 3).withColumn("cosine", F.round("cosine", 6)),
        f"SELECT vec_id, other_id, round(cosine, 6) AS cosine FROM ({NEAREST}) WHERE a <> b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) <= 3",
    ),
    "j7_label_mean_pairs": (
        lambda s, d: (lambda m: m.alias("a").join(m.alias("b"), F.expr("a.i = b.i and a.label < b.label")).groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.round(F.sum(F.pow(F.col("a.m") - F.col("b.m"), F.lit(2.0))), 6).alias("squared")))(
            V.covariances(doubles(s, d)).where("i = j").select("label", "i", F.col("mean_i").alias("m"))
        ),
        f"WITH m AS (SELECT label, i, avg(x) AS m FROM ({FLAT}) GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sum(pow(a.m - b.m, 2)), 6) AS squared FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL",
    ),
    "j8_table_average": (
        lambda s, d: V.averaged(doubles(s, d), doubles(s, d).withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding", 0.3).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm")),
        f"SELECT vec_id, round(list_dot_product(m, m), 6) AS norm FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: e[i] * 0.7::DOUBLE + e[65 - i] * 0.3::DOUBLE) AS m FROM ({DOUBLES}))",
    ),
    "j9_state_copy": (
        lambda s, d: V.state_copy(doubles(s, d), doubles(s, d).where("label < 5").withColumn("embedding", F.when(F.col("label") == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))), "vec_id", "embedding").groupBy("origin").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN label >= 5 THEN 'fresh' WHEN label = 0 THEN 'resized' ELSE 'loaded' END AS origin, count(*) AS n FROM embeddings GROUP BY ALL",
    ),
    "j12_copy_mass": (
        copy_mass,
        """SELECT item_id, q, source, round(e / sum(e) OVER (PARTITION BY item_id, q), 6) AS mass FROM (SELECT a.item_id, a.q, b.word AS source, sum(exp(-(a.q - b.q) / 4.0::DOUBLE)) AS e FROM w a JOIN w b ON a.item_id = b.item_id AND b.q < a.q AND b.q >= a.q - 16 GROUP BY ALL)""".replace(
            "FROM w a JOIN w b", "FROM (SELECT item_id, unnest(range(len(w))) AS q, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM eval_item)) a JOIN (SELECT item_id, unnest(range(len(w))) AS q, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM eval_item)) b"
        ),
    ),
    "a22_cosine_verdicts": (
        verdict,
        f"""SELECT label, round(m, 6) AS mean_cosine, negative, CASE WHEN m < -0.05 THEN 'conflict' WHEN abs(m) <= 0.05 THEN 'neutral' ELSE 'aligned' END AS verdict FROM (SELECT label, avg(c) AS m, round(avg(CASE WHEN c < 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS negative FROM
        (SELECT a.label, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM ({DOUBLES}) a JOIN ({DOUBLES}) b ON a.vec_id + 1 = b.vec_id) GROUP BY label)""",
    ),
    "a23_label_moments": (
        lambda s, d: V.covariances(doubles(s, d)).select("label", "i", "j", (F.round("mean_i", 6) + 0.0).alias("mean_i"), (F.round("cov", 6) + 0.0).alias("cov")),
        f"SELECT label, i, j, round(mean_i, 6) + 0.0::DOUBLE AS mean_i, round(cov, 6) + 0.0::DOUBLE AS cov FROM ({COVARIANCE})",
    ),
    "a24_alignment_distance": (
        lambda s, d: V.alignment_distance(doubles(s, d)).select("a", "b", F.round("distance", 6).alias("distance")),
        f"""WITH m AS ({COVARIANCE}) SELECT a.label AS a, b.label AS b, round(sum(CASE WHEN a.i = a.j THEN 1.0::DOUBLE ELSE 2.0 END * pow(a.cov - b.cov, 2) + CASE WHEN a.i = a.j THEN pow(a.mean_i - b.mean_i, 2) ELSE 0.0 END), 6) AS distance FROM m a JOIN m b ON a.i = b.i AND a.j = b.j AND a.label < b.label GROUP BY ALL""",
    ),
    "a25_mode_of_domain": (
        lambda s, d: table(s, d, "documents").where("domain is not null").groupBy("shard_id", "domain").agg(F.count(F.lit(1)).alias("n")).groupBy("shard_id").agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("mode")),
        "SELECT shard_id, arg_min(domain, (-n, domain)) AS mode FROM (SELECT shard_id, domain, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY ALL) GROUP BY shard_id",
    ),
    "a26_load_balance": (
        lambda s, d: (lambda p: p.agg(F.round(F.sum(F.col("m") * F.col("m")) * 8, 6).alias("balance")))(
            doubles(s, d).select(F.posexplode(F.slice("embedding", 1, 8)).alias("expert", "z"), "vec_id").withColumn("e", F.exp(F.col("z") * 10)).withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("vec_id"))).groupBy("expert").agg(F.avg("p").alias("m"))
        ),
        f"SELECT round(sum(m * m) * 8, 6) AS balance FROM (SELECT i, avg(p) AS m FROM (SELECT i, exp(x * 10) / sum(exp(x * 10)) OVER (PARTITION BY vec_id) AS p FROM ({FLAT}) WHERE i < 8) GROUP BY i)",
    ),
    "a27_component_sizes": (
        lambda s, d: table(s, d, "domain_dim").select(F.coalesce("tokenizer_kind", F.lit("none")).alias("component"), (F.coalesce("vocab_size", F.lit(0)) * 512).cast("long").alias("size")).groupBy("component").agg(F.sum("size").alias("n_params")),
        "SELECT coalesce(tokenizer_kind, 'none') AS component, CAST(sum(coalesce(vocab_size, 0) * 512) AS BIGINT) AS n_params FROM domain_dim GROUP BY ALL",
    ),
    "e10_intersection_mining": (
        lambda s, d: V.nearest(doubles(s, d), queries_of(s, d), 5).where("cosine >= 0.2").orderBy(F.desc("cosine"), "vec_id", "other_id").limit(20).select("vec_id", "other_id", F.round("cosine", 6).alias("cosine")),
        f"SELECT vec_id, other_id, round(cosine, 6) AS cosine FROM (SELECT * FROM ({NEAREST}) WHERE a <> b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) <= 5) WHERE cosine >= 0.2 ORDER BY cosine DESC, vec_id, other_id LIMIT 20",
    ),
    "e11_within_and_across": (
        lambda s, d: V.nearest(doubles(s, d), queries_of(s, d), 1, other_label=False).join(doubles(s, d).select("vec_id", F.col("label").alias("a")), "vec_id").join(doubles(s, d).select(F.col("vec_id").alias("other_id"), F.col("label").alias("b")), "other_id")
        .groupBy((F.col("a") == F.col("b")).alias("within")).agg(F.round(F.avg("cosine"), 6).alias("top"), F.count(F.lit(1)).alias("n")),
        f"SELECT a = b AS within, round(avg(cosine), 6) AS top, count(*) AS n FROM (SELECT * FROM ({NEAREST}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) = 1) GROUP BY ALL",
    ),
    "l10_copy_mixture": (
        lambda s, d: copy_mass(s, d, digits=15).where("source = 'the'").groupBy("item_id").agg(F.round(F.avg(0.3 * F.col("mass") + 0.7 * 0.05), 6).alias("p")),
        """SELECT item_id, round(avg(0.3::DOUBLE * mass + 0.7::DOUBLE * 0.05::DOUBLE), 6) AS p FROM (SELECT item_id, q, source, e / sum(e) OVER (PARTITION BY item_id, q) AS mass FROM (SELECT a.item_id, a.q, b.word AS source, sum(exp(-(a.q - b.q) / 4.0::DOUBLE)) AS e FROM
        (SELECT item_id, unnest(range(len(w))) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM eval_item)) a JOIN (SELECT item_id, unnest(range(len(w))) AS q, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM eval_item)) b
        ON a.item_id = b.item_id AND b.q < a.q AND b.q >= a.q - 16 GROUP BY ALL)) WHERE source = 'the' GROUP BY item_id""",
    ),
    "l11_table_alignment": (
        lambda s, d: V.alignment_distance(doubles(s, d)).agg(F.round(F.avg("distance"), 6).alias("distance"), F.count(F.lit(1)).alias("n_pairs")),
        f"""WITH m AS ({COVARIANCE}) SELECT round(avg(distance), 6) AS distance, count(*) AS n_pairs FROM (SELECT sum(CASE WHEN a.i = a.j THEN 1.0::DOUBLE ELSE 2.0 END * pow(a.cov - b.cov, 2) + CASE WHEN a.i = a.j THEN pow(a.mean_i - b.mean_i, 2) ELSE 0.0 END) AS distance FROM m a JOIN m b ON a.i = b.i AND a.j = b.j AND a.label < b.label GROUP BY a.label, b.label)""",
    ),
}
