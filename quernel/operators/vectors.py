"""Vector tables: nearest rows in blocks, moments, alignment, averaging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query vectors that one pass over the table is held against.
BLOCK = 20_000


def dot(a: Column, b: Column) -> Column:
    """The scalar product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; null where one is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def _foremost(query: np.ndarray, row: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest cosines; ties go to the smaller row id."""
    order = np.lexsort((row, -cosine, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = order[place < k]
    return query[place < k], row[kept], cosine[kept]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, other_label: bool = True) -> DataFrame:
    """(vec_id, other_id, cosine): for each query its k most similar rows, of other labels only if asked.

    Queries go to the executors in blocks of ``BLOCK``, each held against all rows by matrix products; a task
    keeps k rows per query, and the tasks' rows are merged per query. Passes grow with the queries, the
    memory of a task doesn't. Ties go to the smaller id. Null vectors and rows against themselves are left out.
    """
    from pyspark.sql import Window

    spark, found = vectors.sparkSession, None
    ids = queries.where("embedding is not null").select("vec_id", "label", "embedding")
    passes = max(1, -(-ids.count() // BLOCK))
    for b in range(passes):
        block = ids.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == b).toPandas()
        matrix = np.array(block["embedding"].tolist(), np.float64) if len(block) else np.zeros((0, 1))
        unit = matrix / np.maximum(1e-300, np.linalg.norm(matrix, axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), block["label"].to_numpy(), unit))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q_ids, q_labels, q_unit = shared.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, row id, cosine
            for frame in frames:
                if not len(q_ids) or not len(frame):
                    continue
                rows = np.array(frame["embedding"].tolist(), np.float64)
                rows /= np.maximum(1e-300, np.linalg.norm(rows, axis=1, keepdims=True))
                ids_, labels = frame["vec_id"].to_numpy(), frame["label"].to_numpy()
                found = [best]
                for lo in range(0, len(q_ids), 1024):
                    own = slice(lo, lo + 1024)
                    sims = q_unit[own] @ rows.T
                    sims[ids_[None] == q_ids[own, None]] = -np.inf
                    if other_label:
                        sims[labels[None] == q_labels[own, None]] = -np.inf
                    # All that reach the k-th largest, ties with it included.
                    least = np.partition(sims, -k, axis=1)[:, -k, None] if sims.shape[1] > k else -np.inf
                    q, r = np.nonzero((sims >= least) & (sims > -np.inf))
                    found.append((q + lo, ids_[r], sims[q, r]))
                best = _foremost(*map(np.concatenate, zip(*found)), k)
            if len(best[0]):
                yield pd.DataFrame({"vec_id": q_ids[best[0]], "other_id": best[1], "cosine": best[2]})

        part = vectors.where("embedding is not null").select("vec_id", "label", "embedding").mapInPandas(scan, "vec_id long, other_id long, cosine double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def moments(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, i, j, n, s_i, s_j, s_ij) for i <= j: sums from which means and covariances follow.

    Each task adds its rows' outer products in place and sends one matrix per label, whatever its rows.
    """
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for name, group in frame.groupby(label):
                x = np.array(group["embedding"].tolist(), np.float64)
                n, s, p = sums.get(name, (0, 0.0, 0.0))
                sums[name] = n + len(x), s + x.sum(0), p + x.T @ x
        for name, (n, s, p) in sums.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({label: name, "i": i, "j": j, "n": n, "s_i": s[i], "s_j": s[j], "s_ij": p[i, j]})

    parts = vectors.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).select(label, "embedding").mapInPandas(add, f"{label} int, i int, j int, n long, s_i double, s_j double, s_ij double")
    return parts.groupBy(label, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s_i", "s_j", "s_ij")])


def covariances(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, i, j, mean_i, mean_j, cov): sample covariance, over at least one degree of freedom."""
    cov = (F.col("s_ij") - F.col("s_i") * F.col("s_j") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    return moments(vectors, label).select(label, "i", "j", (F.col("s_i") / F.col("n")).alias("mean_i"), (F.col("s_j") / F.col("n")).alias("mean_j"), cov.alias("cov"))


def alignment_distance(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, distance) for a < b: squared differences of the labels' means and covariances, summed."""
    m = covariances(vectors, label)
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, F.expr(f"a.i = b.i and a.j = b.j and a.{label} < b.{label}"))
    twice = F.when(F.col("a.i") == F.col("a.j"), 1.0).otherwise(2.0)
    means = F.when(F.col("a.i") == F.col("a.j"), F.pow(F.col("a.mean_i") - F.col("b.mean_i"), F.lit(2.0))).otherwise(0.0)
    return pairs.groupBy(F.col(f"a.{label}").alias("a"), F.col(f"b.{label}").alias("b")).agg(F.sum(twice * F.pow(F.col("a.cov") - F.col("b.cov"), F.lit(2.0)) + means).alias("distance"))


def averaged(a: DataFrame, b: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """(1 - alpha) * a + alpha * b, element by element.

    The join is full outer; a key that one side lacks or whose lengths differ raises an error when it is met.
    """
    joined = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key, "full")
    fits = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.size("__a") == F.size("__b"))
    mixed = F.zip_with("__a", "__b", lambda x, y: x * (1 - alpha) + y * alpha)
    return joined.select(key, F.when(fits, mixed).otherwise(F.raise_error(F.lit("tables differ in keys or shapes"))).alias(value))


def state_copy(child: DataFrame, parent: DataFrame, key: str, value: str) -> DataFrame:
    """``child`` with the parent's value where key and length match; ``origin`` says loaded, resized or fresh."""
    joined = child.select(key, F.col(value).alias("__c")).join(parent.select(key, F.col(value).alias("__p")), key, "left")
    origin = F.when(F.col("__p").isNull(), "fresh").when(F.size("__p") == F.size("__c"), "loaded").otherwise("resized")
    return joined.select(key, F.when(origin == "loaded", F.col("__p")).otherwise(F.col("__c")).alias(value), origin.alias("origin"))
