"""Documents composed of spans of several domains, and spans parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.ordering import hash_int, hash_of, hash_ranked
from quernel.functions.text import snippet
from quernel.session import bounded_rows, small


#: Domains beyond this are refused.
MOST_DOMAINS = 1_000


def choose_domains(mixes: DataFrame, domains: DataFrame, least: int, most: int, seed: str, forced: str | None = None) -> DataFrame:
    """(mix_id, pos, domain): for each mix between least and most distinct domains, a forced one first.

    ``domains`` is a dimension of at most ``MOST_DOMAINS``; its product with the mixes is one row per mix and domain.
    """
    k = least + F.pmod(hash_int(seed + "-k", F.col("mix_id")), F.lit(most - least + 1))
    rank = Window.partitionBy("mix_id").orderBy(F.when(F.col("domain") == F.lit(forced), 0).otherwise(1), hash_of(seed, F.col("mix_id"), F.col("domain")), "domain")
    listed = bounded_rows(domains.select("domain").distinct(), MOST_DOMAINS, "the domains")
    pairs = mixes.select("mix_id", k.alias("k")).crossJoin(F.broadcast(mixes.sparkSession.createDataFrame(listed, "domain string")))
    return pairs.withColumn("pos", F.row_number().over(rank).cast("long")).where("pos <= k").select("mix_id", "pos", "domain")


def fill_spans(chosen: DataFrame, docs: DataFrame, n_words: Column | int, seed: str) -> DataFrame:
    """``chosen`` with doc_id and snippet: each domain's documents in hash order, over again when they end."""
    ranked = hash_ranked(docs, seed, "doc_id", ["domain"], "__rank")
    sizes = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("__size"))
    turns = hash_ranked(chosen.withColumn("__k", F.concat_ws("|", F.col("mix_id").cast("string"), F.col("domain"))), seed + "-turn", "__k", ["domain"], "__turn")
    due = turns.join(sizes, "domain").withColumn("__rank", F.pmod(F.col("__turn") - 1, F.col("__size")) + 1)
    return due.join(ranked, ["domain", "__rank"]).select("mix_id", "pos", "domain", "doc_id", snippet(F.col("text"), n_words).alias("snippet"))


def composed_documents(spans: DataFrame, tags: DataFrame) -> DataFrame:
    """(mix_id, text, switches): each mix's spans under their tags, with domain, char_offset and tag_len of each."""
    told = spans.join(small(tags.select("domain", "tag")), "domain")
    grouped = told.groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("pos", "domain", "tag", "snippet"))).alias("spans"))
    body = lambda x: F.concat(x["tag"], F.lit("\n"), x["snippet"], F.lit("\n"))
    before = lambda i: F.aggregate(F.slice("spans", 1, i), F.lit(0).cast("long"), lambda a, x: a + F.length(body(x)))
    switches = F.transform("spans", lambda x, i: F.struct(x["domain"].alias("domain"), before(i).alias("char_offset"), F.length(x["tag"]).alias("tag_len")))
    return grouped.select("mix_id", F.array_join(F.transform("spans", body), "").alias("text"), switches.alias("switches"))


def parsed_spans(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, span_pos, domain, body): a tag line opens a span that the next one ends; text before the first is dropped."""
    parts = docs.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), "\n<domain:")).alias("p", "part")).where("p > 0")
    named = parts.where(F.col("part").rlike(r"^[^>\n]+>\n"))
    return named.select(key, (F.col("p") - 1).cast("long").alias("span_pos"), F.regexp_extract("part", r"^([^>\n]+)>\n", 1).alias("domain"), F.regexp_replace("part", r"^[^>\n]+>\n", "").alias("body"))
