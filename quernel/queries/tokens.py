"""Vocabularies, backoff encoding and compression figures."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import ordering as H
from quernel.functions import text as T
from quernel.operators import vocabulary as V
from quernel.operators.quality import STOPWORDS
from quernel.functions.bpe import bpe_codec
from quernel.session import small, table

#: Where a public tokenizer's ranks lie; a missing file is an error when the query is run.
RANKS = os.environ.get("QUERNEL_CODEC_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that tokenizer cuts a text before merging.
RANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents) GROUP BY word"
SIGNS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
SURFACE = f"SELECT word AS piece, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM ({COUNTS}) QUALIFY r < 800"
SYLLABLE = f"SELECT segment AS piece, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY sum(n) DESC, segment) - 1 AS r FROM (SELECT unnest(regexp_extract_all(word, '{V.SYLLABLES}')) AS segment, n FROM ({COUNTS})) GROUP BY segment QUALIFY r < 400"
AFFIX = rf"^({'|'.join(V.PREFIXES)})?([a-z'']{{3,}}?)({'|'.join(V.SUFFIXES)})?$"
PARTS = f"CASE WHEN regexp_matches(word, '{AFFIX}') THEN list_filter([regexp_extract(word, '{AFFIX}', 1), regexp_extract(word, '{AFFIX}', 2), regexp_extract(word, '{AFFIX}', 3)], lambda x: x <> '') ELSE [word] END"
MORPHEME = f"SELECT segment AS piece, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY sum(n) DESC, segment) - 1 AS r FROM (SELECT unnest({PARTS}) AS segment, n FROM ({COUNTS})) GROUP BY segment QUALIFY r < 600"


def counts(s, d):
    return V.word_counts(table(s, d, "documents"), T.alpha_words(F.col("text")))


def surface(s, d):
    return V.top_pieces(counts(s, d), "word", 800)


def syllable(s, d):
    return V.top_pieces(V.segment_counts(counts(s, d), V.syllables(F.col("word"))), "segment", 400)


def morpheme(s, d):
    return V.top_pieces(V.segment_counts(counts(s, d), V.morphemes(F.col("word"))), "segment", 600)


def levels(s, d):
    return V.backoff_levels(counts(s, d), surface(s, d), syllable(s, d), morpheme(s, d))


def _known(level: str, segments: str, vocab: str) -> str:
    return f"SELECT word, bool_and(piece IN (SELECT piece FROM ({vocab}))) AS {level}, count(*) AS n_{level} FROM (SELECT word, unnest({segments}) AS piece FROM ({COUNTS})) GROUP BY word"


SYLLABLE_PARTS = f"regexp_extract_all(word, '{V.SYLLABLES}')"
LEVELS = f"""SELECT word, n, CASE WHEN surface THEN 'surface' WHEN syllable THEN 'syllable' WHEN morpheme THEN 'morpheme' ELSE 'byte' END AS level, CAST(CASE WHEN surface THEN 1 WHEN syllable THEN n_syllable WHEN morpheme THEN n_morpheme ELSE octet_length(encode(word)) END AS BIGINT) AS n_tokens
    FROM ({COUNTS}) JOIN ({_known("surface", "[word]", SURFACE)}) USING (word) JOIN ({_known("syllable", SYLLABLE_PARTS, SYLLABLE)}) USING (word) JOIN ({_known("morpheme", PARTS, MORPHEME)}) USING (word)"""


def compression(s, d):
    docs = table(s, d, "documents").where("text is not null")
    sized = docs.select("domain", T.word_count(F.col("text")).alias("w"), F.size(T.words_and_signs(F.col("text"))).cast("long").alias("t"), T.byte_count(F.col("text")).alias("b"))
    out = sized.groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.sum("t").alias("n_tokens"), F.sum("b").alias("n_bytes"))
    return out.withColumn("tokens_per_word", F.round(F.col("n_tokens") / F.greatest("n_words", F.lit(1)), 6)).withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.greatest("n_tokens", F.lit(1)), 6))


def bytes_per_token(s, d, pooled, most=150):
    """Over the first ``most`` documents of each domain in hash order (None: over all)."""
    docs = table(s, d, "documents").where(T.not_blank(F.col("text")) & F.col("domain").isNotNull()).select("domain", "doc_id", F.size(T.words_and_signs(F.col("text"))).cast("long").alias("t"), T.byte_count(F.col("text")).alias("b"))
    first = H.hash_ranked(docs, "bpt", "doc_id", ["domain"]).where(F.col("rank") <= most) if most else docs
    keys = [] if pooled else ["domain"]
    return first.groupBy(*keys).agg(F.round(F.sum("b") / F.sum("t"), 6).alias("bytes_per_token"), F.count(F.lit(1)).alias("n_docs"))


FIRST = f"SELECT domain, len({SIGNS}) AS t, octet_length(encode(text)) AS b FROM documents WHERE regexp_matches(text, '\\S') AND domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5('bpt|' || doc_id), doc_id) <= 150"
EVERY = f"SELECT domain, len({SIGNS}) AS t, octet_length(encode(text)) AS b FROM documents WHERE regexp_matches(text, '\\S') AND domain IS NOT NULL"

def codec_round_trip(s, d):
    """Every text encoded by a public tokenizer and decoded again."""
    encode, decode = bpe_codec(s, RANKS, RANKS_PATTERN)
    ids = table(s, d, "documents").where("text is not null").select("doc_id", encode("text").alias("ids"))
    return ids.select("doc_id", F.md5(decode("ids")).alias("decoded"), (F.size("ids") > 0).alias("has_ids"))


QUERIES = {
    "a1_words_per_side": (
        lambda s, d: table(s, d, "documents").groupBy("domain", "side").agg(F.sum(F.coalesce(T.word_count(F.col("text")), F.lit(0))).alias("n_words")),
        "SELECT domain, side, CAST(sum(coalesce(len(regexp_extract_all(text, '\\S+')), 0)) AS BIGINT) AS n_words FROM documents GROUP BY ALL",
    ),
    "a2_documents_per_domain": (
        lambda s, d: table(s, d, "documents").groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources")),
        "SELECT domain, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM documents GROUP BY domain",
    ),
    "a5_word_counts": (counts, COUNTS),
    "a6_syllable_counts": (
        lambda s, d: V.segment_counts(counts(s, d), V.syllables(F.col("word"))),
        f"SELECT segment, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest({SYLLABLE_PARTS}) AS segment, n FROM ({COUNTS})) GROUP BY segment",
    ),
    "a6_morpheme_counts": (
        lambda s, d: V.segment_counts(counts(s, d), V.morphemes(F.col("word"))),
        f"SELECT segment, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest({PARTS}) AS segment, n FROM ({COUNTS})) GROUP BY segment",
    ),
    "a7_top_vocabulary": (surface, f"SELECT piece, r + 4 AS id, n FROM ({SURFACE})"),
    "a8_compression_report": (
        compression,
        f"""SELECT domain, n_docs, n_words, n_tokens, n_bytes, round(n_tokens / greatest(n_words, 1)::DOUBLE, 6) AS tokens_per_word, round(n_bytes / greatest(n_tokens, 1)::DOUBLE, 6) AS bytes_per_token FROM (SELECT domain, count(*) AS n_docs,
        CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words, CAST(sum(len({SIGNS})) AS BIGINT) AS n_tokens, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY domain)""",
    ),
    "a9_bytes_per_token": (lambda s, d: bytes_per_token(s, d, False), f"SELECT domain, round(sum(b)::DOUBLE / sum(t), 6) AS bytes_per_token, count(*) AS n_docs FROM ({FIRST}) GROUP BY domain"),
    "a10_pooled_bytes_per_token": (lambda s, d: bytes_per_token(s, d, True), f"SELECT round(sum(b)::DOUBLE / sum(t), 6) AS bytes_per_token, count(*) AS n_docs FROM ({FIRST})"),
    "a9_all_documents": (lambda s, d: bytes_per_token(s, d, False, None), f"SELECT domain, round(sum(b)::DOUBLE / sum(t), 6) AS bytes_per_token, count(*) AS n_docs FROM ({EVERY}) GROUP BY domain"),
    "a10_all_documents": (lambda s, d: bytes_per_token(s, d, True, None), f"SELECT round(sum(b)::DOUBLE / sum(t), 6) AS bytes_per_token, count(*) AS n_docs FROM ({EVERY})"),
    "a12_blend_provenance": (
        lambda s, d: table(s, d, "shard_source").groupBy("shard_id", "source").agg(F.round(F.sum("target_weight"), 6).alias("target_weight"), F.sum(F.coalesce("actual_tokens", F.lit(0.0))).alias("actual_tokens"))
        .withColumn("actual_fraction", F.round(F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(Window.partitionBy("shard_id")), F.lit(0.0)), 6)),
        """SELECT shard_id, source, round(sum(target_weight), 6) AS target_weight, sum(coalesce(actual_tokens, 0))::DOUBLE AS actual_tokens, round(sum(coalesce(actual_tokens, 0)) / nullif(sum(sum(coalesce(actual_tokens, 0))) OVER (PARTITION BY shard_id), 0), 6)::DOUBLE AS actual_fraction
        FROM shard_source GROUP BY shard_id, source""",
    ),
    "k4_token_budget": (
        lambda s, d: H.budget_trim(table(s, d, "documents").where(T.not_blank(F.col("text"))).select("shard_id", "doc_id", F.size(T.words_and_signs(F.col("text"))).cast("long").alias("n_tokens")), "n_tokens", F.lit(5000), "tokens", "doc_id", ["shard_id"])
        .groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")),
        f"""SELECT shard_id, count(*) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens FROM (SELECT shard_id, len({SIGNS}) AS t, coalesce(sum(len({SIGNS})) OVER (PARTITION BY shard_id ORDER BY md5('tokens|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM documents WHERE regexp_matches(text, '\\S')) WHERE before < 5000 GROUP BY shard_id""",
    ),
    "t1_pair_counts": (
        lambda s, d: V.pair_counts(counts(s, d)),
        f"SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substring(word, i, 1) AS a, substring(word, i + 1, 1) AS b, n FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM ({COUNTS}))) GROUP BY a, b",
    ),
    "t3_syllable_vocabulary": (syllable, f"SELECT piece, r + 4 AS id, n FROM ({SYLLABLE})"),
    "t3_morpheme_vocabulary": (morpheme, f"SELECT piece, r + 4 AS id, n FROM ({MORPHEME})"),
    "t4_backoff_levels": (levels, LEVELS),
    "t5_text_levels": (
        lambda s, d: table(s, d, "eval_item").select("item_id", F.explode(T.alpha_words(F.col("text"))).alias("word")).join(levels(s, d).drop("n"), "word").groupBy("item_id", "level").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n_tokens").alias("n_tokens")),
        f"SELECT item_id, level, count(*) AS n_words, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM eval_item) JOIN ({LEVELS}) USING (word) GROUP BY ALL",
    ),
    "t6_vocabulary_offsets": (
        lambda s, d: reduce(DataFrame.unionByName, [v.agg((F.count(F.lit(1)) + more).alias("size")).select(F.lit(kind).alias("kind"), F.lit(i).alias("type_id"), "size") for i, (kind, v, more) in enumerate([("surface", surface(s, d), 4), ("syllable", syllable(s, d), 4), ("morpheme", morpheme(s, d), 4), ("byte", s.range(0), 260)])])
        .withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("type_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
        f"""SELECT kind, type_id, size, CAST(coalesce(sum(size) OVER (ORDER BY type_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT 'surface' AS kind, 0 AS type_id, count(*) + 4 AS size FROM ({SURFACE})
        UNION ALL SELECT 'syllable', 1, count(*) + 4 FROM ({SYLLABLE}) UNION ALL SELECT 'morpheme', 2, count(*) + 4 FROM ({MORPHEME}) UNION ALL SELECT 'byte', 3, 260)""",
    ),
    "t7_dispatch_by_kind": (
        lambda s, d: table(s, d, "documents").where("text is not null").join(small(table(s, d, "domain_dim").select("domain", "tokenizer_kind")), "domain")
        .select("doc_id", "tokenizer_kind", F.when(F.col("tokenizer_kind") == "bpe", F.size(T.words_and_signs(F.col("text")))).otherwise(F.size(T.alpha_words(F.col("text")))).cast("long").alias("n_tokens")),
        f"SELECT doc_id, tokenizer_kind, CAST(CASE WHEN tokenizer_kind = 'bpe' THEN len({SIGNS}) ELSE len(regexp_extract_all(lower(text), '[a-z'']+')) END AS BIGINT) AS n_tokens FROM documents JOIN domain_dim USING (domain) WHERE text IS NOT NULL",
    ),
    "t11_stopword_ids": (
        lambda s, d: table(s, d, "token_vocab").join(F.broadcast(s.createDataFrame([(v,) for w in STOPWORDS for v in (w, " " + w, w.capitalize(), " " + w.capitalize())], "piece string")), "piece").select("token_id").distinct(),
        f"SELECT DISTINCT token_id FROM token_vocab WHERE piece IN (SELECT v FROM (SELECT unnest([w, ' ' || w, upper(w[1]) || w[2:], ' ' || upper(w[1]) || w[2:]]) AS v FROM (VALUES {', '.join(f"('{w}')" for w in STOPWORDS)}) t(w)))",
    ),
    "t2_codec_round_trip": (
        codec_round_trip,
        "SELECT doc_id, md5(text) AS decoded, text <> '' AS has_ids FROM documents WHERE text IS NOT NULL",
    ),
    "t12_range_guard": (
        lambda s, d: table(s, d, "token_vocab").agg(F.max("token_id").alias("largest"), (F.max("token_id") < 65536).alias("fits")),
        "SELECT max(token_id) AS largest, max(token_id) < 65536 AS fits FROM token_vocab",
    ),
    "t_bytes_of_words": (
        lambda s, d: table(s, d, "token_vocab").select("token_id", F.hex(F.encode("piece", "utf-8")).alias("hexed")).select("token_id", F.posexplode(F.regexp_extract_all("hexed", F.lit("(..)"), 1)).alias("pos", "h"))
        .select("token_id", F.col("pos").cast("long").alias("pos"), (F.conv("h", 16, 10).cast("int") + V.RESERVED).alias("id")),
        "SELECT token_id, unnest(range(len(h) // 2)) AS pos, CAST(unnest(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::INT)) AS INT) + 4 AS id FROM (SELECT token_id, hex(encode(piece)) AS h FROM token_vocab)",
    ),
}
