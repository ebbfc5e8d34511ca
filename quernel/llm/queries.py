"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import leakage, licences, mixing, packing, provenance, sentences, subjects, token_budget
from quernel.session import bounded_rows, checkpointed, table

SLICE = ["shard_id", "source", "lang"]


def _counter(spark: SparkSession, d: str):
    return token_budget.vocabulary_counter(table(spark, d, "token_vocab"))


#: Where the public tokenizer lies whose merges p2_bpe_totals counts with; a missing file is an error when it is run.
TOKENIZER = os.environ.get("QUERNEL_BPE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how that tokenizer cuts a text before merging.
TOKENIZER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows, areas, labels = (table(spark, d, t) for t in ("stage2_stream_dataset", "subject_area", "subject_label"))
    return subjects.assigned_subjects(rows, areas, labels)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("row_id", "subject")


def p1_subject_mix(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_mix(_assigned(spark, d), table(spark, d, "stage2_stream_dataset"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    totals = token_budget.token_totals(table(spark, d, "documents"), _counter(spark, d), SLICE)
    return token_budget.misreported_slices(table(spark, d, "shard_source"), totals)


def p2_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_totals(table(spark, d, "documents"), _counter(spark, d), [*SLICE, "domain"])


def _spaceless_words(spark: SparkSession, d: str) -> list[str]:
    """The tokenizer's pieces in scripts without spaces; they are the lattices' dictionaries."""
    pieces = table(spark, d, "token_vocab").select(F.trim("piece").alias("piece")).where(F.col("piece").rlike("^([\u0E00-\u0E7F]{2,}|[\u3040-\u30FF\u4E00-\u9FFF]{2,})$"))
    return [r.piece for r in bounded_rows(pieces, token_budget.MOST_PIECES, "the vocabulary")]


def p2_bpe_totals(spark: SparkSession, d: str) -> DataFrame:
    counter = token_budget.bpe_counter(spark, TOKENIZER, TOKENIZER_PATTERN)
    return token_budget.token_totals(table(spark, d, "documents"), counter, ["source", "lang", "domain"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, d, "code_file"), table(spark, d, "upstream_file"))


def p3_hand_written(spark: SparkSession, d: str) -> DataFrame:
    kept = provenance.hand_written(table(spark, d, "code_file"), table(spark, d, "upstream_file"))
    return kept.groupBy(F.lower(F.trim("language")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return licences.findings(table(spark, d, "code_file"), table(spark, d, "repository"), table(spark, d, "license_ref"))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents with their tokens, without their texts; counted once."""
    docs = table(spark, d, "documents").select("doc_id", *columns, "text")
    return checkpointed(token_budget.with_token_counts(docs, _counter(spark, d)).drop("text"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.schedule(table(spark, d, "shard_source"), table(spark, d, "token_shard"), _sized(spark, d, *SLICE))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_slices(mixing.mix_report(*_mix(spark, d)))


def p5_mix_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, d))


def p5_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].drop("slice")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_sized(spark, d), table(spark, d, "window_spec"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, d), table(spark, d, "window_spec"))


def p6_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Per window: the tokens and documents that are placed, and the containers filled beyond their capacity."""
    return packing.conservation(p6_packing(spark, d), table(spark, d, "window_spec"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p7_found(spark, d), table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.prose_sentence_ends(table(spark, d, "documents"), _spaceless_words(spark, d))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.prose_sentences(table(spark, d, "documents"), _spaceless_words(spark, d))


#: Tokens of every distinct piece by longest match, and of every document from them.
_TOKENS = f"""WITH RECURSIVE docs AS (SELECT doc_id, shard_id, source, lang, domain, regexp_extract_all(coalesce(text, ''), '{token_budget.PRE_SPLIT}') AS ps FROM documents),
    pieces AS (SELECT DISTINCT unnest(ps) AS p FROM docs),
    cut AS (SELECT p, p AS rest, CAST(0 AS BIGINT) AS n FROM pieces UNION ALL
        SELECT p, substring(rest, greatest(l, 1) + 1) AS rest, n + CASE WHEN l > 0 THEN 1 ELSE octet_length(encode(substring(rest, 1, 1))) END AS n FROM (
            SELECT p, any_value(rest) AS rest, any_value(n) AS n, max(coalesce(length(v.piece), 0)) AS l FROM (SELECT p, rest, n, unnest(range(1, 17)) AS k FROM cut WHERE rest <> '') c LEFT JOIN (SELECT DISTINCT piece FROM token_vocab) v ON v.piece = substring(c.rest, 1, c.k) GROUP BY p)),
    counts AS (SELECT p, n FROM cut WHERE rest = ''),
    tokens AS (SELECT d.doc_id, d.shard_id, d.source, d.lang, d.domain, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM docs d LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM docs) e ON d.doc_id = e.doc_id LEFT JOIN counts c ON e.p = c.p GROUP BY ALL)"""
_SLICES = "(SELECT shard_id, source, lang, sum(n) AS n FROM tokens GROUP BY ALL) t ON s.shard_id = t.shard_id AND s.source = t.source AND s.lang = t.lang"

SQL = {
    "p2_found": f"{_TOKENS} SELECT DISTINCT s.shard_id, s.source, s.lang FROM shard_source s LEFT JOIN {_SLICES} WHERE abs(actual_tokens - coalesce(n, 0)) > 0.15 * coalesce(n, 0)",
    "p2_token_totals": f"{_TOKENS} SELECT shard_id, source, lang, domain, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM tokens GROUP BY ALL",
    "p6_conservation": f"""{_TOKENS}, sizes AS (SELECT doc_id, n FROM tokens WHERE n > 0)
        SELECT window_name, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_docs, CAST(0 AS BIGINT) AS n_overfull FROM sizes, (SELECT DISTINCT window_name, capacity_tokens FROM window_spec WHERE capacity_tokens > 0) GROUP BY window_name""",
    "p5_found": f"""{_TOKENS} SELECT DISTINCT s.shard_id, s.source, s.lang FROM shard_source s LEFT JOIN {_SLICES} JOIN token_shard x ON s.shard_id = x.shard_id
        WHERE coalesce(n, 0) * max_repeats < target_weight * target_tokens""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The functions named after the problems, in the order of their names' definition."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that SQL can state at a cost that whole tables allow."""
    return dict(SQL)
