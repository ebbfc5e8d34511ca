"""Streaming queries, each drained over what is there and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions.text import words
from quernel.streaming import monitors as M

CENTS = "CAST(round(value * 100) AS BIGINT)"


def in_micros(df, *columns):
    """``columns`` with the start as microseconds since 1970."""
    return df.select(F.unix_micros("start").alias("start_us"), *columns)


QUERIES = {
    "x1_stream_counts": (
        lambda s, d: M.drained(M.file_stream(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete"),
        "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    ),
    "x2_stateful_packing": (
        lambda s, d: M.drained(M.packed_stream(M.file_stream(s, d, "documents"), "source", words(F.col("text")), 257), "append").groupBy("stream").agg(F.count(F.lit(1)).alias("n_windows"), F.max("chunk_id").alias("last")),
        """SELECT source AS stream, CAST(n // 257 AS BIGINT) AS n_windows, CAST(n // 257 - 1 AS BIGINT) AS last FROM (SELECT source, sum(len(regexp_extract_all(text, '\\S+'))) AS n FROM documents GROUP BY source) WHERE n >= 257""",
    ),
    "ext_tumbling_counts": (
        lambda s, d: in_micros(M.drained(M.tumbling_counts(M.file_stream(s, d, "events"), "ts", "1 day", "event_type"), "complete"), "event_type", "n"),
        "SELECT epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
    "ext_sliding_sums": (
        lambda s, d: in_micros(M.drained(M.sliding_means(M.file_stream(s, d, "events"), "ts", F.round(F.col("value") * 100).cast("long"), "2 days", "1 day", "event_type"), "complete"), "event_type", "total", "n"),
        f"""SELECT epoch_us(CAST(date_trunc('day', ts) - to_days(k) AS TIMESTAMP)) AS start_us, event_type, CAST(sum({CENTS}) AS BIGINT) AS total, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL""",
    ),
    "ext_user_sessions": (
        lambda s, d: in_micros(M.drained(M.sessions(M.file_stream(s, d, "events"), "ts", "420 seconds", "user_id"), "complete"), "user_id", "n"),
        """SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 420 SECONDS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""",
    ),
}
