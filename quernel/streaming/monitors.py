"""Structured Streaming: windowed monitors and a packer that carries its buffer across documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernel.session import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` as a stream of its files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    path = f"{folder}/{name}.parquet"
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once it has read all that is there.

    Results and offsets go to new folders of the cluster's shared checkpoint folder. In mode ``complete``
    each batch replaces the one before, in mode ``append`` batches add up, each written under its own number,
    so that a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/offsets").foreachBatch(write).start()
    query.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(f"{place}/out")
    return done.select(*stream.columns)


def tumbling_counts(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """(start, keys, n): events per tumbling window; later than ``late`` they no longer count when the mode drops state."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_means(events: DataFrame, ts: str, value: Column, width: str, slide: str, *keys: str) -> DataFrame:
    """(start, keys, total, n): sums and counts per sliding window."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", "1 hour")
    return timed.groupBy(F.window("__ts", width, slide).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    """(start, end, keys, n): sessions that a gap ends."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", "1 hour")
    return timed.groupBy(F.session_window("__ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def packer(size: int) -> Callable:
    """The function for ``applyInPandasWithState`` that cuts each stream's items into windows of ``size``.

    The state is the buffer of fewer than ``size`` items; documents are taken as they come, so memory is
    bounded by one Arrow batch.
    """

    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, made = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else 0
        for frame in frames:
            out = []
            for items in frame["items"]:
                if items is not None:
                    buffer.extend(items)
                while len(buffer) >= size:
                    out.append((*key, made, buffer[:size]))
                    buffer, made = buffer[size:], made + 1
            if out:
                yield pd.DataFrame(out, columns=["stream", "chunk_id", "items"])
        state.update((buffer, made))

    return pack


def packed_stream(docs: DataFrame, stream: str, items: Column, size: int) -> DataFrame:
    """(stream, chunk_id, items) of a streaming ``docs``: windows of exactly ``size`` items, as they fill."""
    keyed = docs.select(F.col(stream).alias("stream"), items.alias("items"))
    return keyed.groupBy("stream").applyInPandasWithState(
        packer(size), "stream string, chunk_id long, items array<string>", "buffer array<string>, made long", "append", GroupStateTimeout.NoTimeout
    )
