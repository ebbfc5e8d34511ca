"""Readers and writers: Parquet, JSON lines, separator-joined text, and a retry schedule for flaky opens."""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("domain", StringType()), StructField("side", StringType()), StructField("source", StringType()), StructField("text", StringType())])
SEPARATOR = "\n<|endofdoc|>\n"


def read_documents(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A Parquet source unified to ``DOCUMENT``; columns that it lacks are null."""
    df = spark.read.parquet(path)
    return df.select(*[(F.col(text if f.name == "text" else f.name) if (text if f.name == "text" else f.name) in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT])


def read_if_there(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """A Parquet source, or an empty table of ``schema`` where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a text field; malformed and blank lines are skipped."""
    rows = spark.read.schema(StructType([StructField("text", StringType())])).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("text").rlike(r"\S"))


def cached_or(spark: SparkSession, cache: str, source: Callable[[], DataFrame]) -> DataFrame:
    """The JSON cache at ``cache`` where there is one, else what ``source`` opens; the source isn't touched then."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return read_json_cache(spark, cache) if there else source()


def line_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length): where each line of the text files under ``path`` lies, from one scan.

    A file is one task here, as a line's place needs all bytes before it; files are scanned side by side.
    """
    schema = "path string, offset long, length long"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                system, place = FileSystem.from_uri(name)
                with system.open_input_stream(place) as stream, io.BufferedReader(stream, 1 << 20) as lines:
                    at, rows = 0, []
                    for line in lines:
                        rows.append((name, at, len(line.rstrip(b"\r\n"))))
                        at += len(line)
                        if len(rows) == 100_000:
                            yield pd.DataFrame(rows, columns=["path", "offset", "length"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["path", "offset", "length"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(scan, schema)


def lines_at(wanted: DataFrame) -> DataFrame:
    """(path, offset, line): the lines at the places of ``wanted`` (path, offset, length), each read by a seek.

    The places of a file are spread over tasks, so a file that holds a third of all lines is read by many.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = pd.Series([""] * len(frame), index=frame.index, dtype=object)
            for name, own in frame.groupby("path"):
                system, place = FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    for i, offset, length in zip(own.index, own["offset"], own["length"]):
                        file.seek(int(offset))
                        lines[i] = file.read(int(length)).decode("utf-8", "replace")
            yield frame[["path", "offset"]].assign(line=lines)

    return wanted.select("path", "offset", "length").mapInPandas(fetch, "path string, offset long, line string")


def write_json_cache(df: DataFrame, path: str) -> None:
    """The text column as JSON lines."""
    df.select("text").write.mode("overwrite").json(path)


def read_tagged(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """(domain, body) of the documents of separator-joined files that start with a domain tag."""
    docs = spark.read.option("lineSep", separator).text(path)
    pattern = r"(?s)^<domain:([^>]+)>\n(.*)$"
    return docs.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("domain"), F.regexp_extract("value", pattern, 2).alias("body"))


def write_tagged(df: DataFrame, path: str, separator: str = SEPARATOR) -> None:
    """(domain, text) as separator-joined files, each document under its tag."""
    df.select(F.concat(F.lit("<domain:"), F.col("domain"), F.lit(">\n"), F.col("text"))).write.mode("overwrite").option("lineSep", separator).text(path)


def retry_delays(tries: int = 6, base: int = 5, most: int = 90) -> list[int]:
    """Seconds to wait after each failed try."""
    return [min(most, base * 2**k) for k in range(tries)]


def opened(open_: Callable[[], DataFrame], retryable: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep, tries: int = 6) -> DataFrame:
    """``open_()``, tried again on errors that ``retryable`` accepts; the last error is raised."""
    for k, delay in enumerate(retry_delays(tries)):
        try:
            return open_()
        except Exception as error:
            if not retryable(error) or k == tries - 1:
                raise
            sleep(delay)
    raise ValueError("tries must be positive")
