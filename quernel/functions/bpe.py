"""Token ids of an existing tokenizer, and text back from ids. Tokenizers are read from a file, never trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def bpe_codec(spark, path: str, pattern: str):
    """(encode, decode): functions of Columns, text -> array<int> and back; special strings are ordinary text.

    The file is read once, on the driver. Null stays null; ids that the tokenizer lacks raise an error.
    """
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(shared.value, pattern)
        for texts in batches:
            yield pd.Series([None if t is None else ids for t, ids in zip(texts, e.encode_ordinary_batch([t or "" for t in texts], num_threads=1))], dtype=object)

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(shared.value, pattern)
        for ids in batches:
            yield pd.Series([None if i is None else t for i, t in zip(ids, e.decode_batch([[] if i is None else list(i) for i in ids], num_threads=1))], dtype=object)

    return encode, decode
