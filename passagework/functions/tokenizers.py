"""Tokenizer plug-ins (K01): what counts tokens and cuts texts into windows of them."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T

PART = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(Protocol):
    def count(self, text: Column) -> Column:
        """Tokens of a text; of null 0."""
        ...

    def windows(self, text: Column, size: int, stride: int) -> Column:
        """Texts of the windows of ``size`` tokens that begin every ``stride``, stripped; of null or no tokens none."""
        ...


class Words:
    """Words with the white space before them; all in the JVM."""

    def count(self, text: Column) -> Column:
        return T.count_tokens(text)

    def windows(self, text: Column, size: int, stride: int) -> Column:
        def cut(t: Column) -> Column:
            last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / stride)).cast("int")
            made = F.transform(F.sequence(F.lit(0), last), lambda i: T.strip(F.array_join(F.slice(t, i * stride + 1, size), "")))
            return F.when(F.size(t) > 0, made)

        # the array of tokens is bound to a variable, so it is made once
        return F.get(F.transform(F.array(T.tokens(text)), cut), F.lit(0))


@functools.lru_cache(2)
def _encoding(data: bytes, pattern: str):  # noqa: ANN202 - a tiktoken.Encoding
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("passagework", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts in parts of up to ``PART`` of them, so that results don't pile up."""
    for batch in batches:
        for a in range(0, len(batch), PART):
            yield batch.iloc[a : a + PART]


@dataclass
class BytePairs:
    """Byte-level BPE by a vocabulary file of lines ``base64 rank``, read by the driver and sent to the tasks."""

    spark: SparkSession
    path: str = VOCABULARY
    pattern: str = PATTERN

    def __post_init__(self) -> None:
        with open(self.path, "rb") as f:
            self.sent = self.spark.sparkContext.broadcast(f.read())

    def count(self, text: Column) -> Column:
        sent, pattern = self.sent, self.pattern

        @F.pandas_udf("long")
        def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = _encoding(sent.value, pattern).encode_ordinary
            for batch in _parts(batches):
                yield pd.Series([len(encode(x)) if x else 0 for x in batch], dtype="int64")

        return size(text)

    def windows(self, text: Column, size: int, stride: int) -> Column:
        sent, pattern = self.sent, self.pattern

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            enc = _encoding(sent.value, pattern)
            for batch in _parts(batches):
                out = []
                for x in batch:
                    ids = enc.encode_ordinary(x) if x else []
                    starts = range(0, max(0, -(-(len(ids) - size) // stride)) * stride + 1, stride) if ids else ()
                    out.append([enc.decode(ids[i : i + size]).strip() for i in starts])
                yield pd.Series(out)

        return cut(text)
