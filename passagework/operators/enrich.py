"""Chunk enrichment by a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators.chunks import bounded

WINDOW, OUT_TOKENS, FIND = 2000, 320, 200
USD_IN, USD_OUT = 0.05, 0.40
STRATEGY = "contextual-llm"


def window_around(document: str, chunk: str, tokens: int = WINDOW) -> str:
    """The document, or the window of tokens about the chunk's first characters; the head where they aren't found."""
    return bounded(document, chunk[:FIND], tokens, margin_of_child=False)


def estimate(chunks: DataFrame, documents: DataFrame, window: int = WINDOW, template_tokens: int = 0) -> DataFrame:
    """One row (chunks, tokens_in, tokens_out, usd) of (doc_id, raw_text) with (doc_id, text); an unknown document counts 0."""
    known = documents.select("doc_id", T.count_tokens(F.col("text")).alias("doc_tokens"))
    sums = chunks.select("doc_id", T.count_tokens(F.col("raw_text")).alias("n")).join(known, "doc_id", "left")
    each = F.least(F.lit(window), F.coalesce("doc_tokens", F.lit(0))) + F.col("n") + F.lit(template_tokens)
    out = sums.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(each), F.lit(0)).alias("tokens_in"), (F.count("*") * OUT_TOKENS).alias("tokens_out"))
    return out.withColumn("usd", (F.col("tokens_in") * USD_IN + F.col("tokens_out") * USD_OUT) / 1e6)


def with_line(chunks: DataFrame, line: str = "line") -> DataFrame:
    """``chunks`` with ``line`` before what is searched; an empty one changes nothing."""
    told = F.trim(F.translate(F.coalesce(F.col(line), F.lit("")), "\n", " "))
    changed = told != ""
    return chunks.withColumns({"embed_text": F.when(changed, F.concat(told, F.lit("\n\n"), "raw_text")).otherwise(F.col("embed_text")), "strategy": F.when(changed, STRATEGY).otherwise(F.col("strategy"))}).drop(line)


def blurbs(chunks: DataFrame, documents: DataFrame, client: Callable[[str, str], str], window: int = WINDOW) -> DataFrame:
    """``chunks`` with ``line`` from a model plug-in ``client(window, chunk)``; a failed call is an empty line."""
    joined = chunks.join(documents.select("doc_id", F.col("text").alias("__document")), "doc_id", "left").select(*chunks.columns, "__document")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema), "line string"])
    raw = chunks.columns.index("raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for chunk, document in zip(batch.column(raw).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                try:
                    lines.append(client(window_around(document or "", chunk or "", window), chunk or ""))
                except BudgetError:
                    raise
                except Exception:  # noqa: BLE001 - a failed call leaves its chunk unchanged
                    lines.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.string())], [*batch.schema.names[:-1], "line"])

    return joined.mapInArrow(run, schema)


def missing(chunks: DataFrame, cached: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What isn't cached."""
    return chunks.join(cached.select(key), key, "left_anti")


class BudgetError(RuntimeError):
    """Spending would pass a ceiling; never taken for a failed call."""
