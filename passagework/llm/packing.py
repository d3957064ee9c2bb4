"""Vector bin packing of training examples by the dot-product heuristic.

A pack is limited in tokens, segments and loss-bearing tokens at once. The open pack
takes, of the examples that still fit, the one whose demand has the largest dot
product with what is left of the pack (both as shares of the limits; ties go to the
first example by id), until none fits; then the next pack opens. The heuristic runs
within groups of about ``GROUP`` examples, drawn by a hash of the id, in parallel;
a group leaves at most its last packs less full, and only ids and counts are shuffled.

An example is a sequence of segments (turns), and one over a limit is cut along it: a
piece takes segments as long as they fit; a segment that fits no piece is cut between
tokens where the piece is full. A piece's tokens, segments and loss tokens are those of
its own range of tokens; a segment that is cut counts in each piece that has part of it.

Cases: nothing is dropped; an example without tokens still takes a place. Null ids are
dropped. Rows of one id are one example in ``pack``, in the order of ``at``, so repeated
rows of a document make it as much longer. Null counts are 0. An empty table gives an
empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMITS = {"tokens": 4096, "segments": 32, "loss_tokens": 3072}
GROUP = 4096
NAMES = ["tokens", "segments", "loss_tokens"]


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(2)
def encoder(data: bytes):  # noqa: ANN201 - a tiktoken.Encoding
    """The tokenizer of a vocabulary file's content; a worker makes it once."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text: str, name: str, path: str = VOCABULARY) -> DataFrame:
    """``rows`` with the column ``name`` (tokens of ``text``; null: 0) in the place of ``text``.

    The vocabulary is read by the driver and sent out; a file of a tokenizer doesn't grow with the data.
    """
    at = rows.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + f", `{name}` bigint"
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64())], [*(n for i, n in enumerate(batch.schema.names) if i != at), name])

    return rows.mapInArrow(run, schema)


def cut(segments: Iterable[tuple[int, int]], limits: Iterable[int]) -> list[tuple[int, int, int]]:
    """Demands (tokens, segments, loss tokens) of the pieces of one example, in order.

    ``segments`` are its (tokens, loss tokens), the loss tokens last in each.
    """
    most, most_segments, most_loss = limits
    out, tokens, count, loss = [], 0, 0, 0
    for size, bearing in segments:
        plain = size - bearing
        whole = size <= most and bearing <= most_loss
        while True:
            if whole:
                a, b = (plain, bearing) if tokens + size <= most and loss + bearing <= most_loss else (0, 0)
            else:
                a = min(plain, most - tokens)
                b = min(bearing, most - tokens - a, most_loss - loss) if a == plain else 0
            if count < most_segments and (a + b or size == 0):
                tokens, count, loss, plain, bearing = tokens + a + b, count + 1, loss + b, plain - a, bearing - b
                if not plain + bearing:
                    break
            out.append((tokens, count, loss))
            tokens, count, loss = 0, 0, 0
    return [*out, (tokens, count, loss)] if count or not out else out


def segments_of(tokens: int, segments: int, loss: int) -> list[tuple[int, int]]:
    """(tokens, loss tokens) of the segments of one row: equal ones, the row's loss tokens last."""
    ends = [tokens * i // segments for i in range(segments + 1)]
    return [(b - a, max(0, b - max(a, tokens - loss))) for a, b in itertools.pairwise(ends)]


def pieces(rows: np.ndarray, first: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Demands of the pieces of examples, whose they are, their numbers, and the tokens before them.

    Example i has the rows from first[i] to first[i + 1], in order.
    """
    if not len(rows):
        return np.zeros((0, 3), np.int64), *[np.zeros(0, np.int64)] * 3
    if (rows[:, 2] > rows[:, 0]).any():
        raise ValueError("a row has more loss tokens than tokens")
    demand = np.add.reduceat(rows, first[:-1], axis=0)
    n = np.ones(len(demand), np.int64)
    parts = {}
    for i in np.flatnonzero((demand > limits).any(1)).tolist():
        turns = itertools.chain.from_iterable(segments_of(*x) for x in rows[first[i] : first[i + 1]].tolist())
        parts[i] = np.array(cut(turns, limits.tolist()), np.int64)
        n[i] = len(parts[i])
    row = np.repeat(np.arange(len(demand)), n)
    head = np.cumsum(n) - n
    out = demand[row]
    for i, x in parts.items():
        out[head[i] : head[i] + n[i]] = x
    before = np.cumsum(out[:, 0]) - out[:, 0]
    return out, row, np.arange(len(row)) - head[row], before - before[head][row]


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pack and position of each row of demand; no row exceeds a limit."""
    n = len(demand)
    pack, position = np.zeros(n, np.int64), np.zeros(n, np.int64)
    share = demand / limits
    left, number = np.arange(n), 0
    while len(left):
        room, free, nth = limits.copy(), left, 0
        while True:
            free = free[(demand[free] <= room).all(1)]
            if not len(free):
                break
            best = int(np.argmax(share[free] @ (room / limits)))
            pick = free[best]
            pack[pick], position[pick] = number, nth
            room, nth = room - demand[pick], nth + 1
            free = np.delete(free, best)
            left = left[left != pick]
        number += 1
    return pack, position


def pack(examples: DataFrame, limits: dict[str, int] = LIMITS, group: int = GROUP) -> DataFrame:
    """Places of examples: rows (example_id, tokens, segments, loss_tokens), of one or more segments.

    The columns ``at`` and ``tie``, where there are such, give the order of the rows of one id.
    In a row of several segments these are of equal length, and its loss tokens are the last.
    Gives (example_id, piece, pack_id, position, tokens, segments, loss_tokens, start_token,
    end_token); a piece has the example's tokens from start_token up to end_token.
    """
    if min(limits.values()) < 1:
        raise ValueError("limits must be positive")
    most = np.array([limits[n] for n in NAMES])
    order = [n for n in ("at", "tie") if n in examples.columns]
    demand = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in NAMES]
    rows = examples.where("example_id is not null").select("example_id", *order, *demand).withColumn("segments", F.greatest("segments", F.lit(1)))
    rows = settle(rows)  # tokens are counted once
    groups = max(1, -(-rows.select("example_id").distinct().count() // group))
    tasks = min(groups, max(groups // 64, int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = examples.schema["example_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["example_id", *order, *NAMES])
        fresh = pdf["example_id"].ne(pdf["example_id"].shift()).to_numpy()
        first = np.r_[np.flatnonzero(fresh), len(pdf)]
        parts, row, k, start = pieces(pdf[NAMES].to_numpy(np.int64), first, most)
        packs, position = place(parts, most)
        out = {"example_id": pdf["example_id"].to_numpy()[first[row]], "piece": k.astype(np.int32), "pack_id": (int(pdf["g"].iloc[0]) << 32) + packs, "position": position.astype(np.int32)}
        return pd.DataFrame(out | {n: parts[:, i] for i, n in enumerate(NAMES)} | {"start_token": start, "end_token": start + parts[:, 0]})

    keyed = rows.withColumn("g", F.pmod(F.xxhash64("example_id"), F.lit(groups)))
    return keyed.repartition(tasks, "g").groupBy("g").applyInPandas(run, f"example_id {kind}, piece int, pack_id bigint, position int, " + ", ".join(f"{n} bigint" for n in [*NAMES, "start_token", "end_token"]))


def conversations_demand(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row a turn, one example a conversation: a turn's tokens bear loss if it's the assistant's."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").alias("example_id"), F.col("turn").alias("at"), F.xxhash64("role", "text").alias("tie"), "role", "text")
    counted = count_tokens(rows, "text", "tokens", path)
    loss = F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)
    return counted.select("example_id", "at", "tie", "tokens", F.lit(1).alias("segments"), loss.alias("loss_tokens"))


def documents_demand(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One example a document: one segment, all of whose tokens bear loss."""
    counted = count_tokens(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tie"), "text"), "text", "tokens", path)
    return counted.select(F.col("doc_id").alias("example_id"), "tie", "tokens", F.lit(1).alias("segments"), F.col("tokens").alias("loss_tokens"))
