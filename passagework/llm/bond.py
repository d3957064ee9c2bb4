"""Exact top-k search by columnar branch and bound.

Vectors stand in blocks in vertical layout: one row of a block is one dimension of
all its vectors. A block of queries meets a block of candidates dimension block by
dimension block. Partial squared distances accumulate; what is missing is bounded
by the remaining masses, (|q'| - |x'|)^2 <= rest <= (|q'| + |x'|)^2, with |.| over the
dimensions not seen. A candidate whose lower bound passes the k-th smallest upper
bound of its query (or the k-th distance found before) is dropped, and once few
survive they are compacted to pairs. Dimensions are taken by falling variance.
Survivors get their distance in double precision, in the order of dimensions, so
results equal brute force; ties go to the smaller id.

Packed blocks are written once, and a grid of tasks reads them from there: a task meets
some blocks of queries with some of candidates, and what a block of candidates tells
of the k-th distance bounds the work on the next. Only each query's k best of a
task are shuffled. Cases: null ids, null vectors and vectors that are empty or have
null or non-finite entries are left out. Vectors of several lengths are answered each
among those of its own length. Rows of one id count as one vector (the smallest). A
vector isn't its own neighbour. With fewer than k others all are given. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import settle

BLOCK = 4096
QUERIES = 256
STEP = 8  # dimensions of a block


def nearest(q: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, candidate and squared distance of pairs that may be among the k nearest.

    ``q`` and ``x`` are dims x rows. ``bound`` holds distances beyond which nothing
    counts, and is lowered. ``same[i]`` is the candidate that is query i itself (-1: none).
    """
    dims, n, m = q.shape[0], q.shape[1], x.shape[1]
    order = np.argsort(-x.var(axis=1), kind="stable")
    qs, xs = q[order].astype(np.float32), x[order].astype(np.float32)
    mass_q = np.sqrt(np.cumsum((qs.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    mass_x = np.sqrt(np.cumsum((xs.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    slack = 1e-4 * (mass_q[0].max(initial=0) + mass_x[0].max(initial=0)) ** 2 + 1e-9  # over the rounding of float32
    if same is not None:
        own = np.flatnonzero(same >= 0)
    part = np.zeros((n, m), np.float32)
    d = 0
    while d < dims:
        e = min(d + STEP, dims)
        a, b = qs[d:e], xs[d:e]
        part += (a * a).sum(0)[:, None] + (b * b).sum(0)[None, :] - 2 * (a.T @ b)
        d = e
        if d == dims or d % (2 * STEP) and d > STEP:
            continue
        rq, rx = mass_q[d].astype(np.float32)[:, None], mass_x[d].astype(np.float32)[None, :]
        upper = part + (rq + rx) ** 2
        if same is not None and len(own):
            upper[own, same[own]] = np.inf
        if m > k:
            bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1] + slack)
        alive = part + (rq - rx) ** 2 <= (bound + slack)[:, None]
        if alive.mean() < 0.1:
            i, j = np.nonzero(alive)
            return _pairs(q, x, qs, xs, mass_q, mass_x, part[i, j], i, j, d, k, bound, slack, same)
    if same is not None and len(own):
        part[own, same[own]] = np.inf
    if m > k:
        bound = np.minimum(bound, np.partition(part, k - 1, axis=1)[:, k - 1] + slack)
    i, j = np.nonzero(part <= (bound + slack)[:, None])
    return _final(q, x, i, j, same)


def _pairs(q, x, qs, xs, mass_q, mass_x, part, i, j, d, k, bound, slack, same):  # noqa: ANN001, ANN202, PLR0913
    """The rest of the dimensions over compacted pairs, grouped by query."""
    dims = qs.shape[0]
    while d < dims:
        e = min(d + STEP, dims)
        part = part + ((qs[d:e, i] - xs[d:e, j]) ** 2).sum(0)
        d = e
        if d == dims:
            break
        alive = part + (mass_q[d, i] - mass_x[d, j]) ** 2 <= bound[i] + slack
        i, j, part = i[alive], j[alive], part[alive]
    return _final(q, x, i, j, same)


def _final(q, x, i, j, same):  # noqa: ANN001, ANN202
    if same is not None:
        other = same[i] != j
        i, j = i[other], j[other]
    total = np.zeros(len(i))
    for row in range(q.shape[0]):
        total += (q[row, i].astype(np.float64) - x[row, j].astype(np.float64)) ** 2
    return i, j, total


def best(i: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k nearest of their row, ties by id; in order."""
    order = np.lexsort((ids, dist, i))
    head = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - head < k]


def topk(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", col: str = "embedding", block: int = BLOCK, asked: str = "true") -> DataFrame:
    """(id, neighbor_id, rank, distance): the k nearest others of the vectors asked about, Euclidean; rank from 1.

    ``asked`` is a condition in SQL on ``id`` that says which vectors are queries; all rows are candidates.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{col}`").cast("array<double>").alias("v"))
    good = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    one = settle(good.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")))
    sizes = settle(one.groupBy("dims").agg(F.count("*").alias("all"), F.count_if(F.expr(asked)).alias("some")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        matrix = np.stack(pdf["v"].to_numpy()).T
        return pd.DataFrame({"dims": [matrix.shape[0]], "g": [int(pdf["g"].iloc[0])], "ids": [pdf["id"].to_numpy().tolist()], "m": [np.ascontiguousarray(matrix).tobytes()]})

    def pack(rows: DataFrame, count: str, size: int) -> DataFrame:
        """Blocks of about ``size`` vectors of one length, in about as many partitions as a side of the grid has."""
        keyed = rows.join(sizes, "dims").withColumn("g", F.pmod(F.xxhash64("id"), F.ceil(F.col(count) / size)))
        made = keyed.select("dims", "g", "id", "v").groupBy("dims", "g").applyInPandas(build, f"dims int, g bigint, ids array<{kind}>, m binary")
        return settle(made.repartition(side, "dims", "g"))

    side = max(8, math.isqrt(4 * v.sparkSession.sparkContext.defaultParallelism) + 1)
    queries = pack(one.where(asked), "some", min(block, QUERIES)).toDF("qd", "qg", "qi", "qm")
    grid = queries.hint("shuffle_replicate_nl").join(pack(one, "all", block), F.col("qd") == F.col("dims")).select("qd", "qg", "qi", "qm", "ids", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bound = None, np.zeros(0)
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch.column(0)[r].as_py()
                qi, xi = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (2, 4))
                q = np.frombuffer(batch.column(3)[r].as_buffer(), np.float64).reshape(dims, -1)
                x = np.frombuffer(batch.column(5)[r].as_buffer(), np.float64).reshape(dims, -1)
                if now != (dims, batch.column(1)[r].as_py()):
                    now, bound = (dims, batch.column(1)[r].as_py()), np.full(len(qi), np.inf)
                place = np.minimum(np.searchsorted(xi, qi), len(xi) - 1)
                same, n = np.where(xi[place] == qi, place, -1), len(qi)
                i, j, dist = nearest(q, x, k, bound, same)
                keep = best(i, xi[j], dist, k)
                row, last = i[keep], np.full(n, -1)
                last[row] = np.arange(len(row))  # of each query, its k-th or last
                full = np.bincount(row, minlength=n) == k
                bound[full] = np.minimum(bound[full], dist[keep][last[full]])
                yield pa.RecordBatch.from_arrays([pa.array(qi[i[keep]]), pa.array(xi[j[keep]]), pa.array(np.sqrt(dist[keep]))], ["id", "neighbor_id", "distance"])

    near = grid.mapInArrow(run, f"id {kind}, neighbor_id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbor_id", "rank", "distance")


ORACLE = """
SELECT id, neighbor_id, rank, distance FROM (
  SELECT a.vec_id AS id, b.vec_id AS neighbor_id,
    round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), b.vec_id)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
WHERE rank <= 10
"""
