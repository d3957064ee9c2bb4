"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (consecutive windows of ``PASSAGE`` bytes that
cover the whole text). Every passage is encoded from hashed byte trigrams and
character statistics, gated attention weighs the passages, and a logistic layer
scores the weighted sum. Only documents carry labels; the weights of passages
are learned from these. Training is numpy on the driver over a bounded sample of
labelled rows; scoring is Arrow batches on the executors, a narrow plan without
a shuffle.

Cases: a null, empty or blank text has no passage, its score is null and it is
not kept. Without labelled rows of both classes nothing can be learned: scores
are null and every document with text is kept. Several labels of one document
are averaged (a half counts as good). Repeated documents get equal scores. Of passages
of equal weight the first is the top one. Other columns of the input are neither read
nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import _SPACE, sample_ids, steps, text_buffers

PASSAGE = 1024
BUCKETS = 1024
STATS = 11
CHUNK = 512  # passages encoded at once

_KIND = np.full(256, 5, np.uint8)  # 5: ASCII symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 12, 13, 32]] = 3
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
_KIND[:9], _KIND[128:] = 6, 7


def cut_passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the passages of texts at ``offsets``."""
    sizes = np.diff(offsets)
    counts = -(-sizes // PASSAGE)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[row] + nth * PASSAGE
    return starts, np.minimum(starts + PASSAGE, offsets[row + 1]), row


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One vector for each of some adjoining passages; ``stops`` are the ends of their texts."""
    n, base = len(starts), starts[0]
    sizes = ends - starts
    window = raw[base : ends[-1]].astype(np.uint32)
    pad = np.concatenate([window, np.zeros(2, np.uint32)])
    tail = raw[ends[-1] : ends[-1] + 2]
    pad[len(window) : len(window) + len(tail)] = tail
    owner = np.repeat(np.arange(n), sizes)
    whole = np.arange(base, ends[-1]) + 2 < np.repeat(stops, sizes)
    code = (pad[:-2] * np.uint32(0x9E3779B1) + pad[1:-1] * np.uint32(0x85EBCA6B) + pad[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(22)
    counts = np.bincount(owner[whole] * BUCKETS + code[whole], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    kinds = np.bincount(owner * 8 + _KIND[raw[base : ends[-1]]], minlength=n * 8).reshape(n, 8)
    total = np.maximum(counts.sum(1), 1)
    out = np.empty((n, BUCKETS + STATS), np.float32)
    body = np.log1p(counts)
    out[:, :BUCKETS] = body / np.maximum(np.sqrt((body * body).sum(1, keepdims=True)), 1e-6) * 4
    out[:, BUCKETS : BUCKETS + 8] = kinds / np.maximum(sizes, 1)[:, None] * 4
    out[:, BUCKETS + 8] = ((counts / total[:, None]) ** 2).sum(1) * 8
    out[:, BUCKETS + 9] = (counts > 0).sum(1) / total
    out[:, BUCKETS + 10] = np.log1p(sizes) / 7
    return out


@dataclass
class MilModel:
    """Weights; ``w`` is empty where nothing could be learned."""

    w: dict[str, np.ndarray]
    threshold: float

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage vectors, their rows, and the passages before each row."""
        starts, ends, row = cut_passages(offsets)
        out = np.zeros((len(starts), self.w["be"].shape[0]), np.float32)
        for i in range(0, len(starts), CHUNK):
            j = min(i + CHUNK, len(starts))
            x = features(raw, starts[i:j], ends[i:j], offsets[row[i:j] + 1])
            out[i:j] = np.tanh(x @ self.w["E"] + self.w["be"])
        return out, row, np.searchsorted(row, np.arange(len(offsets)))

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of passages and the passage of most weight (-1: none) of each row."""
        n = len(offsets) - 1
        hidden, row, first = self.encode(raw, offsets)
        counts = np.diff(first)
        scores, top = np.full(n, np.nan), np.full(n, -1)
        some = np.flatnonzero(counts)
        if len(some):
            at = first[some]
            weight, z = attend(self.w, hidden, at, counts[some])[:2]
            scores[some] = 1 / (1 + np.exp(-(z @ self.w["c"] + self.w["b"][0]).astype(np.float64)))
            order = np.lexsort((np.arange(len(row)), -weight, row))
            top[some] = order[at] - at
        return scores, counts, top


def attend(w: dict[str, np.ndarray], hidden: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of the passages and the weighted sums of bags that begin ``at``."""
    t, s = np.tanh(hidden @ w["V"]), 1 / (1 + np.exp(-(hidden @ w["U"])))
    e = (t * s) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
    weight = e / np.repeat(np.add.reduceat(e, at), counts)
    return weight, np.add.reduceat(hidden * weight[:, None], at), t, s


def gradient(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of bags (passages ``x`` from ``at``, labels ``y``) by every weight."""
    owner = np.repeat(np.arange(len(y)), counts)
    h = np.tanh(x @ w["E"] + w["be"])
    a, z, t, s = attend(w, h, at, counts)
    p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))
    d = ((p - y) * weight).astype(x.dtype)
    g = {"c": z.T @ d, "b": d.sum(keepdims=True)}
    dz = (d[:, None] * w["c"])[owner]
    da = (h * dz).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, at), counts))
    g["w"] = (t * s).T @ de
    dg = de[:, None] * w["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g["E"], g["be"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: np.ndarray, threshold: float = 0.25, hidden: int = 32, gates: int = 16, epochs: int = 14, seed: int = 7) -> MilModel:
    """Adam on the weighted cross-entropy of documents; ``bags`` hold passage features."""
    if len(bags) == 0 or labels.min() == labels.max():
        return MilModel({}, threshold)
    rng = np.random.default_rng(seed)
    wide = bags[0].shape[1]
    w = {k: (rng.standard_normal(v) * f).astype(np.float32) for k, v, f in (("E", (wide, hidden), 0.05), ("be", hidden, 0), ("V", (hidden, gates), 0.2), ("U", (hidden, gates), 0.2), ("w", gates, 0.2), ("c", hidden, 0.2), ("b", 1, 0))}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    share = labels.mean()
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            x = np.concatenate([bags[p] for p in pick])
            counts = np.array([len(bags[p]) for p in pick])
            at, y = np.cumsum(counts) - counts, labels[pick]
            g = gradient(w, x, at, counts, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(pick))
            g["E"] += 1e-4 * w["E"]
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return MilModel(w, threshold)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_passages: int = 24000, threshold: float = 0.25) -> MilModel:
    """Fit on at most ``per_class`` labelled documents of each class, together at most ``max_passages`` passages.

    A score below ``threshold`` rejects; it stands under a half so that clean
    documents stay. The sample goes by a hash of doc_id. Only the sample's ids are sent out, and
    only its texts come to the driver.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    ids = sample_ids(good.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"), "y", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").toArrow()  # 2 x per_class ids
    bags, ys, total = [], [], 0
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    rng = np.random.default_rng(3)
    order = order[rng.permutation(len(order))]
    raw, offsets = text_buffers(rows["text"])
    truth = rows["y"].to_numpy()
    for i in order:
        text = raw[offsets[i] : offsets[i + 1]]
        if not len(text) or _SPACE[text].all():
            continue
        ends = np.array([0, len(text)])
        starts, stops, owner = cut_passages(ends)
        if total + len(starts) > max_passages:
            continue
        total += len(starts)
        bags.append(features(text, starts, stops, ends[owner + 1]))
        ys.append(truth[i])
        if truth[i] and len(text) > 200 and rng.random() < 0.4:  # a piece of a good document is taken for good: short texts are learned too
            begin, size = int(rng.integers(0, len(text) - 160)), int(rng.integers(16, 160))
            bags.append(features(text, np.array([begin]), np.array([begin + size]), np.array([begin + size])))
            ys.append(1)
    return fit(bags, np.array(ys, np.float32), threshold)


def judge(model: MilModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores (nan: none), passages, top passage and keep, for the texts of a batch."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    scores, counts, top = np.full(n, np.nan), np.zeros(n, np.int64), np.full(n, -1)
    blank = np.ones(n, bool)
    for i, j in steps(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = np.concatenate([[0], np.cumsum(~_SPACE[part])])[off]
        blank[i:j] = solid[1:] == solid[:-1]
        if model.w:
            scores[i:j], counts[i:j], top[i:j] = model.score(part, off)
        else:
            counts[i:j] = -(-np.diff(off) // PASSAGE)
    scores[blank], counts[blank], top[blank] = np.nan, 0, -1
    return scores, counts, top, ~blank & ((scores >= model.threshold) | (not model.w))


def score(docs: DataFrame, model: MilModel) -> DataFrame:
    """(doc_id, passages, top_passage, score, keep) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, top, keep = judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(top, pa.int32(), mask=top < 0), pa.array(scores, pa.float64(), mask=np.isnan(scores)), pa.array(keep)],
                ["doc_id", "passages", "top_passage", "score", "keep"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, passages int, top_passage int, score double, keep boolean")


def keep_good(docs: DataFrame, model: MilModel) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(model, batch.column(at))[3]))

    return docs.mapInArrow(run, docs.schema)
