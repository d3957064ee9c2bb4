"""Language identification by a byte convolutional network.

Embedded bytes go through filters of several widths, the maximum over a window's
positions is taken of each filter, and a softmax gives the languages. Texts are
cut to windows of ``WINDOW`` bytes that cover them (the last one reaches back to
be full, a shorter text is repeated to fill one), and a document's probabilities
are the means over its windows, so a foreign passage counts by its length. Training is numpy on the
driver over a bounded sample; in scoring, the filters of all widths are one
matrix product over batches of windows. The plan is narrow.

Cases: a null, empty or blank text has no language (null, score 0) and is not
kept. Without any labelled row the language is null and every text is kept; with
one language all get it. Of equally likely languages the first by name is taken. Repeated
rows get equal results; other columns pass through, whatever their names, and are not
needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import _SPACE, sample_ids, steps, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
DEPTH = 6
PLACES = WINDOW - WIDTHS[-1] + 1
CHUNK = 64  # windows convolved at once


def cut_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, periods and rows of windows; byte t of a window is at start + t % period."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.minimum(offsets[row] + nth * WINDOW, np.maximum(offsets[row + 1] - WINDOW, offsets[row]))
    return starts, np.minimum(sizes[row], WINDOW), row


def gather(raw: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    return raw[starts[:, None] + np.arange(WINDOW)[None, :] % periods[:, None]]


def convolve(w: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Every filter at every position of each window: one product of unrolled embedded bytes and all filters."""
    n = len(windows)
    flat = w["emb"].take(windows, axis=0).reshape(n, WINDOW * DEPTH)
    rows = np.lib.stride_tricks.sliding_window_view(flat, WIDTHS[-1] * DEPTH, axis=1)[:, ::DEPTH]
    conv = np.ascontiguousarray(rows).reshape(n * PLACES, WIDTHS[-1] * DEPTH) @ np.concatenate([w[f"f{width}"] for width in WIDTHS], axis=1)
    return conv.reshape(n, PLACES, len(WIDTHS) * FILTERS)


@dataclass
class ByteCnn:
    """Languages in order and weights; no languages: nothing was learned."""

    languages: list[str]
    w: dict[str, np.ndarray]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Maxima of the filters over the positions of each window."""
        conv, size = convolve(self.w, windows), PLACES
        while size > 1:  # halving keeps to long contiguous runs
            half = (size + 1) // 2
            np.maximum(conv[:, :half], conv[:, size - half : size], out=conv[:, :half])
            size = half
        return np.maximum(conv[:, 0] + self.w["bias"], 0)

    def windows_log(self, raw: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.languages)), np.float64)
        for i in range(0, len(starts), CHUNK):
            z = self.pooled(gather(raw, starts[i : i + CHUNK], periods[i : i + CHUNK])) @ self.w["out"] + self.w["bout"]
            z = z.astype(np.float64) - z.max(1, keepdims=True)
            out[i : i + CHUNK] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none; the first of equal ones) and the probabilities of all, for each text."""
        n = len(offsets) - 1
        best, prob = np.full(n, -1), np.zeros((n, max(1, len(self.languages))))
        starts, periods, row = cut_windows(offsets)
        if not self.languages or not len(row):
            return best, prob
        logs = self.windows_log(raw, starts, periods)
        some, at, counts = np.unique(row, return_index=True, return_counts=True)
        p = np.add.reduceat(np.exp(logs), at) / counts[:, None]
        best[some], prob[some] = p.argmax(1), p
        return best, prob


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, seed: int = 5) -> ByteCnn:
    """Adam on the cross-entropy of windows; through the pooling only the winning positions learn."""
    rng = np.random.default_rng(seed)
    count = len(languages)
    w = {"emb": rng.standard_normal((256, DEPTH)).astype(np.float32) * 0.5, "out": np.zeros((len(WIDTHS) * FILTERS, count), np.float32), "bout": np.zeros(count, np.float32)}
    for width in WIDTHS:
        w[f"f{width}"] = np.zeros((WIDTHS[-1] * DEPTH, FILTERS), np.float32)  # rows past the width stay 0
        w[f"f{width}"][: width * DEPTH] = rng.standard_normal((width * DEPTH, FILTERS)) * (1 / (width * DEPTH)) ** 0.5
    w["bias"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    w["out"] += rng.standard_normal(w["out"].shape).astype(np.float32) * 0.1
    model = ByteCnn(languages, w)
    if count < 2:
        return model
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    step, f = 0, np.arange(FILTERS)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            x, y = windows[order[i : i + batch]], labels[order[i : i + batch]]
            n = len(x)
            conv = convolve(w, x)
            at = conv.argmax(1)
            pool = np.take_along_axis(conv, at[:, None, :], 1)[:, 0, :] + w["bias"]
            act = np.maximum(pool, 0)
            z = act @ w["out"] + w["bout"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            g = {"out": act.T @ p, "bout": p.sum(0), "emb": np.zeros_like(w["emb"])}
            back = (p @ w["out"].T) * (pool > 0)
            g["bias"] = back.sum(0)
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                g[f"f{width}"] = np.zeros_like(w[f"f{width}"])
                for j in range(width):
                    byte = x[np.arange(n)[:, None], at[:, own] + j].astype(np.int64)
                    table = np.bincount((byte * FILTERS + f).ravel(), weights=back[:, own].ravel(), minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                    part = slice(j * DEPTH, (j + 1) * DEPTH)
                    g[f"f{width}"][part] = w["emb"].T @ table
                    g["emb"] += table @ w[f"f{width}"][part].T
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, per_language: int = 500, max_windows: int = 3000) -> ByteCnn:
    """Fit on at most ``per_language`` labelled documents and ``max_windows`` windows of each language.

    The sample goes by a hash of doc_id; a label is a non-empty ``lang``. Without such a column nothing is learned.
    """
    if "lang" not in docs.columns:
        return ByteCnn([], {})
    labelled = docs.where("doc_id is not null and lang is not null and lang <> ''").select("doc_id", "lang").distinct()
    ids = sample_ids(labelled, "lang", per_language)
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).toArrow()
    langs = np.array(rows["lang"].to_pylist(), dtype=object)
    languages = sorted(set(langs))
    raw, offsets = text_buffers(rows["text"])
    starts, periods, row = cut_windows(offsets)
    rng = np.random.default_rng(11)
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")  # the rows' order isn't given
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    xs, ys = [], []
    for k, lang in enumerate(languages):
        own = np.flatnonzero(langs[row] == lang)
        own = own[np.lexsort((starts[own], rank[row[own]]))]
        own = own[rng.permutation(len(own))][:max_windows]
        xs.append(gather(raw, starts[own], periods[own]))
        ys.append(np.full(len(own), k))
    if not languages or not sum(map(len, xs)):
        return ByteCnn([], {})
    return fit(np.concatenate(xs), np.concatenate(ys), languages)


def judge(model: ByteCnn, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index (-1: none), probabilities of all languages and blankness of the texts of a batch."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    best, prob, blank = np.full(n, -1), np.zeros((n, max(1, len(model.languages)))), np.ones(n, bool)
    for i, j in steps(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = np.concatenate([[0], np.cumsum(~_SPACE[part])])[off]
        blank[i:j] = solid[1:] == solid[:-1]
        best[i:j], prob[i:j] = model.predict(part, off)
    best[blank], prob[blank] = -1, 0
    return best, prob, blank


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, language, score) for every row."""
    names = np.array([*model.languages, None], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, prob, _ = judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(prob.max(1))], ["doc_id", "language", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, score double")


def keep_identified(docs: DataFrame, model: ByteCnn, least: float = 0.4, foreign: float = 0.05) -> DataFrame:
    """The documents whose language is clear, with all their columns.

    One goes if its text is blank, if no language reaches ``least``, or if the one declared
    in ``lang`` (where there is such a column, and the model knows it) has less than
    ``foreign``, as a mean over the text's windows: some windows of junk, names or
    quotations neither save a mislabelled text nor condemn a right one.
    """
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(model.languages)}
        for batch in batches:
            _, prob, blank = judge(model, batch.column(at))
            good = ~blank
            if model.languages:
                own = np.array([place.get(x, -1) for x in batch.column(lang).to_pylist()] if lang >= 0 else [-1] * len(blank), np.int64)
                good &= (prob.max(1) >= least) & ((own < 0) | (prob[np.arange(len(own)), own] >= foreign))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
