"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 128 bits, each the majority over the hashes of its
distinct features (ASCII lower case): every word of four bytes or more, and every
shorter one together with the word before it, so each word has a vote and the few
frequent short ones don't make texts alike. Two texts are near duplicates if the fingerprints differ in
at most ``RADIUS`` places. Candidates come from structured bit masks: the bits are
cut to parts, and a pair within the radius is within a smaller one, r, in some part
(the radii of p parts add up to RADIUS - p + 1). There a map of bit positions to the
non-zero vectors over GF(2) gives 2**(r+1)-1 masks such that any r differing positions
are all masked out by some mask. Every pair within the radius thus agrees on the masked
bits of some table, with certainty, whatever the number of parts. That follows the number
of nodes: four parts give 124 tables with keys of 16 bits, three 317 with 21, two 2,046
with 32, so buckets stay small as the table grows (from about 30 million and 2 billion
nodes on). Pairs that the tables bring up beside, up to ``ACCEPT`` places apart, are
accepted too; unrelated texts are further apart.

Equal fingerprints are one node from the start, so exact copies cost no pairs.
Nodes that share a masked value meet in a bucket; a small bucket gives its close
pairs, a large one a spanning forest of them, so thousands of near copies don't
make millions of pairs. Connected components follow by alternating stars.

Cases: null, empty and wordless texts have no fingerprint and are groups of their
own. A null doc_id is dropped from groups and always kept. Rows of one doc_id are
one document (the smallest fingerprint stands for it) and stay or go together.
The document of smallest doc_id stays of each group. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import mix64, span_hashes, steps, text_buffers, words
from passagework.session import settle

RADIUS = 19
ACCEPT = 24
SLICE = 1 << 14
SMALL = 16
SHORT = 4  # bytes from which a word is a feature by itself
_FIRST = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x 2 of uint64) of texts, and how many features each has."""
    n = len(offsets) - 1
    raw = _LOWER[raw]
    starts, ends, first = words(raw, offsets)
    owner = np.repeat(np.arange(n), np.diff(first))
    codes = span_hashes(raw, starts, ends)
    short = np.flatnonzero(ends - starts < SHORT)
    inside = short > first[owner[short]]  # a text's first word has none before it
    before = np.where(inside, codes[short - 1], np.uint64(0))
    codes[short] = mix64(codes[short] + before * _PAIR + _PAIR)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(44) | codes >> np.uint64(20))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    owner, codes = (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1)
    counts = np.bincount(owner, minlength=n)
    both = np.stack([mix64(codes ^ _FIRST), mix64(codes ^ _SECOND)], 1)
    nth = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    votes = np.zeros((n, 128), np.int32)
    for i in range(0, len(codes), SLICE):
        own = owner[i : i + SLICE]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]] | (nth[i : i + SLICE] % 255 == 0))
        bits = np.unpackbits(both[i : i + SLICE].view(np.uint8), axis=1, bitorder="little")
        # eight counters of a byte are added as one word; none passes 255
        part = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).astype(np.int32)
        docs = np.flatnonzero(np.r_[True, own[at][1:] != own[at][:-1]])
        votes[own[at][docs]] += np.add.reduceat(part, docs, axis=0)
    up = 2 * votes > counts[:, None]
    return np.packbits(up, axis=1, bitorder="little").view(np.uint64).reshape(n, 2), counts


def split(radius: int, parts: int) -> list[tuple[int, int]]:
    """(bits, radius) of each part; a pair within ``radius`` is within that of its part in one of them at least."""
    spare = radius - parts + 1
    wide = [128 // parts + (i < 128 % parts) for i in range(parts)]
    return [(w, max(0, spare // parts + (i < spare % parts))) for i, w in enumerate(wide)]


def best_parts(nodes: int, radius: int = RADIUS) -> int:
    """How many parts are cheapest for so many nodes: fewer ones have more tables, with longer keys.

    A row that is moved costs about as much as 100 comparisons.
    """

    def cost(parts: int) -> float:
        return sum(((2 << r) - 1) * nodes * (100 + nodes / 2 ** (bits / 2 + 1)) for bits, r in split(radius, parts))

    return min((4, 3, 2), key=cost)


def masks(radius: int = RADIUS, parts: int = 4, seed: int = 17) -> list[tuple[int, int]]:
    """Pairs of signed 64-bit masks, one for each table: a covering family for each part of the bits."""
    rng = np.random.default_rng(seed)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out, at = [], 0
    for bits, inner in split(radius, parts):
        # every vector but 0 gets a like share of the positions
        phi = rng.permutation(np.arange(bits) % ((2 << inner) - 1) + 1)
        for v in range(1, 2 << inner):
            mask = sum(1 << at + i for i in range(bits) if bin(int(phi[i]) & v).count("1") % 2)
            out.append((signed(mask & (1 << 64) - 1), signed(mask >> 64)))
        at += bits
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, features, a, b): fingerprints of the rows that have words, a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in steps(offsets):
                prints, counts = fingerprints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.flatnonzero(counts)
                signed = prints[some].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(counts[some].astype(np.int32)), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy())], ["doc_id", "features", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {kind}, features int, a bigint, b bigint")


def bucket_edges(key: np.ndarray, node: np.ndarray, prints: np.ndarray, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows of equal key (rows sorted by it), at most ``accept`` places apart.

    In a bucket of up to ``SMALL`` rows these are all such pairs. In a larger one
    they are a spanning forest of them, found breadth first: a node is compared
    with what isn't reached yet, so a bucket of n copies gives n - 1 edges.
    """
    lo, hi = [], []
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(key)])
    small = np.repeat(size <= SMALL, size)
    i = np.flatnonzero(small)
    end = np.repeat(at + size, size)
    for shift in range(1, SMALL):
        i = i[i + shift < end[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(prints[i] ^ prints[i + shift]).sum(1) <= accept]
        lo.append(node[near])
        hi.append(node[near + shift])
    for k in np.flatnonzero(size > SMALL):
        left = np.arange(at[k], at[k] + size[k])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(prints[left] ^ prints[x]).sum(1) <= accept
                found, left = left[near], left[~near]
                queue.extend(found)
                lo.append(np.full(len(found), node[x]))
                hi.append(node[found])
    none = np.zeros(0, node.dtype)
    x, y = np.concatenate([none, *lo]), np.concatenate([none, *hi])
    return np.minimum(x, y), np.maximum(x, y)


def close_pairs(nodes: DataFrame, radius: int = RADIUS, accept: int = ACCEPT, parts: int = 4) -> DataFrame:
    """(lo, hi): edges among nodes (node, a, b) that connect whatever the tables bring within ``accept``."""
    tables = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in masks(radius, parts)])
    mask = F.element_at(tables, F.col("t") + 1)
    masked = [F.col(c).bitwiseAND(mask[m]) for c, m in (("a", "p"), ("b", "q"))]
    # a row carries its table's number alone; the masked bits are made anew on either side of the shuffle
    rows = nodes.select("node", "a", "b", F.explode(F.sequence(F.lit(0), F.size(tables) - 1)).alias("t"))
    met = rows.repartition("t", *masked).select("t", masked[0].alias("x"), masked[1].alias("y"), "node", "a", "b").sortWithinPartitions("t", "x", "y", "node")
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last bucket's rows; the next batch may have more

        def edges(part: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.r_[True, (part[1:, :3] != part[:-1, :3]).any(1)])
            lo, hi = bucket_edges(bucket, part[:, 3], part[:, 4:].view(np.uint64), accept)
            pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]).cast(target), pa.array(pairs[:, 1]).cast(target)], ["lo", "hi"])

        for batch in batches:
            target = batch.schema.field(3).type
            part = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], 1)
            if not len(part):
                continue
            cut = int((part[:, :3] != part[-1, :3]).any(1).sum())  # rows come sorted: those before the last bucket
            if held and (cut or (held[0][0, :3] != part[0, :3]).any()):
                yield edges(np.concatenate([*held, part[:cut]]))
                held = []
            elif cut:
                yield edges(part[:cut])
            held.append(part[cut:])
        if held:
            yield edges(np.concatenate(held))

    return met.mapInArrow(run, f"lo {kind}, hi {kind}").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each connected component of (lo, hi).

    Alternates large-star and small-star steps until the edges are stars; that
    takes about log(n) rounds, each written to the shared folder.
    """
    edges = settle(edges.select("lo", "hi"))
    for _ in range(most_rounds):
        # large star: link every larger neighbour to the smallest one
        both = edges.union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: link the smaller neighbours and the node to the smallest
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large.hi == least.u)
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        after = settle(small)
        changed = after.exceptAll(edges).limit(1).count() or edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).distinct()
    raise RuntimeError("components didn't settle")


def groups(docs: DataFrame, radius: int = RADIUS, accept: int = ACCEPT) -> DataFrame:
    """(doc_id, group_id, a, b) for every document that has words; group_id is the smallest doc_id."""
    prints = settle(fingerprint(docs).groupBy("doc_id").agg(F.min_by(F.struct("a", "b"), F.struct("a", "b")).alias("f")).select("doc_id", "f.a", "f.b"))
    nodes = settle(prints.groupBy("a", "b").agg(F.min("doc_id").alias("node")))
    roots = components(close_pairs(nodes, radius, accept, best_parts(nodes.count(), radius)))
    named = nodes.join(roots, "node", "left").select("a", "b", F.coalesce("root", "node").alias("group_id"))
    return prints.join(named, ["a", "b"]).select("doc_id", "group_id", "a", "b")


def mark(docs: DataFrame, radius: int = RADIUS, accept: int = ACCEPT) -> DataFrame:
    """(doc_id, group_id, keep) for every doc_id; texts without words are their own groups."""
    found = groups(docs, radius, accept).select("doc_id", "group_id")
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    out = ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))
    return out.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, accept: int = ACCEPT) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id."""
    gone = groups(docs, radius, accept).where("doc_id <> group_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
