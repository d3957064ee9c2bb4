"""Repeated passages by a logarithmic family of suffix arrays.

A passage of at least ``least`` words (between ASCII white space) that occurred
before, in the order of (doc_id, place), is a repeat. Three steps find all:

1. Every window of ``least`` words is keyed by the smallest hash among its runs of
   ``GRAM`` words, a function of its content alone, so equal windows have equal keys.
   Neighbouring windows of one key form a segment. Only (key, doc_id, place)
   is shuffled; segments whose key occurs once can't repeat and are dropped.
2. The words of the segments that are left are fetched and sent to the key's shard.
3. A shard reads its segments in document order, batch by batch. A new batch gets
   a suffix array (by prefix doubling, each suffix ordered by ``least`` words, since
   longer matches show as runs of windows) and is merge-scanned against the levels
   there are. What is new becomes a level: the words, once, and the sorted places of
   the windows among them. Levels of like size merge, so there are O(log n) levels and
   every suffix takes part in O(log n) merges. Equal windows are held once: passages
   in thousands of documents don't grow a level.
4. A key of very many segments (a passage that a third of all rows have) is spread over
   several shards by document. Each finds its own repeats, and gives the windows that
   were new to it as 128-bit hashes; those that an earlier document has in another
   shard are repeats too.

Words are compared by 32-bit hashes, ``least`` in a row. Cases: null and short
texts have no repeats; a null doc_id has no place in the order and is left as it
is. Rows of one doc_id are copies in the same place: each is compared to other
documents, not to its twins, and all are treated alike. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import mix64, span_hashes, spare_name, steps, text_buffers, words
from passagework.session import settle

LEAST = 50
GRAM = 8
SLICE = 100_000  # windows of one new batch
BLOCK = 4096  # windows of a level that are spelt out at once
HOT = 1 << 16  # segments of a key beyond which it is spread over several shards
SAMPLE = 64  # one document in so many is looked at to find such keys
MOST_HOT = 100_000  # such keys at most; they are sent to all tasks
_STEP = np.uint64(0x9FB21C651E98DF25)


def word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and the words before each text."""
    starts, ends, first = words(raw, offsets)
    return span_hashes(raw, starts, ends), first


def segments(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs of windows of one key: key, text, first window (from the text's start), windows, repeats-itself."""
    gram = min(GRAM, least)
    wide = least - gram + 1
    n = len(codes) - least + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, bool)
    g = codes[: len(codes) - gram + 1].copy()
    for j in range(1, gram):
        g = g * _STEP + codes[j : len(codes) - gram + 1 + j]
    g = mix64(g)
    low, span = g, 1
    while span < wide:
        reach = min(span, wide - span)
        low, span = np.minimum(low[: len(low) - reach], low[reach:]), span + reach
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    ok = np.arange(n) + least <= first[1:][owner]
    fresh = np.ones(n, bool)
    fresh[1:] = (low[1:n] != low[: n - 1]) | (owner[1:] != owner[:-1]) | ~ok[:-1]
    at = np.flatnonzero(fresh & ok)
    if not len(at):
        return none, none, none, none, np.zeros(0, bool)
    bounds = np.flatnonzero(fresh | ~ok)
    after = np.searchsorted(bounds, at, "right")
    end = np.where(after < len(bounds), bounds[np.minimum(after, len(bounds) - 1)], n)
    count = end - at
    # a segment can hold equal windows only if its smallest run of words occurs twice in it
    reach = count + wide - 1
    seg = np.repeat(np.arange(len(at)), reach)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(reach) - reach, reach) + at[seg]
    twice = np.bincount(seg[g[place] == low[at][seg]], minlength=len(at)) > 1
    return low[at].view(np.int64), owner[at], at - first[owner[at]], count, twice


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` words from there on, by prefix doubling; equal ones in their own order."""
    rank, reach = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while 2 * reach <= depth:
        rank = np.unique(rank[:-reach] * len(text) + rank[reach:], return_inverse=True)[1]
        reach *= 2
    return at[np.argsort(rank[at] * len(text) + rank[at + depth - reach], kind="stable")]


@dataclass
class Level:
    """A suffix array: words of segments one after another, and the sorted places of the windows among them.

    ``starts`` has the segments' places in ``text``, ``owners`` where they stood (document and word in one number).
    """

    text: np.ndarray  # big-endian uint32, so that bytes sort as numbers
    order: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    def __len__(self) -> int:
        return len(self.order)

    def keys(self, at: np.ndarray, least: int) -> np.ndarray:
        """The words of windows, as byte strings that compare like them."""
        return np.lib.stride_tricks.sliding_window_view(self.text, least)[at].view(f"S{4 * least}").ravel()

    def owner(self, at: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, at, "right") - 1
        return self.owners[segment] + at - self.starts[segment]

    def part(self, at: np.ndarray, least: int) -> Level:
        """The level of some of its windows (sorted), with no words but theirs."""
        change = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + least, -1)
        held = np.cumsum(change[:-1]) > 0
        first = held.copy()
        first[1:] &= ~held[:-1]
        first[self.starts] |= held[self.starts]
        starts = np.flatnonzero(first)
        moved = np.cumsum(held) - 1
        return Level(self.text[held], moved[at].astype(np.int32), moved[starts], self.owner(starts))


class IndexFamily:
    """Suffix arrays that hold each window once, each at least twice as large as the next."""

    def __init__(self, least: int = LEAST) -> None:
        self.least = least
        self.levels: list[Level] = []

    def ranks(self, level: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted ``keys`` go in a level, and whether they are there: a scan along both.

        The level's windows are spelt out block by block, and only in blocks that keys fall in.
        """
        heads = np.arange(0, len(level), BLOCK)
        cuts = np.append(np.searchsorted(keys, level.keys(level.order[heads], self.least)), len(keys))
        at, here = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for head, a, b in zip(heads.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                block = level.keys(level.order[head : head + BLOCK], self.least)
                spot = np.searchsorted(block, keys[a:b])
                at[a:b] = head + spot
                here[a:b] = block[np.minimum(spot, len(block) - 1)] == keys[a:b]
        return at, here

    def merged(self, a: Level, b: Level) -> Level:
        """One level of two that share no window."""
        spots = [self.ranks(a, b.keys(b.order[i : i + SLICE], self.least))[0] for i in range(0, len(b), SLICE)]
        kind = np.int32 if len(a.text) + len(b.text) < 1 << 31 else np.int64
        order = np.insert(a.order.astype(kind), np.concatenate(spots), b.order.astype(kind) + kind(len(a.text)))
        return Level(np.concatenate([a.text, b.text]).astype(">u4"), order, np.r_[a.starts, b.starts + len(a.text)], np.r_[a.owners, b.owners])

    def add(self, text: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Take a batch of segments; which of their windows, in order, occurred before, in it or in an earlier batch.

        ``starts`` has the segments' places in ``text`` (each has ``least`` words or more), ``owners`` where they
        stand; equal windows of one owner are equal copies of one place and no repeats of each other.
        """
        least, count = self.least, np.diff(np.append(starts, len(text))) - self.least + 1
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(starts - first, count)
        batch = Level(text.astype(">u4"), suffix_order(text, at, least), starts, owners)
        keys = batch.keys(batch.order, least)
        fresh = np.r_[True, keys[1:] != keys[:-1]]
        group, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        unique, origin = keys[heads], batch.owner(batch.order[heads])
        known = np.zeros(len(unique), bool)
        for level in self.levels:
            spot, here = self.ranks(level, unique)
            known |= here
            origin[here] = level.owner(level.order[spot[here]])
        place = np.zeros(len(text), bool)
        place[batch.order] = batch.owner(batch.order) != origin[group]
        new = batch.order[heads[~known]]
        if len(new):
            self.levels.append(batch.part(new, least))
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                small = self.levels.pop()
                self.levels[-1] = self.merged(self.levels[-1], small)
        return place[at]


def _segment_rows(docs: DataFrame, least: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in steps(offsets):
                codes, first = word_codes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, row, place, count, twice = segments(codes, first, least)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(0).take(pa.array(i + row)), pa.array(place, pa.int32()), pa.array(count, pa.int32()), pa.array(twice)], ["key", "doc_id", "place", "windows", "twice"])

    return docs.mapInArrow(run, f"key bigint, doc_id {kind}, place int, windows int, twice boolean")


def _with_words(docs: DataFrame, least: int) -> DataFrame:
    """Of rows (doc_id, text, segs): one row for each segment, with its words as 32-bit hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            lists = batch.column(2)
            bounds = np.asarray(lists.offsets)
            flat = lists.values
            key, salt, place, count = flat.field("key"), flat.field("salt"), np.asarray(flat.field("place")), np.asarray(flat.field("windows"))
            for i, j in steps(offsets):
                codes, first = word_codes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                small = (codes >> np.uint64(32)).astype(np.uint32)
                a, b = bounds[i], bounds[j]
                row = np.repeat(np.arange(i, j), np.diff(bounds[i : j + 1]))
                begin = first[row - i] + place[a:b]
                size = count[a:b] + least - 1
                good = begin + size <= first[row - i + 1]  # differs only where rows of one doc_id hold other texts
                begin, size = begin[good], size[good]
                pick = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ends = np.concatenate([[0], np.cumsum(size)]) * 4
                blob = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(small[pick].tobytes())]).cast(pa.binary())
                left = pa.array(good)
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a).filter(left), salt.slice(a, b - a).filter(left), batch.column(0).take(pa.array(row[good])), pa.array(place[a:b][good], pa.int32()), blob], ["key", "salt", "doc_id", "place", "words"])

    return docs.mapInArrow(run, f"key bigint, salt int, doc_id {kind}, place int, words binary")


def _scan(rows: DataFrame, least: int) -> DataFrame:
    """Runs of repeated windows of segments that come in document order: (doc_id, a, b, h, i), in words.

    Of keys spread over shards, a shard's first occurrences come too, with the hash (h, i) of the window.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    powers = mix64(np.arange(1, 2 * least + 1, dtype=np.uint64)).reshape(2, least) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily(least)
        last, number = None, 0  # documents are numbered through all batches
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(4).cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8) // 4
            flat = np.frombuffer(data.buffers()[2], np.uint32)
            place = np.asarray(batch.column(3)).astype(np.int64)
            ids = batch.column(2)
            count = np.diff(ends) - least + 1
            seg = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
            code = np.asarray(ids.dictionary_encode().indices).astype(np.int64)  # they come in order
            code += number + (ids[0] != last)
            last, number = ids[-1], int(code[-1])
            seen = np.zeros(len(seg), bool)
            for i in range(0, len(seg), SLICE):
                j = min(i + SLICE, len(seg)) - 1
                own = np.arange(seg[i], seg[j] + 1)
                begin, owner = ends[own].copy(), code[own] << 32 | place[own]
                begin[0] += nth[i]
                owner[0] += nth[i]
                seen[i : j + 1] = family.add(flat[begin[0] : ends[seg[j]] + nth[j] + least], begin - begin[0], owner)
            edge = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (seen[1:] != seen[:-1])])
            size = np.diff(np.r_[edge, len(seg)])
            edge, size = edge[seen[edge]], size[seen[edge]]
            spread = np.flatnonzero(~seen & (np.asarray(batch.column(1)) > 0)[seg])
            at = np.r_[edge, spread]
            a = place[seg[at]] + nth[at]
            b = a + least + np.r_[size - 1, np.zeros(len(spread), np.int64)]
            names = []
            for p in powers:
                hashed = np.zeros(len(spread), np.uint64)
                for n, x in enumerate(p):
                    hashed = mix64(hashed * x + flat[ends[seg[spread]] + nth[spread] + n])
                names.append(pa.concat_arrays([pa.nulls(len(edge), pa.int64()), pa.array(hashed.view(np.int64))]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(seg[at])), pa.array(a, pa.int32()), pa.array(b, pa.int32()), *names], ["doc_id", "a", "b", "h", "i"])

    return rows.mapInArrow(run, f"doc_id {kind}, a int, b int, h bigint, i bigint")


def _hot(texts: DataFrame, least: int, hot: int, sample: int) -> DataFrame:
    """(key, salts): keys of about ``hot`` segments or more, and over how many shards they are to be spread.

    This is an estimate over a share of the documents: whether a key is spread changes no result.
    """
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    size = F.col("count") * sample
    found = _segment_rows(some, least).groupBy("key").count().where(size > hot).orderBy(F.desc("count"), "key").limit(MOST_HOT)
    return settle(found.select("key", F.ceil(size / hot).cast("int").alias("salts")))


def repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the spans of each document that repeat earlier passages.

    Spans are unions of repeated windows; those that touch are one; end_word is exclusive.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found, often = _segment_rows(texts, least), _hot(texts, least, hot, sample)
    spread = not often.isEmpty()
    if spread:  # at most MOST_HOT rows
        found = found.join(F.broadcast(often), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts") + 1, F.lit(0)).cast("int")).drop("salts")
    else:
        found = found.withColumn("salt", F.lit(0))
    shared = found.withColumn("n", F.count("*").over(Window.partitionBy("key", "salt"))).where("n > 1 or twice or salt > 0")
    wanted = shared.groupBy("doc_id").agg(F.collect_set(F.struct("key", "salt", "place", "windows")).alias("segs"))
    rows = _with_words(texts.join(wanted.hint("shuffle_hash"), "doc_id"), least)
    ordered = rows.repartition("key", "salt").sortWithinPartitions("doc_id", "place", "key")
    runs = _scan(ordered, least)
    if spread:  # what is first in one shard of a key may have come before in another; each has it once
        same = Window.partitionBy(F.coalesce("h", F.xxhash64("doc_id", "a")), "i").orderBy("doc_id", "a")
        runs = runs.withColumn("nth", F.rank().over(same)).where("h is null or nth > 1")
    before = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def cut_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the repeated spans; n_chars (if there) is counted anew, and texts left blank go."""
    name = spare_name(docs, "spans")
    spans = repeats(docs, least).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(name))
    joined = docs.join(spans.hint("shuffle_hash"), "doc_id", "left").select(*[F.col(f"`{c}`") for c in docs.columns], name)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = np.asarray(batch.column(batch.num_columns - 1).is_valid())
            columns = batch.columns[:-1]
            keep = np.ones(len(cut), bool)
            if cut.any():
                texts, counts = batch.column(at).to_pylist(), batch.column(chars).to_pylist() if chars >= 0 else None
                lists = batch.column(batch.num_columns - 1).to_pylist()
                for i in np.flatnonzero(cut):
                    data = texts[i].encode()
                    raw = np.frombuffer(data, np.uint8)
                    starts, ends, _ = words(raw, np.array([0, len(raw)]))
                    left, parts = 0, []
                    for span in lists[i]:
                        if span["end_word"] > len(starts):
                            continue
                        parts.append(data[left : starts[span["start_word"]]])
                        left = ends[span["end_word"] - 1]
                    texts[i] = b"".join([*parts, data[left:]]).decode()
                    keep[i] = bool(texts[i].strip())
                    if counts is not None:
                        counts[i] = len(texts[i])
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if counts is not None:
                    columns[chars] = pa.array(counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT doc_id, unnest(range(0, greatest(len(ws) - 49, 0))) AS p,
    unnest(list_transform(range(0, greatest(len(ws) - 49, 0)), lambda i: md5(array_to_string(ws[i + 1 : i + 50], ' ')))) AS gram
  FROM d),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) AS nth FROM g),
m AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh
  FROM r WHERE nth > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM m)
SELECT doc_id, min(p)::INT AS start_word, (max(p) + 50)::INT AS end_word, (max(p) + 50 - min(p))::INT AS n_words
FROM i GROUP BY doc_id, island
"""
