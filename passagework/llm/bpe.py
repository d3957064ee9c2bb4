"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut to pre-tokens by the vocabulary's pattern. The first tier is a minimal
perfect hash over the vocabulary: levels of bit sets in which a key owns a bit where
it alone falls, the rest going to the next level; the rank of the bit is the slot,
and the bytes held there confirm or refuse. A pre-token that is in the vocabulary is
one id. The second tier merges a miss from its bytes: a linked list of parts and a
heap of neighbouring pairs by (rank, place), so a run of n bytes takes n log n steps.

Each distinct pre-token of a step is looked up once, all of them in one vectorised
probe; results of misses are kept in a worker for its next steps (``MEMO`` at most,
which bounds memory and not the result). The plan is narrow; the vocabulary, a table
of fixed size, is read on the driver and sent with the function.

Cases: a null text gives null ids, an empty one an empty list. Text is never
normalised, so decoding gives it back byte by byte. Special tokens are ordinary text.
In decoding, a null list, a null id and an id outside the vocabulary give null; bytes
that aren't UTF-8 become U+FFFD. Rows are treated one by one; other columns pass
through.
"""

from __future__ import annotations

import base64
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import mix64, span_hashes, spare_name, steps, text_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_S = r"\p{White_Space}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+"
MEMO = 400_000
PART = 1 << 20  # characters of a text that are cut to pre-tokens at once
LEVELS = 32


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: n keys to 0..n-1, about three bits a key."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0) -> None:
        self.levels: list[np.ndarray] = []  # of each level: how many bits are set before each place
        self.base: list[int] = []
        left, done = keys, 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("keys aren't distinct")
            size = max(64, int(gamma * len(left)))
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(np.concatenate([[0], np.cumsum(alone)]).astype(np.int32))
            self.base.append(done)
            done += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; a key that was not built in gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, ranks in enumerate(self.levels):
            at = self._place(keys[todo], level, len(ranks) - 1)
            hit = ranks[at + 1] > ranks[at]
            out[todo[hit]] = self.base[level] + ranks[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]], ends)


@dataclass
class Vocabulary:
    """Tokens with their ids (which are merge ranks), the hash and the bytes by slot."""

    tokens: list[bytes]
    ids: np.ndarray
    hash: PerfectHash
    by_slot: list[bytes]
    id_of_slot: np.ndarray
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        """From a file of lines ``base64 rank``."""
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        tokens, ids = list(ranks), np.array(list(ranks.values()), np.int64)
        keys = _hashes(tokens)
        built = PerfectHash(keys)
        slot = built.slots(keys)
        by_slot, id_of_slot = [b""] * len(tokens), np.zeros(len(tokens), np.int64)
        for s, token, i in zip(slot.tolist(), tokens, ids.tolist(), strict=True):
            by_slot[s], id_of_slot[s] = token, i
        return cls(tokens, ids, built, by_slot, id_of_slot)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token by its merges: a heap over a linked list of bytes."""
        get = self.ranks.get
        n = len(word)
        end = list(range(1, n + 1))  # part i is word[i : end[i]], and the next part begins there; 0: it was merged
        before = list(range(-1, n))
        # an entry is one number: rank, place and end of the pair
        heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = entry >> 32 & 0xFFFFFFFF, entry & 0xFFFFFFFF
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged since
            end[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heappush(heap, r << 64 | i << 32 | end[stop])
            if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
                heappush(heap, r << 64 | h << 32 | stop)
        out, i = [], 0
        while i < n:
            out.append(get(word[i : end[i]]))
            i = end[i]
        return tuple(out)

    @property
    def ranks(self) -> dict[bytes, int]:
        if "_ranks" not in self.__dict__:
            self.__dict__["_ranks"] = dict(zip(self.tokens, self.ids.tolist(), strict=True))
        return self.__dict__["_ranks"]

    def resolve(self, words: Collection[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of some pre-tokens, which are distinct."""
        if len(self.memo) > MEMO:  # what is common is among these words too, and stays
            self.memo = {w: self.memo[w] for w in words if w in self.memo}
        memo = self.memo
        fresh = [w for w in words if w not in memo]
        if fresh:
            data = [w.encode() for w in fresh]
            slot = self.hash.slots(_hashes(data))
            by_slot, ids = self.by_slot, self.id_of_slot[slot].tolist()
            for w, b, s, i in zip(fresh, data, slot.tolist(), ids, strict=True):
                memo[w] = (i,) if s >= 0 and by_slot[s] == b else self.merge(b)
        return memo

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens by id, and where they begin (one more than the largest id); a gap is empty."""
        spots = [b""] * (int(self.ids.max(initial=-1)) + 1)
        for token, i in zip(self.tokens, self.ids.tolist(), strict=True):
            spots[i] = token
        return np.frombuffer(b"".join(spots), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spots])]).astype(np.int64)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Pieces of a long text; cut before white space that follows something else, where no pre-token is cut."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and not (text[cut].isspace() and not text[cut - 1].isspace() and text[cut] not in "\x1c\x1d\x1e\x1f"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_texts(vocabulary: Vocabulary, find, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Ids of texts and the n+1 offsets; a pre-token is looked up once for all of them."""
    held = [[find(part) for part in parts(text)] for text in texts]
    known = vocabulary.resolve(set(chain.from_iterable(chain.from_iterable(held))))
    ids, sizes = [], []
    for pieces in held:
        got = list(chain.from_iterable(map(known.__getitem__, chain.from_iterable(pieces))))
        ids.append(np.array(got, np.int32))
        sizes.append(len(got))
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def decode_ids(ids: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ids, all in the table, and the bytes before each."""
    sizes = starts[ids + 1] - starts[ids]
    before = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts[ids] - before[:-1], sizes) + np.arange(before[-1])], before


def encode(rows: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids`` (array of int) and ``exact`` (whether decoding gave the text back) in the place of ``text``.

    Where ``rows`` has columns of those names already, underscores come before.
    """
    at = rows.columns.index(text)
    rest = rows.drop(text)
    name = spare_name(rest, ids)
    check = spare_name(rest, "exact")
    fields = [*rest.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` array<int>", f"`{check}` boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        data, starts = vocabulary.table()
        for batch in batches:
            column = batch.column(at)
            raw, offsets = text_buffers(column)
            for i, j in steps(offsets):
                some = column.slice(i, j - i)
                null = np.asarray(some.is_null())
                got, off = encode_texts(vocabulary, find, [x or "" for x in some.to_pylist()])
                back, before = decode_ids(got, data, starts)
                mine, ends = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(back) == len(mine) and np.array_equal(before[off], ends):
                    wrong = np.concatenate([[0], np.cumsum(back != mine)])[ends]
                    exact = wrong[1:] == wrong[:-1]
                else:
                    exact = np.array([np.array_equal(back[before[off[k]] : before[off[k + 1]]], mine[ends[k] : ends[k + 1]]) for k in range(j - i)], bool)
                where = pa.array(np.where(np.r_[null, False], 0, off).astype(np.int32), mask=np.r_[null, False]) if null.any() else pa.array(off.astype(np.int32))
                lists = pa.ListArray.from_arrays(where, pa.array(got))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for k, c in enumerate(batch.columns) if k != at), lists, pa.array(exact, mask=null)], [*(n for k, n in enumerate(batch.schema.names) if k != at), name, check])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the column ``text`` in the place of ``ids``."""
    at = rows.columns.index(ids)
    rest = rows.drop(ids)
    name = spare_name(rest, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{name}` string"])
    plain = rows.withColumn(ids, F.col(f"`{ids}`").cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = vocabulary.table()
        whole = data.tobytes()
        spots = starts.tolist()
        held = set(vocabulary.ids.tolist())
        for batch in batches:
            out = [None if row is None or not held.issuperset(row) else b"".join(whole[spots[i] : spots[i + 1]] for i in row).decode("utf-8", "replace") for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pa.array(out, pa.string())], [*(n for k, n in enumerate(batch.schema.names) if k != at), name])

    return plain.mapInArrow(run, schema)
