"""Chunking strategies (K01 to K15): DataFrames of blocks to chunks, one row a chunk."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.tokenizers import Tokenizer, Words
from passagework.operators.blocks import document_text, path_before

CHUNK, OVERLAP, CHILD, PARENT = 512, 0.125, 128, 2048
NO_STRUCTURE = "parser recovered no headings"
SCHEMA = (
    "doc_id string, chunk_id string, ord bigint, raw_text string, embed_text string, return_text string, page_start int, page_end int, "
    "heading_path array<string>, strategy string, degraded boolean, degraded_reason string"
)
PART_CHARS, PART_ROWS = 4 << 20, 10_000
_TOKEN, _SPACE = re.compile(T.TOKEN), " \t\n\f\r"


def fixed(blocks: DataFrame, chunk_tokens: int = CHUNK, overlap_ratio: float = OVERLAP, name: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Windows of tokens over the whole text, each overlapping the one before.

    With the tokenizer of words all is in the JVM; a document's windows go through the explode, not its tokens.
    """
    if chunk_tokens <= 0:
        raise ValueError(f"chunk_tokens is {chunk_tokens}; it must be 1 at least")
    if not 0 <= overlap_ratio < 1:
        raise ValueError(f"overlap_ratio is {overlap_ratio}; it must be in [0, 1)")
    stride = chunk_tokens - int(chunk_tokens * overlap_ratio)
    strategy = name or ("fixed-no-overlap" if overlap_ratio == 0 else "fixed")
    cut = (tokenizer or Words()).windows(F.col("text"), chunk_tokens, stride)
    windows = document_text(blocks).select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(cut).alias("i", "raw_text"))
    out = windows.select("doc_id", F.col("i").cast("long").alias("ord"), "raw_text").where("raw_text <> ''")
    null = F.lit(None).cast("int")
    return out.select(
        "doc_id", F.concat_ws("::", "doc_id", F.lit(strategy), F.col("ord").cast("string")).alias("chunk_id"), "ord", "raw_text",
        F.col("raw_text").alias("embed_text"), F.col("raw_text").alias("return_text"), null.alias("page_start"), null.alias("page_end"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(strategy).alias("strategy"), F.lit(False).alias("degraded"), F.lit("").alias("degraded_reason"),
    )


Item = tuple[int, dict]
Piece = tuple[int, str, int | None, int]  # index, text, page, tokens


def pieces(items: list[Item], limit: int) -> Iterator[Piece]:
    """Blocks by piece, those over the limit cut into pieces."""
    for index, block in items:
        toks = _TOKEN.findall(block["text"])
        if len(toks) <= limit:
            yield index, block["text"], block["page"], len(toks)
            continue
        for at in range(0, len(toks), limit):
            cut = toks[at : at + limit]
            if body := "".join(cut).strip():
                yield index, body, block["page"], len(cut)


def packed(items: list[Item], limit: int) -> list[list[Piece]]:
    """Runs of consecutive pieces whose tokens stay within the limit."""
    runs: list[list] = []
    room = -1
    for piece in pieces(items, limit):
        if not runs or piece[3] > room:
            runs.append([])
            room = limit
        runs[-1].append(piece)
        room -= piece[3]
    return runs


def sections(items: list[Item]) -> list[list[Item]]:
    """Items split before each heading."""
    out: list[list[Item]] = []
    for item in items:
        if not out or item[1]["type"] == "heading":
            out.append([])
        out[-1].append(item)
    return out


class Section:
    """A section's text, whose tokens are found once for all its children."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends = [m.end() for m in _TOKEN.finditer(text)]

    def before(self, at: int) -> int:
        """Tokens of ``text[:at]``: those that end there, and one more where its word has begun."""
        n = bisect_right(self.ends, at)
        begin = self.ends[n - 1] if n else 0
        return n + bool(self.text[begin:at].strip(_SPACE))

    def bounded(self, child: str, limit: int, margin_of_child: bool = True, child_tokens: int | None = None) -> str:
        """The section, or the window of it about the child where it is too long.

        Without ``margin_of_child`` the window is centred on the child's begin (N01).
        """
        if len(self.ends) <= limit:
            return self.text
        at = self.text.find(child)
        start = 0
        if at >= 0:
            size = len(_TOKEN.findall(child)) if child_tokens is None and margin_of_child else child_tokens
            margin = (limit - size) // 2 if margin_of_child else limit // 2
            start = max(0, self.before(at) - max(0, margin))
        begin = self.ends[start - 1] if start else 0
        return self.text[begin : self.ends[min(start + limit, len(self.ends)) - 1]].strip() if start < len(self.ends) else ""


def bounded(section: str, child: str, limit: int, margin_of_child: bool = True) -> str:
    """``Section.bounded`` for one child."""
    return Section(section).bounded(child, limit, margin_of_child)


def _paths(blocks: list[dict]) -> Callable[[int], list[str]]:
    """The path before a place; places are asked for in order."""
    heads = [(i, (b["level"], b["text"])) for i, b in enumerate(blocks) if b["type"] == "heading"]
    if any(level is None for _, (level, _) in heads):
        return lambda at: path_before([h for i, h in heads if i < at])
    open_, done = [], 0

    def path_at(at: int) -> list[str]:
        nonlocal done
        while done < len(heads) and heads[done][0] < at:
            level, text = heads[done][1]
            while open_ and (open_[-1][0] >= level or level <= 1):
                open_.pop()
            open_.append((level, text))
            done += 1
        return [text for _, text in open_]

    return path_at


def _structural(blocks: DataFrame, strategy: str, make: Callable[[str, list[dict]], Iterator[tuple | None]]) -> DataFrame:
    """One pass over each document's blocks in order; ``make`` gives (raw, embed, return, path, pages) of its chunks, or None.

    Blocks come sorted by document from the shuffle, so a task holds an Arrow batch, one document, and chunks of up to
    ``PART_CHARS`` characters or ``PART_ROWS`` rows.
    """
    doc = F.col("doc_id").cast("string")
    order = Window.partitionBy(doc).orderBy("idx", "type", "text", "page", "level")
    ordered = blocks.select(doc.alias("doc_id"), (F.row_number().over(order) == 1).alias("first"), "type", "text", "page", "level")
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
        doc, held = None, []
        for batch in batches:
            for name, first, kind, text, page, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first and held:
                    yield doc, held
                    held = []
                doc = name
                held.append({"type": kind, "text": text, "page": page, "level": level})
        if held:
            yield doc, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, chars = [], 0
        for doc, held in documents(batches):
            flat = not any(b["type"] == "heading" for b in held)
            for n, found in enumerate(make(doc, held)):
                if found is None:
                    continue
                raw, embed, back, path, pages = found
                pages = [p for p in pages if p is not None]
                rows.append((doc, f"{doc}::{strategy}::{n}", n, raw, embed or raw, back or raw, min(pages, default=None), max(pages, default=None), path, strategy, flat, NO_STRUCTURE if flat else ""))
                chars += len(raw) + len(embed) + len(back)
                if chars > PART_CHARS or len(rows) >= PART_ROWS:
                    yield part()
                    rows, chars = [], 0
        if rows:
            yield part()

    return ordered.mapInArrow(run, SCHEMA)


def contextual_heading(blocks: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """Runs of blocks, searched with their heading path before them."""

    def make(doc: str, held: list[dict]) -> Iterator[tuple | None]:
        path_at = _paths(held)
        for run in packed([(i, b) for i, b in enumerate(held) if b["type"] != "footer"], chunk_tokens):
            body = "\n\n".join(p[1] for p in run).strip()
            path = path_at(run[0][0])
            yield (body, "\n\n".join([" > ".join(path), body] if path else [body]), body, path, [p[2] for p in run]) if body else None

    return _structural(blocks, "contextual-heading", make)


def parent_doc(blocks: DataFrame, child_tokens: int = CHILD, parent_tokens: int = PARENT) -> DataFrame:
    """Small runs within sections; what is returned is the section about them."""

    def make(doc: str, held: list[dict]) -> Iterator[tuple | None]:
        path_at = _paths(held)
        for section in sections([(i, b) for i, b in enumerate(held) if b["type"] != "footer"]):
            whole = Section("\n\n".join(b["text"] for _, b in section).strip())
            path, pages = path_at(section[0][0]), {b["page"] for _, b in section}
            for run in packed(section, child_tokens) if whole.text else ():
                if body := "\n\n".join(p[1] for p in run).strip():
                    yield body, body, whole.bounded(body, parent_tokens), path, pages

    return _structural(blocks, "parent-doc", make)


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed": fixed,
    "fixed-no-overlap": lambda blocks: fixed(blocks, overlap_ratio=0.0),
    "contextual-heading": contextual_heading,
    "parent-doc": parent_doc,
}


def fan_out(blocks: DataFrame, strategies: list[str] | dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Chunks of the same blocks under several strategies (K15, U01): by name, or plug-ins by the name they get.

    The blocks are read once a strategy; settle them first if they are dear.
    """
    if isinstance(strategies, dict):
        made = [f(blocks).withColumn("strategy", F.lit(name)) for name, f in strategies.items()]
    else:
        made = [STRATEGIES[n](blocks) for n in strategies or STRATEGIES]
    return reduce(DataFrame.unionByName, made)


def with_flags(chunks: DataFrame) -> DataFrame:
    """``chunks`` with is_expanded and is_enriched."""
    return chunks.withColumn("is_expanded", F.length("return_text") > F.length("embed_text")).withColumn("is_enriched", F.length("embed_text") > F.length("raw_text"))


def complete(chunks: DataFrame) -> DataFrame:
    """Empty embed and return texts become the raw text; a degraded chunk without a reason is an error when it is read."""
    filled = chunks.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), "raw_text") for c in ("embed_text", "return_text")})
    missing = F.col("degraded") & (F.coalesce("degraded_reason", F.lit("")) == "")
    return filled.withColumn("degraded_reason", F.when(missing, F.raise_error(F.lit("a degraded chunk needs a reason"))).otherwise(F.col("degraded_reason")))
