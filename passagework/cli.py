"""``python -m passagework.cli cost FOLDER`` and ``query FOLDER QUESTION --local``.

Text files are decoded here, with headings or flat; ``--parser module:function`` takes a plug-in of
``sources.files.decode`` for other kinds, and ``--embedder module:function`` a client that embeds texts.
"""

from __future__ import annotations

import argparse
import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import chunks as C
from passagework.operators import search as S
from passagework.session import get_session
from passagework.sources import files


def text_parser(path: str, content: bytes) -> tuple[int, list[dict]]:
    """Paragraphs between blank lines; ``#`` marks a heading and its level."""
    found = []
    for piece in re.split(r"\n\s*\n", content.decode("utf-8")):
        text = " ".join(piece.split())
        marks = len(text) - len(text.lstrip("#"))
        if body := text[marks:].strip():
            found.append({"type": "heading" if marks else "paragraph", "text": body, "page": 1, "level": marks or None})
    return 1, found


def flat_parser(path: str, content: bytes) -> tuple[int, list[dict]]:
    """Paragraphs between blank lines, without headings."""
    count, found = text_parser(path, content)
    return count, [block | {"type": "paragraph", "level": None} for block in found]


PARSERS = {"text": text_parser, "flat": flat_parser}


def plug_in(name: str) -> Callable:
    """A function by ``module:name``."""
    module, _, function = name.partition(":")
    if not function:
        raise SystemExit(f"{name}: give module:function, or one of {', '.join(PARSERS)} for a parser")
    return getattr(importlib.import_module(module), function)


def read_folder(spark: SparkSession, folder: str, suffix: str, limit: int | None, parser: str = "text") -> DataFrame:
    rows = files.decode(files.scan_binary(spark, folder, suffix, limit), PARSERS.get(parser) or plug_in(parser))
    return rows.where("idx is not null").select("doc_id", "idx", "type", "text", "page", "level")


def cost(blocks: DataFrame, strategies: list[str], model: str) -> DataFrame:
    return S.cost(C.fan_out(blocks, strategies), model)


def ask(blocks: DataFrame, question: str, strategies: list[str], k: int, client: Callable | None = None) -> DataFrame:
    """The first k chunks of each strategy; without a client vectors are made here (hashed words)."""

    def embed(rows: DataFrame, text: str) -> DataFrame:
        return S.embed_in_batches(rows, client, text) if client else rows.withColumn("embedding", S.hash_embedder()(F.col(text)))

    chunks = embed(C.fan_out(blocks, strategies), "embed_text")
    asked = embed(blocks.sparkSession.createDataFrame([(0, question)], "qid int, query string"), "query")
    return S.side_by_side(S.topk(chunks, asked, k), chunks, k).orderBy("strategy", "rank")


def options() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser("passagework", description=__doc__)
    ap.add_argument("command", choices=["cost", "query"])
    ap.add_argument("folder")
    ap.add_argument("question", nargs="?", default="")
    ap.add_argument("--suffix", default=".txt")
    ap.add_argument("--limit", help="first files only", type=int)
    ap.add_argument("--strategies", choices=list(C.STRATEGIES), default=list(C.STRATEGIES), nargs="*")
    ap.add_argument("--model", default="text-embedding-3-small")
    ap.add_argument("--parser", default="text", help=f"{', '.join(PARSERS)} or module:function")
    ap.add_argument("--local", action="store_true", help="embed with hashed words, without a service")
    ap.add_argument("--embedder", help="module:function from texts to vectors")
    ap.add_argument("-k", default=3, type=int)
    return ap


def run(arguments: list[str] | None = None) -> int:
    args = options().parse_args(arguments)
    if args.command == "query" and not (args.local or args.embedder):
        raise SystemExit("query needs --local or --embedder module:function")
    spark = get_session("passagework")
    blocks = read_folder(spark, args.folder, args.suffix, args.limit, args.parser)
    if args.command == "cost":
        cost(blocks, args.strategies, args.model).show(truncate=False)
    else:
        ask(blocks, args.question, args.strategies, args.k, None if args.local else plug_in(args.embedder)).show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
