"""Files: binary documents with a decoder plug-in, JSON arrays, and partitioned chunk stores."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St

from passagework.functions import text as T

BLOCKS = "doc_id string, source_path string, page_count int, idx int, type string, text string, page int, level int, failure_reason string"


def scan_binary(spark: SparkSession, folder: str, suffix: str = ".pdf", limit: int | None = None) -> DataFrame:
    """(path, length, content) of files below ``folder`` by suffix in any case, in order of path; the first ``limit``.

    Only the listing is sorted for a limit; contents are read for its paths alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(suffix.lower()))
    if limit is None:
        return files.select("path", "length", "content")
    first = files.select("path").orderBy("path").limit(limit)
    return files.join(F.broadcast(first) if limit <= 100_000 else first, "path", "left_semi").select("path", "length", "content")


def has_magic(content: Column, magic: bytes = b"%PDF-") -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))


def decode(files: DataFrame, parser: Callable[[str, bytes], tuple[int, list[dict[str, Any]]]], partitions: int | None = None) -> DataFrame:
    """Blocks of files by a parser plug-in (P01, O01): ``parser(path, content)`` gives page count and blocks.

    A file that can't be read gives one row with its reason (R02), one without text "no extractable
    text" (R03). ``partitions`` spreads heavy parsers. ``source_path`` and ``idx`` give the order of the files
    and within them; rows come in any.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in BLOCKS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rpartition("/")[2].rpartition(".")[0]
                try:
                    count, blocks = parser(path, bytes(content))
                    reason = None if blocks else "no extractable text"
                except Exception as error:  # noqa: BLE001 - any failure of a decoder is a row
                    count, blocks, reason = 0, [], f"{type(error).__name__}: {error}"
                rows += [(name, path, count, i, b["type"], b["text"], b.get("page"), b.get("level"), None) for i, b in enumerate(blocks)]
                if reason:
                    rows.append((name, path, count, None, None, None, None, None, reason))
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("idx", "page", "level")})

    files = files.repartition(partitions) if partitions else files
    return files.select("path", "content").mapInPandas(run, BLOCKS)


FRAGMENT_ROWS = 10_000
_RUNS = re.compile("[ \t]{2,}|\t")
FRAGMENTS = "doc_id string, source_path string, page_count int, page int, seq int, size double, left double, bottom double, right double, top double, text string, failure_reason string"


def decode_fragments(files: DataFrame, parser: Callable[[str, bytes], tuple[int, list[dict[str, Any]]]], partitions: int | None = None) -> DataFrame:
    """Positioned fragments of text by a parser plug-in (R05), for ``operators.layout``.

    ``parser(path, content)`` gives the page count and, in any order, fragments with page, size, scale (of the
    matrix; 1 where there is none), left, bottom, right, top and text. The size is that on the page, to a tenth.
    Fragments without text are left out; a file that can't be read, or has none, gives a row with its reason.
    A task holds one file's fragments, and gives up to ``FRAGMENT_ROWS`` at once.
    """
    names = [part.split()[0] for part in FRAGMENTS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple, float] = {}

        def sized(f: dict[str, Any]) -> float:
            key = f["size"], f.get("scale", 1.0)
            if key not in sizes:
                if len(sizes) > 10_000:
                    sizes.clear()
                sizes[key] = round(key[0] * abs(key[1]), 1)
            return sizes[key]

        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                name = path.rpartition("/")[2].rpartition(".")[0]
                try:
                    count, found = parser(path, batch.column(1)[i].as_py())
                    kept = [(n, f) for n, f in enumerate(found) if f["text"] and f["text"].strip()]
                    columns = [[f["page"] for _, f in kept], [n for n, _ in kept], [sized(f) for _, f in kept], *([f[c] for _, f in kept] for c in ("left", "bottom", "right", "top")), [_clean(f["text"]) for _, f in kept]]
                    made = [pa.array([count] * len(kept), types[2]), *(pa.array(c, t) for c, t in zip(columns, types[3:-1], strict=True))]
                    reason = None if kept else "no extractable text"
                except Exception as error:  # noqa: BLE001 - any failure of a decoder is a row
                    count, kept, reason = 0, [], f"{type(error).__name__}: {error}"
                if reason:
                    made = [pa.array([count], types[2]), *(pa.nulls(1, t) for t in types[3:-1])]
                rows = len(made[0])
                whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, types[0]), rows), pa.repeat(pa.scalar(path, types[1]), rows), *made, pa.repeat(pa.scalar(reason, types[-1]), rows)], names)
                for at in range(0, rows, FRAGMENT_ROWS):
                    yield whole.slice(at, FRAGMENT_ROWS)

    files = files.repartition(partitions) if partitions else files
    return files.select("path", "content").mapInArrow(run, FRAGMENTS)


def _clean(text: str) -> str:
    """``functions.text.clean`` in Python; most words have nothing to clean."""
    if text.isprintable() and " " not in text:
        return text
    return _RUNS.sub(" ", text.replace("\u00a0", " ")).strip(T.SPACES)


def results_path(folder: str, corpus: str, reranked: bool = False) -> str:
    return f"{folder.rstrip('/')}/{corpus}{'-rerank' if reranked else ''}.json"


def write_results(rows: DataFrame, folder: str, corpus: str, reranked: bool = False) -> str:
    """A run's rows as JSON, by corpus and whether they were reranked (S08); gives the path."""
    path = results_path(folder, corpus, reranked)
    write_json(rows, path)
    return path


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays of records, in files below ``path``, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def write_json(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """``rows`` as JSON arrays of about ``per_file`` records, each in a folder of its own below ``path``."""
    parts = max(1, -(-rows.count() // per_file))
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.select(record.alias("r"), F.pmod(F.xxhash64(F.to_json(record)), F.lit(parts)).alias("part"))
    keyed.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("part").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quotes and line breaks in cells."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_index(chunks: DataFrame, path: str) -> bool:
    """Chunks with vectors, partitioned by corpus and strategy (S07); False where the store exists already."""
    if exists(chunks.sparkSession, path):
        return False
    chunks.write.partitionBy("corpus", "strategy").parquet(path)
    return True


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_index`` wrote; corpus and strategy come from the folders."""
    return spark.read.parquet(path)


@F.pandas_udf(St.ArrayType(St.StringType()))
def literal_list(cells: pd.Series) -> pd.Series:
    """Strings of a cell that holds a Python list literal, stripped, without empty ones; anything else has none (Q01)."""

    def one(cell: str | None) -> list[str]:
        try:
            found = ast.literal_eval(cell.strip()) if cell else None
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            found = None
        return [x for x in (str(x).strip() for x in found) if x] if isinstance(found, list) else []

    return cells.map(one)
