"""Reuse by content hash, spending guard and the index pipeline."""

from __future__ import annotations

import hashlib
import io
import json
import os
import threading
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators.enrich import BudgetError


def hash_params(**values: object) -> str:
    """The same for the same parameters in any order."""
    return hashlib.sha256(json.dumps(values, default=str, sort_keys=True).encode()).hexdigest()[:32]


def with_hash(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("content_hash", T.content_hash(F.col(column)))


class Store:
    """Results by content hash, one Parquet folder for each stage and parameters."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True) -> None:
        self.spark, self.root, self.enabled = spark, root.rstrip("/"), enabled

    def _path(self, stage: str, params: str) -> str:
        return f"{self.root}/stage={stage}/params={params}"

    def _fs(self, path: str):  # noqa: ANN202 - a Hadoop path and its file system
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, stage: str, params: str) -> DataFrame | None:
        """What is stored, or None. Files that can't be read are misses: their rows aren't there."""
        if not self.enabled:
            return None
        where, system = self._fs(self._path(stage, params))
        if not system.exists(where):
            return None
        for _ in range(2):  # the second time without what was broken
            try:
                return self.spark.read.option("ignoreCorruptFiles", "true").parquet(self._path(stage, params))
            except Exception as error:
                if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "CANNOT_READ" not in str(error):
                    raise
                if not self.remove_corrupt(stage, params):
                    return None
        return None

    def remove_corrupt(self, stage: str, params: str) -> int:
        """Delete the files of an entry that can't be read whole, and say how many; each is read by one task."""
        where, system = self._fs(self._path(stage, params))
        if not system.exists(where):
            return 0

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bad = []
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    try:
                        pq.read_table(io.BytesIO(content))
                    except (OSError, ValueError):
                        bad.append(path)
                yield pd.DataFrame({"path": bad}, dtype="object")

        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self._path(stage, params)).select("path", "content").mapInPandas(check, "path string")
        paths = [r.path for r in found.collect()]  # names of broken files
        for path in paths:
            broken, system = self._fs(path)
            system.delete(broken, False)
        return len(paths)

    def size_bytes(self) -> int:
        """Bytes of all that is stored."""
        where, system = self._fs(self.root)
        return int(system.getContentSummary(where).getLength()) if system.exists(where) else 0

    def next_batch(self, rows: DataFrame, stage: str, params: str, compute: Callable[[DataFrame], DataFrame], most: int) -> tuple[int, int]:
        """Compute and store the first ``most`` contents, by hash, that aren't stored.

        Gives how many were missing and how many are left; with ``most`` 0 it only reports.
        """
        todo = self.split(rows, stage, params)[1].dropDuplicates(["content_hash"])
        missing = todo.count()
        if most > 0 and missing and self.enabled:
            compute(todo.orderBy("content_hash").limit(most)).write.mode("append").parquet(self._path(stage, params))
            return missing, self.split(rows, stage, params)[1].select("content_hash").distinct().count()
        return missing, missing

    def split(self, rows: DataFrame, stage: str, params: str) -> tuple[DataFrame, DataFrame]:
        """Stored results of ``rows``, and the rows that have none."""
        held = self.get(stage, params)
        if held is None:
            return rows.limit(0), rows
        return held.join(rows.select("content_hash").distinct(), "content_hash", "left_semi"), rows.join(held.select("content_hash"), "content_hash", "left_anti")

    def get_or_compute(self, rows: DataFrame, stage: str, params: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results of ``rows``; only what is missing is computed, and appended (C04). ``compute`` keeps content_hash."""
        if not self.enabled:
            return compute(rows)
        _, todo = self.split(rows, stage, params)
        compute(todo.dropDuplicates(["content_hash"])).write.mode("append").parquet(self._path(stage, params))
        return self.split(rows, stage, params)[0]

    def hit_rate(self, rows: DataFrame, stage: str, params: str) -> float:
        """Share of rows that are stored; of none 0."""
        total = rows.count()
        return 1 - self.split(rows, stage, params)[1].count() / total if total else 0.0


class SpendGuard:
    """Ceilings for paid calls, on the driver, before anything runs."""

    def __init__(self, ledger: str, per_run: float | None = None, total: float | None = None) -> None:
        self.ledger = Path(ledger)
        self.per_run = per_run if per_run is not None else float(os.environ.get("PASSAGEWORK_MAX_RUN_USD", 1))
        self.total = total if total is not None else float(os.environ.get("PASSAGEWORK_MAX_TOTAL_USD", 3))
        self.run_usd, self.run_tokens = 0.0, 0
        self.lock = threading.Lock()

    def history(self) -> dict[str, Any]:
        if not self.ledger.exists():
            return {"total_usd": 0.0, "total_tokens": 0, "runs": 0}
        try:
            return json.loads(self.ledger.read_text())
        except ValueError as error:
            raise BudgetError(f"{self.ledger} is unreadable; what was spent isn't known") from error

    def check(self, usd: float) -> None:
        if usd > self.per_run:
            raise BudgetError(f"${usd:.4f} is more than a run may cost (${self.per_run:.2f})")
        if (spent := self.history()["total_usd"]) + usd > self.total:
            raise BudgetError(f"with ${spent:.4f} spent before, ${usd:.4f} is more than is left of ${self.total:.2f}")

    def record(self, usd: float, n_tokens: int) -> None:
        with self.lock:  # calls may run in several threads
            self.run_tokens, self.run_usd = self.run_tokens + n_tokens, self.run_usd + usd
        if self.run_usd > self.per_run:
            raise BudgetError(f"this run has cost ${self.run_usd:.4f} and ends here")

    def commit(self) -> dict[str, Any]:
        held = self.history()
        held = {
            "total_usd": round(held["total_usd"] + self.run_usd, 10), "total_tokens": held["total_tokens"] + self.run_tokens, "runs": held["runs"] + 1,
            "updated": datetime.now(UTC).isoformat(), "last_run_usd": round(self.run_usd, 10),
        }
        self.ledger.parent.mkdir(parents=True, exist_ok=True)
        fresh = self.ledger.with_suffix(".tmp")
        fresh.write_text(json.dumps(held))
        fresh.replace(self.ledger)
        self.run_usd, self.run_tokens = 0.0, 0
        return held


def index_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, failed ones and their reasons, chunks, degraded, expanded and enriched ones, tokens."""
    failed = docs.agg(F.count("*").alias("docs"), F.count_if("parse_failed").alias("failed"), F.sort_array(F.collect_list(F.when(F.col("parse_failed"), F.concat_ws(": ", F.col("doc_id").cast("string"), "failure_reason")))).alias("failures"))
    made = chunks.agg(
        F.count("*").alias("chunks"), F.count_if("degraded").alias("degraded"), F.count_if(F.length("return_text") > F.length("embed_text")).alias("expanded"),
        F.count_if(F.length("embed_text") > F.length("raw_text")).alias("enriched"), F.coalesce(F.sum(T.count_tokens(F.col("embed_text"))), F.lit(0)).alias("tokens"),
    )
    return failed.crossJoin(made)


def build_index(blocks: DataFrame, chunker: Callable[[DataFrame], DataFrame], embed: Callable | None = None, guard: SpendGuard | None = None, usd_per_million: float = 0.0) -> DataFrame:
    """Chunks with ``embedding`` (O03); without ``embed`` a dry run: chunks alone (E07). The guard sees the price first."""
    chunks = chunker(blocks)
    if embed is None:
        return chunks
    if guard is not None:
        tokens = chunks.agg(F.sum(T.count_tokens(F.col("embed_text")))).first()[0] or 0
        guard.check(tokens / 1e6 * usd_per_million)
    return chunks.withColumn("embedding", embed(F.col("embed_text")))


def worker_count(gib_per_worker: float = 1.5, cores: int | None = None, memory_gib: float | None = None) -> int:
    """Parsers that may run at once on a machine: by its cores but one, and by the memory each takes.

    ``PASSAGEWORK_WORKERS`` decides if it is set. A parser that loads models needs some 6 GiB; with
    ``spark.task.cpus`` at cores // worker_count an executor runs no more of them.
    """
    told = os.environ.get("PASSAGEWORK_WORKERS", "")
    if told.isdigit() and int(told):
        return int(told)
    cores = cores or os.cpu_count() or 4
    if memory_gib is None:
        memory_gib = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    return max(1, min(cores - 1, int(memory_gib / gib_per_worker) - 1))


def progress_line(done: int, total: int, seconds: float) -> str:
    """Done, share and the time that is left at the pace so far."""
    left = f"{seconds / done * (total - done):.0f} s left" if done else "time unknown"
    return f"{done} of {total} ({100 * done // total if total else 100} %), {left}"


def running_tasks(spark: SparkSession) -> tuple[int, int]:
    """Done and all tasks of the stages that run now; for ``progress_line`` from another thread."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
