"""Corpora by name: where their documents are, and what makes blocks of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Corpora:
    """``parsers`` has, for each name, a function from the session and the corpus' place to its blocks."""

    spark: SparkSession
    places: dict[str, str] = field(default_factory=dict)
    parsers: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, place: str, parser: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self.places:
            raise ValueError(f"there is a corpus {name} already")
        self.places[name], self.parsers[name] = place, parser

    def blocks(self, *names: str) -> DataFrame:
        """Blocks of the corpora (all, if none is named) with ``corpus``; document ids are strings."""
        for name in names:
            if name not in self.places:
                raise ValueError(f"no corpus {name}; there are {', '.join(sorted(self.places))}")
        made = [self.parsers[n](self.spark, self.places[n]).withColumns({"doc_id": F.col("doc_id").cast("string"), "corpus": F.lit(n)}) for n in names or sorted(self.places)]
        return reduce(DataFrame.unionByName, made)
