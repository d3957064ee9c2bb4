"""Typed blocks: flat parsing, page furniture, heading paths, text and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.names import spare

LABELS = {
    "title": "heading", "section_header": "heading", "paragraph": "paragraph", "text": "paragraph", "table": "table", "list_item": "list_item",
    "caption": "caption", "page_footer": "footer", "page_header": "footer", "footnote": "footer", "formula": "other", "code": "other", "picture": "other",
}
FURNITURE_PAGES, FURNITURE_SHARE, FURNITURE_CHARS = 5, 0.30, 120
UNLEVELLED = 1_000_000


def flat_blocks(pages: DataFrame, pattern: str = r"\n\s*\n+") -> DataFrame:
    """(doc_id, idx, type, text, page, level): paragraphs of (doc_id, page, text) between blank lines."""
    pieces = pages.select("doc_id", "page", F.posexplode(F.split("text", pattern)).alias("pos", "piece")).where(~T.is_blank(F.col("piece"))).withColumn("text", T.clean(F.col("piece")))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1
    return pieces.select("doc_id", idx.alias("idx"), F.lit("paragraph").alias("type"), "text", "page", F.lit(None).cast("int").alias("level"))


def parse_state(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks, parse_failed, failure_reason): documents without blocks failed."""
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    out = docs.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    failed = F.col("blocks") == 0
    return out.select("doc_id", "blocks", failed.alias("parse_failed"), F.when(failed, "no extractable text").otherwise("").alias("failure_reason"))


def label_type(label):  # noqa: ANN001, ANN201 - Column to Column
    """Block type of a layout model's label; other where it is unknown."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, label), F.lit("other"))


def mark_furniture(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``blocks`` with short texts that stand on many pages of their document as footers.

    One aggregate by (doc, key) and a join on that key; nothing is collected.
    """
    short = F.col("page").isNotNull() & (F.length("text") <= FURNITURE_CHARS)
    key, mark = spare(blocks, "key"), spare(blocks, "furniture")
    keyed = blocks.withColumn(key, F.when(short, T.furniture_key(F.col("text"))))
    often = keyed.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.countDistinct("page").alias("on_pages")).join(page_counts.select("doc_id", "page_count"), "doc_id")
    least = F.greatest(F.lit(2), F.floor(F.col("page_count") * FURNITURE_SHARE))
    found = often.where((F.col("page_count") >= FURNITURE_PAGES) & (F.col("on_pages") >= least)).select("doc_id", key, F.lit(True).alias(mark))
    joined = keyed.join(found, ["doc_id", key], "left")
    return joined.select(*[(F.when(F.col(mark), "footer").otherwise(F.col("type")).alias("type") if c == "type" else F.col(c)) for c in blocks.columns])


def structure(blocks: DataFrame) -> DataFrame:
    """(doc_id, has_structure)."""
    return blocks.groupBy("doc_id").agg(F.max(F.col("type") == "heading").alias("has_structure"))


def content(blocks: DataFrame) -> DataFrame:
    """Blocks that are text of the document."""
    return blocks.where((F.col("type") != "footer") & (F.col("text") != ""))


def document_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): content joined by blank lines (R23); a document without content isn't there."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return content(blocks).groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def heading_paths(blocks: DataFrame, levels: int = 4) -> DataFrame:
    """(doc_id, idx, heading_path) for blocks whose headings have levels 1 to ``levels``.

    One window a level, so the work is linear: a level's last heading is on the path if it is later than
    the last ones of all outer levels. The block itself is not on its path.
    """
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when((F.col("type") == "heading") & (F.col("level") == n), F.struct("idx", "text")), ignorenulls=True).over(before).alias(f"h{n}") for n in range(1, levels + 1)]
    rows = blocks.select("doc_id", "idx", *last)
    outer, parts = F.lit(-1), []
    for n in range(1, levels + 1):
        at = F.coalesce(F.col(f"h{n}.idx"), F.lit(-1))
        parts.append(F.when(at > outer, F.col(f"h{n}.text")))
        outer = F.greatest(outer, at)
    return rows.select("doc_id", "idx", F.array_compact(F.array(*parts)).alias("heading_path"))


def path_before(headings: list[tuple[int | None, str]]) -> list[str]:
    """Path after some headings (level, text) in order; one without a level nests in the one before."""
    path: list[str] = []
    depth: int | None = None
    for level, text in reversed(headings):
        here = level if level is not None else UNLEVELLED if depth is None else depth - 1
        if depth is None or here < depth:
            path.append(text)
            depth = here
            if level is not None and level <= 1:
                break
    return path[::-1]


def triage(docs: DataFrame, blocks: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, pages, chars, chars_per_page, scanned) of (doc_id, page_count)."""
    chars = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    out = docs.join(chars, "doc_id", "left").select("doc_id", F.col("page_count").alias("pages"), F.coalesce("chars", F.lit(0)).alias("chars"))
    per = F.coalesce(F.try_divide("chars", "pages"), F.lit(0.0))
    return out.withColumn("chars_per_page", per).withColumn("scanned", per < least)


def triage_summary(rows: DataFrame) -> DataFrame:
    """One row: documents, scanned, pages, chars, the upper median of pages, and a guess of tokens.

    The median is found from a count for each number of pages.
    """
    upper = F.expr("percentile_disc(0.5) within group (order by pages desc)").cast("long")
    return rows.agg(F.count("*").alias("docs"), F.count_if("scanned").alias("scanned"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), upper.alias("median_pages"), F.floor(F.sum("chars") / 4).alias("tokens_guess"))


def compare_parsers(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per parser: documents, pages, blocks, headings, documents with structure, failed ones and seconds a page.

    ``docs`` is (parser, doc_id, page_count, seconds); a document without blocks has failed.
    """
    per_doc = blocks.groupBy("parser", "doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "heading").alias("headings"))
    joined = docs.join(per_doc, ["parser", "doc_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("blocks", "headings")})
    return joined.groupBy("parser").agg(
        F.count("*").alias("docs"), F.sum("page_count").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("headings").alias("headings"), F.count_if(F.col("headings") > 0).alias("with_structure"),
        F.count_if(F.col("blocks") == 0).alias("failed"), F.try_divide(F.sum("seconds"), F.sum("page_count")).alias("seconds_per_page"),
    )
