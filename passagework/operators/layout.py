"""Positioned text fragments to lines, paragraphs and typed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators.blocks import label_type

LINE, SPACE, PARAGRAPH = 0.5, 0.25, 1.8
LEVELS, LARGER, KEPT, MODEL_KEPT = 4, 1.15, 0.90, 0.70


def reading_order(fragments: DataFrame) -> DataFrame:
    """``fragments`` with ``n``: their place on the page, from the top down and the left on."""
    page = Window.partitionBy("doc_id", "page").orderBy(F.desc("top"), "left", "seq")
    return fragments.withColumn("n", F.row_number().over(page) - 1)


def lines(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, line, size, centre, text): fragments whose centres lie close to their line's first.

    A page is folded in reading order, as its fragments come sorted from the shuffle; what a task holds is an Arrow
    batch and the line that is open. Fragments of the size and centre of the one before are of its line, so only
    where one of these changes is there a step of Python.
    """
    here = Window.partitionBy("doc_id", "page").orderBy(-F.col("top"), "left", "seq", "size", "bottom", "right", "text")
    centre = (F.col("bottom") + F.col("top")) / 2
    rows = fragments.select("doc_id", "page", (F.row_number().over(here) == 1).alias("first"), F.col("size").cast("double"), centre.cast("double").alias("centre"), F.col("left").cast("double"), F.col("right").cast("double"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: list = []  # doc_id, page, line, size, centre, right, texts of the line that is open
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            first, size, mid, left, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2, 7))
            begins = first.copy()  # where a run of one size and centre begins
            begins[0] = True
            begins[1:] |= (size[1:] != size[:-1]) | (mid[1:] != mid[:-1])
            at = np.flatnonzero(begins)
            apart = np.zeros(count, bool)
            apart[1:] = left[1:] - right[:-1] > size[1:] * SPACE
            apart[at] = False
            texts = pc.binary_join_element_wise(pa.array(np.where(apart, " ", ""), pa.string()), batch.column(7).cast(pa.string()), "")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, count), pa.int32()), texts), "").to_pylist()
            falls = np.zeros(count, bool)
            falls[1:] = right[1:] < right[:-1]
            falls[at] = False
            uneven = np.logical_or.reduceat(falls, at).tolist()
            docs, pages = (batch.column(c).take(pa.array(at)).to_pylist() for c in range(2))
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), count], strict=True)):
                height, centre = float(size[a]), float(mid[a])
                fresh = bool(first[a]) or not line
                if not fresh and abs(centre - line[4]) <= max(height, line[3]) * LINE:
                    begin = a
                else:
                    if line:
                        out.append((*line[:5], "".join(line[6])))
                    line = [docs[i], pages[i], 0 if fresh else line[2] + 1, height, centre, float(right[a]), []]
                    if not uneven[i]:
                        line[5:] = float(right[b - 1]), [joined[i]]
                        continue
                    line[6].append(batch.column(7)[a].as_py())
                    begin = a + 1
                for j, text in enumerate(batch.column(7).slice(begin, b - begin).to_pylist(), begin):
                    line[6] += [" ", text] if left[j] - line[5] > height * SPACE else [text]
                    line[5] = max(float(right[j]), line[5])
                line[3] = max(height, line[3])
            yield _line_batch(out, batch.schema)
        if line:
            yield _line_batch([(*line[:5], "".join(line[6]))], batch.schema)

    kinds = {n: fragments.schema[n].dataType.simpleString() for n in ("doc_id", "page")}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line int, size double, centre double, text string")


def _line_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field(0).type, schema.field(1).type, pa.int32(), pa.float64(), pa.float64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "page", "line", "size", "centre", "text"])


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """(doc_id, page, seq, size, text): lines of one size that follow closely are a paragraph."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    joins = (F.lag("size").over(order) == F.col("size")) & (F.abs(F.lag("centre").over(order) - F.col("centre")) <= F.col("size") * PARAGRAPH)
    marked = line_rows.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("seq", F.sum("new").over(order) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    out = marked.groupBy("doc_id", "page", "seq").agg(F.max("size").alias("size"), T.clean(text).alias("text"))
    return out.where("text <> ''").select("doc_id", "page", F.col("seq").cast("int").alias("seq"), "size", "text")


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body): the size that most characters have; of equals the first to occur."""
    sums = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "seq")).alias("at"))
    best = sums.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", (-F.col("at.page")).alias("p"), (-F.col("at.seq")).alias("s"))).alias("body"))
    return best.select("doc_id", "body")


def heading_levels(spans: DataFrame) -> DataFrame:
    """(doc_id, size, level): the four largest sizes well over the body's."""
    large = spans.select("doc_id", "size").distinct().join(body_size(spans), "doc_id").where(F.col("size") >= F.col("body") * LARGER)
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return large.select("doc_id", "size", level.alias("level")).where(F.col("level") <= LEVELS)


def typed_blocks(spans: DataFrame) -> DataFrame:
    """(doc_id, idx, type, text, page, level): spans of a heading's size and looks are headings."""
    joined = spans.join(heading_levels(spans), ["doc_id", "size"], "left")
    heading = F.col("level").isNotNull() & T.looks_like_heading(F.col("text"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")) - 1
    return joined.select("doc_id", idx.alias("idx"), F.when(heading, "heading").otherwise("paragraph").alias("type"), "text", "page", F.when(heading, F.col("level")).alias("level"))


def retained(blocks: DataFrame, plain: DataFrame, least: float = KEPT) -> DataFrame:
    """(doc_id, chars, plain_chars, kept): whether blocks hold enough of a document's plain length."""
    got = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    out = plain.join(got, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "plain_chars")
    return out.withColumn("kept", F.col("chars") >= F.col("plain_chars") * least)


def with_fallback(blocks: DataFrame, flat: DataFrame, plain: DataFrame, least: float = KEPT) -> DataFrame:
    """``blocks`` of documents that kept enough text, ``flat`` blocks of the others."""
    kept = retained(blocks, plain, least).where("kept").select("doc_id")
    return blocks.join(kept, "doc_id", "left_semi").unionByName(flat.join(kept, "doc_id", "left_anti"))


def model_blocks(items: DataFrame) -> DataFrame:
    """(doc_id, idx, type, text, page, level): blocks of a layout model's items (doc_id, n, label, depth, text, pages).

    A label gives the type, unknown ones "other"; a heading's level is its depth from 1; the page is the first
    place of an item, or null (R19). Items without text give no block. A model is a plug-in of ``sources.files``,
    or anything that makes such rows.
    """
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1
    kind = label_type(F.lower(F.coalesce("label", F.lit(""))))
    made = items.where(~T.is_blank(F.col("text"))).withColumn("type", kind)
    level = F.when(F.col("type") == "heading", F.col("depth") + 1).cast("int")
    return made.select("doc_id", idx.alias("idx"), "type", T.clean(F.col("text")).alias("text"), F.get("pages", F.lit(0)).alias("page"), level.alias("level"))


def model_state(blocks: DataFrame, plain: DataFrame, least: float = MODEL_KEPT) -> DataFrame:
    """(doc_id, chars, plain_chars, parse_failed, failure_reason): a model that loses too much text has failed.

    Its blocks are kept all the same: what is there may be searched, and the reason stays with the document.
    """
    out = retained(blocks, plain, least)
    none, short = F.col("chars") == 0, ~F.col("kept") & (F.col("plain_chars") > 0)
    share = F.round(F.try_divide(100 * F.col("chars"), F.col("plain_chars"))).cast("int")
    lost = F.concat(F.lit("only "), share.cast("string"), F.lit(" % of the text is in the layout's blocks ("), F.col("chars").cast("string"), F.lit(" of "), F.col("plain_chars").cast("string"), F.lit(" characters)"))
    reason = F.when(none, "the layout has no text").when(short, lost).otherwise("")
    return out.select("doc_id", "chars", "plain_chars", (none | short).alias("parse_failed"), reason.alias("failure_reason"))
