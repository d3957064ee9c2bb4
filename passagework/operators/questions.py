"""Question sets and sampled passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.names import spare
from passagework.sources.files import literal_list

MIN_SPAN, PER_GROUP = 80, 15
MIN_CHARS, MAX_CHARS, AFTER_PAGE = 450, 1200, 4


def long_spans(spans: Column, least: int = MIN_SPAN) -> Column:
    """Spans of enough characters, stripped."""
    return F.filter(F.transform(spans, T.strip), lambda s: F.length(s) >= least)


def first_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in a seeded order that any engine can repeat: MD5 of key and seed."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
    nth = spare(rows, "n")
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= n).drop(nth)


def identity(title: Column, parties: Column) -> Column:
    """``title between A and B`` from the first two long names; fewer names give less; '' without title and names (Q02)."""
    names = F.slice(F.filter(F.transform(parties, lambda p: F.trim(p)), lambda p: F.length(p) > 8), 1, 2)
    who = F.array_join(names, " and ")
    name = F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.size(names) == 0, name).when(name == "", who).otherwise(F.concat(name, F.lit(" between "), who))


def identity_of_cells(title: Column, parties: Column) -> Column:
    """The same from cells that hold list literals, of which a title is the first entry (Q01, Q02)."""
    return identity(F.get(literal_list(title), F.lit(0)), literal_list(parties))


def question_set(wide: DataFrame, categories: dict[str, str], per_category: int = PER_GROUP) -> DataFrame:
    """(category, doc_id, question, base_question, gold) from a column of spans a category (Q03).

    Rows without long spans go before the draw, rows without identity after it, so a category can have fewer (U08).
    """
    pairs = ", ".join(f"'{c}', `{c}`" for c in categories)
    long = wide.select("doc_id", "identity", F.expr(f"stack({len(categories)}, {pairs}) as (category, spans)"))
    found = long.withColumn("gold", long_spans(F.col("spans"))).where(F.size("gold") > 0)
    base = F.element_at(F.create_map(*[F.lit(x) for p in categories.items() for x in p]), F.col("category"))
    drawn = first_per_group(found, "category", "doc_id", per_category).where(F.coalesce("identity", F.lit("")) != "")
    return drawn.select("category", "doc_id", F.concat("identity", F.lit(": "), base).alias("question"), base.alias("base_question"), "gold")


def curated_set(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Questions (passage, question) with the passage of that place (Q04, J06); places that don't exist are left out."""
    return questions.join(passages, questions["passage"] == passages["place"]).select("question", F.col("question").alias("base_question"), "doc_id", "page", F.array("text").alias("gold"))


def titles(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading over 20 characters, or the id; 80 characters at most."""
    first = blocks.where((F.col("type") == "heading") & (F.length("text") > 20)).groupBy("doc_id").agg(F.min_by("text", "idx").alias("t"))
    return docs.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.substring(F.coalesce("t", F.col("doc_id").cast("string")), 1, 80).alias("title"))


def candidates(blocks: DataFrame, after_page: int = AFTER_PAGE) -> DataFrame:
    """Paragraphs of prose past the front matter."""
    size = F.length("text")
    return blocks.where((F.col("type") == "paragraph") & size.between(MIN_CHARS, MAX_CHARS) & (F.coalesce("page", F.lit(0)) > after_page) & T.is_prose(F.col("text")))


def sample_passages(blocks: DataFrame, docs: DataFrame, per_doc: int = 2, seed: int = 0, after_page: int = AFTER_PAGE) -> DataFrame:
    """(doc_id, title, page, text) (Q05)."""
    drawn = first_per_group(candidates(blocks, after_page), "doc_id", "idx", per_doc, seed)
    return drawn.join(titles(blocks, docs), "doc_id").select("doc_id", "title", "page", "text")
