"""Typed blocks of web pages, as a source of structured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T

_TAGS = "h1|h2|h3|h4|p|li|nav|footer"


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, idx, type, text, page, level): blocks at the tags for headings, paragraphs, items, nav and footer.

    Scripts, styles and comments go, other tags are dropped, and five entities are resolved. Empty
    blocks are left out and idx counts the rest. A null page has none.
    """
    bare = F.regexp_replace(F.col(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    marked = F.regexp_replace(F.regexp_replace(bare, rf"(?i)<({_TAGS})(?:\s[^>]*)?>", "\u0001$1\u0002"), rf"(?i)</(?:{_TAGS})>", "\u0001x\u0002")
    pieces = pages.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(F.split(marked, "\u0001")).alias("pos", "piece"))
    body = F.when(F.contains("piece", F.lit("\u0002")), F.substring_index("piece", "\u0002", -1)).otherwise(F.col("piece"))
    tag = F.when(F.contains("piece", F.lit("\u0002")), F.lower(F.substring_index("piece", "\u0002", 1))).otherwise("x")
    plain = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    out = pieces.select("doc_id", "pos", tag.alias("tag"), T.clean(plain).alias("text")).where("text <> ''")
    kind = F.when(F.col("tag").startswith("h"), "heading").when(F.col("tag") == "p", "paragraph").when(F.col("tag") == "li", "list_item").when(F.col("tag").isin("nav", "footer"), "footer").otherwise("other")
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return out.select("doc_id", idx.alias("idx"), kind.alias("type"), "text", F.lit(None).cast("int").alias("page"), F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).alias("level"))
