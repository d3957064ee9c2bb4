"""All queries by name, with the SQL that gives the same rows.

Names begin with the id of the operator that they show. Each runs over whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vectors as V
from passagework.functions.tokenizers import BytePairs
from passagework.operators import blocks as B
from passagework.operators import chunks as C
from passagework.operators import enrich as E
from passagework.operators import layout as L
from passagework.operators import metrics as M
from passagework.operators import questions as Q
from passagework.operators import reuse as R
from passagework.operators import search as S
from passagework.plans import bindings as D
from passagework.session import fresh_path, settle, table
from passagework.sources import files
from passagework.sources.corpora import Corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "m10_run_summary"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def to_six(x: Column) -> Column:
    """Six digits; what rounds to zero keeps its sign, as in SQL."""
    return F.signum(x) * F.abs(F.round(x, 6))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: to_six(F.col(c)) for c in columns})


# ---- sources and sinks


@query("SELECT item_id, text, length(text)::BIGINT AS chars FROM benchmark")
def s04_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "json")
    files.write_json(table(spark, d, "benchmark").select("item_id", "text"), path)
    return files.read_json(spark, path, "item_id bigint, text string").withColumn("chars", F.length("text").cast("long"))


@query("SELECT item_id, text FROM benchmark")
def s03_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    table(spark, d, "benchmark").write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return files.read_csv(spark, path).select(F.col("item_id").cast("bigint").alias("item_id"), "text")


@query(f"WITH RECURSIVE {D.HITS} SELECT 'documents' AS corpus, strategy, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY ALL")
def s05_index_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with vectors, written by corpus and strategy and read again."""
    path = fresh_path(spark, "index")
    files.write_index(D.all_strategies(spark, d).withColumn("corpus", F.lit("documents")), path)
    return files.read_index(spark, path).groupBy("corpus", "strategy").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {D.FLAT}, {D.HTML} SELECT 'documents' AS corpus, count(*) AS blocks, count(DISTINCT doc_id) AS docs FROM flat
UNION ALL SELECT 'pages', count(*), count(DISTINCT doc_id) FROM blocks""")
def s02_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of named corpora, each by its own parser."""
    corpora = Corpora(spark)
    corpora.add("documents", d, D.flat)
    corpora.add("pages", d, D.page_blocks)
    return corpora.blocks().groupBy("corpus").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("docs"))


@query("WITH r AS (SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang) SELECT *, false AS reranked FROM r UNION ALL SELECT *, true FROM r")
def s08_results_sink(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two runs as JSON, one of them reranked by its name, and read again."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    folder, schema = fresh_path(spark, "results"), "lang string, docs bigint, chars bigint"
    parts = [files.read_json(spark, files.write_results(rows, folder, "documents", again), schema).withColumn("reranked", F.lit(again)) for again in (False, True)]
    return parts[0].unionByName(parts[1])


# ---- parsing


@query(f"WITH {D.FLAT} SELECT doc_id, idx, text FROM flat")
def r01_flat_blocks(spark: SparkSession, d: str) -> DataFrame:
    return D.flat(spark, d).select("doc_id", "idx", "text")


@query(f"WITH {D.FLAT} SELECT d.doc_id, count(f.idx) AS blocks, count(f.idx) = 0 AS parse_failed, CASE WHEN count(f.idx) = 0 THEN 'no extractable text' ELSE '' END AS failure_reason FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN flat f USING (doc_id) GROUP BY ALL")
def r03_parse_state(spark: SparkSession, d: str) -> DataFrame:
    return B.parse_state(D.documents(spark, d), D.flat(spark, d))


@query(f"SELECT doc_id, {D.clean('text')} AS text FROM documents")
def r04_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


_FRAGMENTS = rf"""
lines0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS li FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
ws AS (SELECT doc_id, li, unnest(w) AS text, unnest(range(len(w))) AS j FROM (SELECT doc_id, li, list_filter(string_split({D.clean("line")}, ' '), lambda x: x <> '') AS w FROM lines0)),
fragments AS (
  SELECT doc_id, (li // 40 + 1)::INT AS page, li, j, CASE WHEN li % 9 = 0 THEN 18.0 WHEN li % 9 = 4 THEN 14.0 ELSE 10.0 END::DOUBLE AS size,
    800.0 - (li % 40) * 15.0 - CASE WHEN li % 40 >= 20 THEN 40.0 ELSE 0.0 END AS top, text FROM ws)"""


@query(f"WITH {_FRAGMENTS} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY top DESC, j, li) - 1)::INT AS n, text FROM fragments")
def r06_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(D.fragments(spark, d)).select("doc_id", "page", "n", "text")


@query(f"WITH {_FRAGMENTS} SELECT doc_id::VARCHAR AS doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY li, j) - 1)::INT AS seq, size, top::DOUBLE AS top, text FROM fragments WHERE doc_id IS NOT NULL")
def r05_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of files, decoded by a plug-in; the files here are JSON, with sizes of 1 and all scale in the matrix."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "page", F.lit(1.0).alias("size"), F.col("size").alias("scale"), "left", "bottom", "right", "top", "text")))
    made = D.fragments(spark, d).where("doc_id is not null").groupBy("doc_id").agg(F.to_json(parts).cast("binary").alias("content"))
    found = files.decode_fragments(made.select(F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), "content"), lambda path, content: (1, json.loads(content)))
    return found.where("failure_reason is null").select("doc_id", "page", "seq", "size", "top", "text")


_LINES = f"""{_FRAGMENTS},
lines AS (
  SELECT doc_id, page, li, any_value(size) AS size, any_value(top) - any_value(size) / 2 AS centre, string_agg(CASE WHEN j > 0 AND (j - 1) % 3 <> 0 THEN ' ' ELSE '' END || text, '' ORDER BY j) AS text
  FROM fragments GROUP BY doc_id, page, li)"""


@query(f"WITH {_LINES} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY li) - 1)::INT AS line, size, centre::DOUBLE AS centre, text FROM lines")
def r07_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(D.fragments(spark, d))


@query(f"""WITH {_LINES},
cut AS (SELECT *, CASE WHEN lag(size) OVER w = size AND abs(lag(centre) OVER w - centre) <= size * 1.8 THEN 0 ELSE 1 END AS new FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY li)),
numbered AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page ORDER BY li) - 1)::INT AS seq FROM cut)
SELECT doc_id, page, seq, max(size) AS size, {D.clean("string_agg(text, ' ' ORDER BY li)")} AS text FROM numbered GROUP BY doc_id, page, seq""")
def r09_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(L.lines(D.fragments(spark, d)))


@query(f"WITH {D.SPANS} SELECT doc_id, body FROM body")
def r10_body_size(spark: SparkSession, d: str) -> DataFrame:
    return L.body_size(D.line_spans(spark, d))


@query(f"WITH {D.SPANS} SELECT doc_id, size, level FROM levels")
def r11_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    return L.heading_levels(D.line_spans(spark, d))


@query(f"WITH {D.SPANS} SELECT doc_id, idx, type, text, page, level FROM tblocks")
def r13_typed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Types by size and by the looks of a heading."""
    return L.typed_blocks(D.line_spans(spark, d))


@query(f"""WITH {D.ITEMS}, {D.FLAT},
plain AS (SELECT doc_id, length({D.clean("text")})::BIGINT AS plain_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
got AS (SELECT doc_id, sum(length(text))::BIGINT AS chars FROM iblocks GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(chars, 0) >= plain_chars * 0.9::DOUBLE AS kept FROM plain LEFT JOIN got USING (doc_id))
SELECT doc_id, idx, text, true AS structured FROM iblocks SEMI JOIN (FROM kept WHERE kept) USING (doc_id)
UNION ALL SELECT doc_id, idx, text, false FROM flat ANTI JOIN (FROM kept WHERE kept) USING (doc_id)""")
def r14_retention_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A layout's blocks where they hold 90 % of the text, flat blocks where it lost more."""
    names = ["doc_id", "idx", "text", "structured"]
    found = L.model_blocks(D.layout_items(spark, d)).withColumn("structured", F.lit(True)).select(names)
    return L.with_fallback(found, D.flat(spark, d).withColumn("structured", F.lit(False)).select(names), D.plain_lengths(spark, d))


@query(f"WITH {D.ITEMS} SELECT * FROM iblocks")
def r16_layout_model(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a layout model's items: types by label, levels by depth, the first page."""
    return L.model_blocks(D.layout_items(spark, d))


@query(f"""WITH {D.ITEMS},
plain AS (SELECT doc_id, length({D.clean("text")})::BIGINT AS plain_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
got AS (SELECT doc_id, sum(length(text))::BIGINT AS chars FROM iblocks GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(chars, 0) AS chars, plain_chars FROM plain LEFT JOIN got USING (doc_id))
SELECT *, chars = 0 OR chars < plain_chars * 0.7::DOUBLE AS parse_failed,
  CASE WHEN chars = 0 THEN 'the layout has no text' WHEN chars < plain_chars * 0.7::DOUBLE THEN 'only ' || round(100 * chars / plain_chars)::INT || ' % of the text is in the layout''s blocks (' || chars || ' of ' || plain_chars || ' characters)' ELSE '' END AS failure_reason FROM s""")
def r18_layout_retention(spark: SparkSession, d: str) -> DataFrame:
    """What the model lost, by the reason; blocks stay (r16)."""
    return L.model_state(L.model_blocks(D.layout_items(spark, d)), D.plain_lengths(spark, d))


@query(f"WITH {D.ITEMS} SELECT label, type, count(*) AS n FROM (SELECT CASE WHEN lost THEN 'picture' ELSE ['title', 'section_header', 'text', 'list_item', 'page_header', 'chart'][n % 6 + 1] END AS label, CASE WHEN lost THEN 'other' ELSE type END AS type FROM items) GROUP BY ALL")
def r17_label_map(spark: SparkSession, d: str) -> DataFrame:
    return D.layout_items(spark, d).select("label", B.label_type(F.col("label")).alias("type")).groupBy("label", "type").agg(F.count("*").alias("n"))


@query(rf"""WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS t FROM documents),
b AS (SELECT doc_id, page, {D.clean("t")} AS text FROM l),
k AS (SELECT *, CASE WHEN page IS NOT NULL AND length(text) <= 120 THEN trim(lower(regexp_replace(text, '\d+', '', 'g'))) END AS key FROM b WHERE text <> ''),
c AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
f AS (SELECT doc_id, key FROM k JOIN c USING (doc_id) WHERE key IS NOT NULL AND n >= 5 GROUP BY doc_id, key, n HAVING count(DISTINCT page) >= greatest(2, floor(n * 0.3)))
SELECT k.doc_id, k.page, text, CASE WHEN f.key IS NOT NULL THEN 'footer' ELSE 'paragraph' END AS type FROM k LEFT JOIN f ON f.doc_id = k.doc_id AND f.key = k.key""")
def r20_page_furniture(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.countDistinct("doc_id").alias("page_count"))
    return B.mark_furniture(D.source_blocks(spark, d), counts).select("doc_id", "page", "text", "type")


@query(f"WITH {D.SPANS} SELECT doc_id, bool_or(type = 'heading') AS has_structure FROM tblocks GROUP BY doc_id")
def r21_has_structure(spark: SparkSession, d: str) -> DataFrame:
    return B.structure(L.typed_blocks(D.line_spans(spark, d)))


@query(f"WITH {D.HTML} SELECT doc_id, idx, type, text, page, level FROM blocks WHERE type <> 'footer' AND text <> ''")
def r22_content_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Content of the pages' typed blocks."""
    return B.content(D.page_blocks(spark, d))


@query(f"WITH {D.HTML} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM blocks WHERE type <> 'footer' GROUP BY doc_id")
def r23_document_text(spark: SparkSession, d: str) -> DataFrame:
    return B.document_text(D.page_blocks(spark, d))


@query(f"""WITH {D.SPANS},
h AS (SELECT * FROM tblocks WHERE type = 'heading'),
onpath AS (SELECT b.doc_id, b.idx, h.idx AS hi, h.text FROM tblocks b JOIN h ON h.doc_id = b.doc_id AND h.idx < b.idx
  WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = b.doc_id AND g.idx > h.idx AND g.idx < b.idx AND g.level <= h.level))
SELECT b.doc_id, b.idx, coalesce(list(text ORDER BY hi) FILTER (hi IS NOT NULL), []) AS heading_path FROM (SELECT doc_id, idx FROM tblocks) b LEFT JOIN onpath USING (doc_id, idx) GROUP BY b.doc_id, b.idx""")
def r24_heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return B.heading_paths(L.typed_blocks(D.line_spans(spark, d)))


_TRIAGE = "t AS (SELECT doc_id, 1 + length(text) // 3000 AS pages, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL)"


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return B.triage(docs.select("doc_id", (1 + F.floor(F.length("text") / 3000)).alias("page_count")), docs.select("doc_id", "text"))


@query(f"WITH {_TRIAGE} SELECT doc_id, pages, chars, round(chars / pages, 6) AS chars_per_page, chars / pages < 100 AS scanned FROM t")
def r25_triage(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their characters, 3,000 a page; under 100 a page counts as scanned."""
    return rounded(_triaged(spark, d), "chars_per_page")


@query(f"WITH {_TRIAGE} SELECT count(*) AS docs, count(*) FILTER (chars / pages < 100) AS scanned, sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, list_sort(list(pages))[count(*) // 2 + 1] AS median_pages, (sum(chars) // 4)::BIGINT AS tokens_guess FROM t")
def r26_triage_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.triage_summary(_triaged(spark, d))


@query(f"""WITH {D.SPANS}, {D.FLAT},
b AS (SELECT 'lines' AS parser, doc_id, type FROM tblocks UNION ALL SELECT 'flat', doc_id, 'paragraph' FROM flat),
p AS (SELECT parser, doc_id, count(*) AS blocks, count(*) FILTER (type = 'heading') AS headings FROM b GROUP BY ALL),
d AS (SELECT parser, doc_id, 1 + length(text) // 3000 AS page_count, length(text) / 8192.0::DOUBLE AS seconds FROM documents, (VALUES ('lines'), ('flat')) v(parser) WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT parser, count(*) AS docs, sum(page_count)::BIGINT AS pages, coalesce(sum(blocks), 0)::BIGINT AS blocks, coalesce(sum(headings), 0)::BIGINT AS headings, count(*) FILTER (headings > 0) AS with_structure,
  count(*) FILTER (blocks IS NULL) AS failed, round(sum(seconds) / sum(page_count), 6) AS seconds_per_page FROM d LEFT JOIN p USING (parser, doc_id) GROUP BY parser""")
def r27_parser_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two parsers of the documents; as a clock repeats nothing, a character counts 1/8192 s."""
    names = ["doc_id", "type"]
    lines = L.typed_blocks(D.line_spans(spark, d)).select(F.lit("lines").alias("parser"), *names)
    blocks = lines.unionByName(D.flat(spark, d).select(F.lit("flat").alias("parser"), *names))
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null")
    size = F.length("text")
    both = docs.select(F.explode(F.array(F.lit("lines"), F.lit("flat"))).alias("parser"), "doc_id", (1 + F.floor(size / 3000)).alias("page_count"), (size / 8192).alias("seconds"))
    return rounded(B.compare_parsers(both, blocks), "seconds_per_page")


# ---- chunks


@query(f"SELECT doc_id, {D.n_toks('text')} AS n_tokens FROM documents")
def k02_count_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


@query()
def k01_bpe_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents by the byte-level plug-in, and the chunks that it cuts; tests hold both against the library."""
    plug = BytePairs(spark)
    return table(spark, d, "documents").select("doc_id", plug.count(F.col("text")).alias("n_tokens"), F.size(plug.windows(F.col("text"), C.CHUNK, C.CHUNK)).alias("windows"))


_FIXED = "SELECT chunk_id, ord, text AS raw_text, strategy FROM chunks WHERE strategy = '{}'"


@query(f"WITH {D.CHUNKS} " + _FIXED.format("fixed"))
def k03_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed(D.flat(spark, d)).select("chunk_id", "ord", "raw_text", "strategy")


@query(f"WITH {D.CHUNKS} " + _FIXED.format("fixed-no-overlap"))
def k04_fixed_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed(D.flat(spark, d), overlap_ratio=0.0).select("chunk_id", "ord", "raw_text", "strategy")


@query(f"WITH RECURSIVE {D.HTML},{D.structural('ch', 'blocks', D.SMALL_CHUNK)} SELECT chunk_id, raw_text, text AS embed_text, heading_path, degraded FROM ch")
def k08_contextual_heading(spark: SparkSession, d: str) -> DataFrame:
    """Oversized blocks cut, runs packed, paths put before."""
    return C.contextual_heading(D.page_blocks(spark, d), D.SMALL_CHUNK).select("chunk_id", "raw_text", "embed_text", "heading_path", "degraded")


@query(f"WITH RECURSIVE {D.SPANS},{D.structural('ch', 'tblocks', D.SMALL_CHUNK)} SELECT doc_id || '::contextual-heading::' || run AS chunk_id, min(page) AS page_start, max(page) AS page_end FROM ch_p JOIN tblocks USING (doc_id, idx) GROUP BY doc_id, run")
def a08_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """First and last page of each chunk."""
    return C.contextual_heading(L.typed_blocks(D.line_spans(spark, d)), D.SMALL_CHUNK).select("chunk_id", "page_start", "page_end")


@query(f"WITH {D.CHUNKS}, n AS (SELECT doc_id, count(*) FILTER (strategy = 'fixed') AS chunks FROM chunks GROUP BY doc_id) SELECT d.doc_id, coalesce(chunks, 0) = 0 AS parse_failed, coalesce(chunks, 0) AS chunks FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN n ON n.doc_id = d.doc_id::VARCHAR")
def k13_chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document: those that failed have none, the others some."""
    blocks = D.flat(spark, d)
    state = B.parse_state(D.documents(spark, d), blocks)
    made = C.fixed(blocks).groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "name")
    return state.join(made, F.col("doc_id").cast("string") == F.col("name"), "left").select("doc_id", "parse_failed", F.coalesce("n", F.lit(0)).alias("chunks"))


@query(f"""WITH {D.HTML}, b AS (SELECT doc_id, idx, text, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS sec FROM blocks WHERE type <> 'footer')
SELECT doc_id || '::parent-doc::' || (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1) AS chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS section FROM b GROUP BY doc_id, sec""")
def k09_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections as parent-doc cuts them: with limits beyond any text, a child is its section and so is its parent."""
    whole = 1 << 30
    return C.parent_doc(D.page_blocks(spark, d), whole, whole).select("chunk_id", F.col("return_text").alias("section"))


@query(f"WITH RECURSIVE {D.HTML},{D.structural('pd', 'blocks', D.SMALL_CHILD, D.SMALL_PARENT)} SELECT chunk_id, raw_text, return_text, heading_path, degraded FROM pd")
def k10_parent_doc(spark: SparkSession, d: str) -> DataFrame:
    """Children within sections, with their bounded parents."""
    return C.parent_doc(D.page_blocks(spark, d), D.SMALL_CHILD, D.SMALL_PARENT).select("chunk_id", "raw_text", "return_text", "heading_path", "degraded")


_BOTH = f"{D.HTML},{D.structural('ch', 'blocks', D.SMALL_CHUNK)},{D.structural('pd', 'blocks', D.SMALL_CHILD, D.SMALL_PARENT)}"


@query(f"WITH RECURSIVE {_BOTH} SELECT chunk_id, length(return_text) > length(text) AS is_expanded, length(text) > length(raw_text) AS is_enriched FROM (SELECT chunk_id, raw_text, text, return_text FROM ch UNION ALL SELECT chunk_id, raw_text, text, return_text FROM pd)")
def k14_chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    """Paths enrich the chunks of one strategy, parents expand those of the other."""
    blocks = settle(D.page_blocks(spark, d))
    chunks = C.contextual_heading(blocks, D.SMALL_CHUNK).unionByName(C.parent_doc(blocks, D.SMALL_CHILD, D.SMALL_PARENT))
    return C.with_flags(C.complete(chunks)).select("chunk_id", "is_expanded", "is_enriched")


_PAGE_TEXT = "ptext AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM blocks WHERE type <> 'footer' GROUP BY doc_id)"


@query(f"""WITH RECURSIVE {D.HTML},{D.structural('ch', 'blocks', C.CHUNK)},{D.structural('pd', 'blocks', C.CHILD, C.PARENT)},
{_PAGE_TEXT},{D.fixed_cte('fx', 'fixed', 448, 'ptext')},{D.fixed_cte('fn', 'fixed-no-overlap', 512, 'ptext')}
SELECT strategy, count(*) AS chunks, count(DISTINCT doc_id) AS docs, min(chunk_id) AS first FROM (
  SELECT strategy, doc_id, chunk_id FROM ch UNION ALL SELECT strategy, doc_id, chunk_id FROM pd UNION ALL SELECT strategy, doc_id, chunk_id FROM fx UNION ALL SELECT strategy, doc_id, chunk_id FROM fn) GROUP BY strategy""")
def k15_strategy_fan_out(spark: SparkSession, d: str) -> DataFrame:
    blocks = settle(D.page_blocks(spark, d))  # read by each strategy
    return C.fan_out(blocks).groupBy("strategy").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.min("chunk_id").alias("first"))


# ---- enrichment


@query(f"""WITH {D.CHUNKS},
n AS (SELECT doc_id, {D.n_toks("text")} AS k FROM documents)
SELECT count(*) AS chunks, sum(least(2000, k) + tokens)::BIGINT AS tokens_in, count(*) * 320 AS tokens_out, round((sum(least(2000, k) + tokens) * 0.05 + count(*) * 320 * 0.4) / 1e6, 6) AS usd
FROM chunks c JOIN n ON n.doc_id::VARCHAR = c.doc_id WHERE strategy = 'fixed'""")
def n02_enrichment_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rounded(E.estimate(D.fixed_chunks(spark, d), docs), "usd").select("chunks", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), "usd")


@query(f"""WITH {D.CHUNKS}, l AS (SELECT c.chunk_id, c.text, CASE WHEN lang = 'en' THEN 'From ' || source ELSE '' END AS line FROM chunks c JOIN documents d ON d.doc_id::VARCHAR = c.doc_id WHERE strategy = 'fixed')
SELECT chunk_id, text AS raw_text, CASE WHEN line <> '' THEN line || chr(10) || chr(10) || text ELSE text END AS embed_text, CASE WHEN line <> '' THEN 'contextual-llm' ELSE 'fixed' END AS strategy FROM l""")
def n04_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a stand-in model: the source, for English documents alone."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("lang") == "en", F.concat(F.lit("From "), "source")).otherwise("").alias("line"))
    return E.with_line(D.fixed_chunks(spark, d).join(lines, "doc_id")).select("chunk_id", "raw_text", "embed_text", "strategy")


@query(f"WITH {D.CHUNKS} SELECT chunk_id FROM chunks WHERE strategy = 'fixed' AND tokens <> 512")
def n05_enrich_missing(spark: SparkSession, d: str) -> DataFrame:
    """Full chunks count as enriched already."""
    chunks = D.fixed_chunks(spark, d)
    return E.missing(chunks, chunks.where(T.count_tokens(F.col("raw_text")) == 512)).select("chunk_id")


# ---- embedding and search


@query(f"""WITH {D.CHUNKS}, s AS (SELECT strategy, count(*) AS texts, sum(tokens) AS tokens FROM chunks GROUP BY ROLLUP (strategy))
SELECT coalesce(strategy, 'TOTAL') AS strategy, texts, tokens::BIGINT AS tokens, round(tokens / 1e6 * 0.02, 9) AS usd FROM s""")
def e08_cost_table(spark: SparkSession, d: str) -> DataFrame:
    """Dry run (E01, E07, E08): no vector is made."""
    blocks = D.flat(spark, d)
    chunks = C.fixed(blocks).unionByName(C.fixed(blocks, overlap_ratio=0.0))
    return S.cost(chunks, "text-embedding-3-small").select("strategy", "texts", "tokens", F.round("usd", 9).alias("usd"))


@query(f"WITH q AS (SELECT qid, d, n FROM (SELECT item_id AS qid, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS d, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest({D.words('text')}) AS w FROM benchmark) GROUP BY ALL)) SELECT i.qid, list(coalesce(n, 0.0) ORDER BY i.d) AS embedding FROM (SELECT item_id AS qid, unnest(range(64)) AS d FROM benchmark) i LEFT JOIN q USING (qid, d) GROUP BY i.qid")
def e06_query_vectors(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return S.embed_distinct(items, "text", S.hash_embedder()).select("qid", F.col("embedding").cast("array<double>").alias("embedding"))


@query("SELECT vec_id, list_transform(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))), lambda x: round(x, 6)) AS unit FROM embeddings")
def v01_normalise(spark: SparkSession, d: str) -> DataFrame:
    return D.vectors(spark, d).select("vec_id", F.transform(V.normalise(F.col("embedding")), to_six).alias("unit"))


@query(f"WITH RECURSIVE {D.HITS} SELECT strategy, qid, chunk_id, rank, round(score, 6) AS score FROM deep WHERE rank < 10")
def v03_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.topk(D.index(spark, d), D.questions(spark, d)), "score").select("strategy", "qid", "chunk_id", "rank", "score")


@query("""SELECT qid, vec_id, rank, round(score, 6) AS score FROM (
  SELECT q.vec_id AS qid, v.vec_id, c.score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY c.score DESC, v.vec_id) - 1)::INT AS rank
  FROM embeddings q CROSS JOIN embeddings v, LATERAL (SELECT list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS score) c) WHERE rank < 10""")
def v03_topk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks for its nearest by cosine, itself included."""
    v = D.vectors(spark, d)
    found = S.topk(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), v.select(F.col("vec_id").alias("qid"), "embedding"), by=())
    return rounded(found.select("qid", F.col("chunk_id").alias("vec_id"), "rank", "score"), "score")


@query(f"WITH RECURSIVE {D.HITS}, {D.BUDGETED} SELECT strategy, qid, chunk_id, rank, tokens FROM budgeted")
def v04_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 hits, cut at 4,000 tokens."""
    return S.budgeted(D.hits(spark, d, S.DEEPEST)).select("strategy", "qid", "chunk_id", "rank", F.col("tokens").cast("long").alias("tokens"))


@query("SELECT vec_id AS chunk_id, len(embedding)::INT AS dims FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def v02_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors that are checked to be one to one."""
    v = D.vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "embedding")
    return S.aligned(v.select("chunk_id"), v).select("chunk_id", F.size("embedding").alias("dims"))


@query(f"WITH RECURSIVE {D.HITS} SELECT strategy, count(*) AS chunks, 64 AS dims, count(*) * 256 AS bytes FROM chunks GROUP BY strategy")
def v06_index_size(spark: SparkSession, d: str) -> DataFrame:
    return S.index_size(D.index(spark, d))


@query(f"WITH RECURSIVE {D.HITS} SELECT strategy, qid, rank, round(score, 6) AS score, path, left(return_text, 200) AS preview FROM deep WHERE rank < 3")
def v07_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    chunks = D.index(spark, d)
    return rounded(S.side_by_side(S.topk(chunks, D.questions(spark, d)), chunks), "score")


@query(f"WITH RECURSIVE {D.HITS} SELECT strategy, qid, chunk_id, rank FROM deep WHERE rank < 5")
def x01_no_rerank(spark: SparkSession, d: str) -> DataFrame:
    return S.no_rerank(S.topk(D.index(spark, d), D.questions(spark, d), S.WIDE), 5).select("strategy", "qid", "chunk_id", "rank")


@query(f"WITH RECURSIVE {D.RUNS} SELECT strategy, scoring, qid, chunk_id, rank, round(score, 6) AS score FROM runs WHERE reranker = 'overlap'")
def x02_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Reranked hits, wide then narrow and within the budget."""
    found = D.runs(spark, d).where("reranker = 'overlap'")
    return rounded(found.select("strategy", "scoring", "qid", "chunk_id", "rank", "score"), "score")


# ---- relevance and metrics


@query(f"SELECT item_id, {D.normal('text')} AS text FROM benchmark")
def m01_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.normalise(F.col("text")).alias("text"))


_SHORT = f"a AS (SELECT item_id, {D.words('text')} AS w FROM benchmark)"


@query(f"WITH {_SHORT} SELECT a.item_id AS a, b.item_id AS b, round({D.bag('a.w', 'b.w')}, 6) AS overlap FROM a, a b")
def m02_bag_overlap(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), T.words(F.col("text")).alias("w"))
    pairs = items.select(F.col("i").alias("a"), F.col("w").alias("aw")).crossJoin(items.select(F.col("i").alias("b"), F.col("w").alias("bw")))
    return pairs.select("a", "b", F.round(T.bag_overlap(F.col("aw"), F.col("bw")), 6).alias("overlap"))


@query(f"WITH {D.GOLD}, {_SHORT}, g AS (SELECT qid, gold_ord, {D.words('text')} AS g FROM gold) SELECT item_id, qid, gold_ord, round({D.covers('cw', 'g')}, 6) AS coverage FROM (SELECT item_id, w AS cw FROM a) CROSS JOIN g")
def m03_coverage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("t"))
    return items.crossJoin(D.gold(spark, d)).select("item_id", "qid", "gold_ord", F.round(M.coverage(F.col("t"), F.col("text")), 6).alias("coverage"))


_RUN = "strategy, scoring, reranker"


@query(f"WITH RECURSIVE {D.RESULTS} SELECT {_RUN}, qid, relevant_ranks, retrieved, tokens_returned, gold_count FROM results")
def m06_query_results(spark: SparkSession, d: str) -> DataFrame:
    """Relevant ranks and returned tokens of every run."""
    return D.results(spark, d)


@query(f"WITH RECURSIVE {D.RESULTS} SELECT {_RUN}, qid, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(rr, 6) AS rr, round(ndcg_at_10, 6) AS ndcg_at_10 FROM scores")
def m09_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of every query."""
    names = ["recall_at_1", "recall_at_5", "recall_at_10", "rr", "ndcg_at_10"]
    return rounded(M.per_query(D.results(spark, d)).select(*M.RUN, "qid", *names), *names)


_MEANS = "count(*) AS queries, avg(recall_at_1) AS recall_at_1, avg(recall_at_5) AS recall_at_5, avg(recall_at_10) AS recall_at_10, avg(ndcg_at_10) AS ndcg_at_10, avg(rr) AS mrr, median(tokens_returned) AS median_tokens"


@query(f"""WITH RECURSIVE {D.RESULTS}, m AS (SELECT {_RUN}, {_MEANS} FROM scores GROUP BY ALL)
SELECT {_RUN}, queries, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(ndcg_at_10, 6) AS ndcg_at_10, round(mrr, 6) AS mrr, round(median_tokens, 6) AS median_tokens,
  round(coalesce(ndcg_at_10 / nullif(median_tokens / 1000, 0), 0), 6) AS ndcg_per_1k_tokens FROM m""")
def m10_run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.summary(D.results(spark, d))
    return rounded(out, *[c for c in out.columns if c not in (*M.RUN, "queries")])


@query("""WITH t AS (SELECT conv_id, turn, text AS question, source AS base FROM (SELECT conv_id, turn, text, lower(text) AS source FROM conversations WHERE role = 'user')),
s AS (SELECT count(DISTINCT base) >= 0.9 * count(*) AS distinct_enough FROM t)
SELECT conv_id, turn, CASE WHEN distinct_enough THEN 'base_question' ELSE 'question' END AS query_form, CASE WHEN distinct_enough THEN coalesce(nullif(base, ''), question) ELSE question END AS query FROM t, s""")
def m11_query_form(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.lower("text").alias("base_question"))
    return M.query_form(turns).select("conv_id", "turn", "query_form", "query")


@query(f"""WITH RECURSIVE {D.RESULTS}, m AS (SELECT strategy, reranker, avg(ndcg_at_10) AS v FROM scores WHERE scoring = 'k=10' GROUP BY ALL)
SELECT strategy, round(any_value(v) FILTER (reranker = 'none'), 6) AS plain, round(any_value(v) FILTER (reranker = 'overlap'), 6) AS reranked, round(any_value(v) FILTER (reranker = 'overlap') - any_value(v) FILTER (reranker = 'none'), 6) AS gain FROM m GROUP BY strategy""")
def m12_compare_rerankers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.compare(M.summary(D.results(spark, d))), "plain", "reranked", "gain")


# ---- questions and samples


@query("""WITH g AS (SELECT source AS doc_id, string_split(text, chr(10)) AS spans, lang AS category FROM documents WHERE text IS NOT NULL)
SELECT doc_id, category, list_filter(list_transform(spans, lambda s: trim(s)), lambda s: length(s) >= 80) AS spans FROM g""")
def q01_long_spans(spark: SparkSession, d: str) -> DataFrame:
    """Long spans of cells that hold list literals; a document's lines are such a cell."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.col("source").alias("doc_id"), F.col("lang").alias("category"), Q.long_spans(files.literal_list(F.to_json(F.split("text", "\n")))).alias("spans"))


@query("""WITH l AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT s_suppkey, s_name, list_filter([trim(s_name), trim(n_name), trim(r_name)], lambda x: length(x) > 8)[1:2] AS w FROM l)
SELECT s_suppkey, CASE WHEN len(w) = 0 THEN trim(s_name) WHEN trim(s_name) = '' THEN array_to_string(w, ' and ') ELSE trim(s_name) || ' between ' || array_to_string(w, ' and ') END AS identity FROM p""")
def q02_identity(spark: SparkSession, d: str) -> DataFrame:
    where = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", Q.identity_of_cells(F.to_json(F.array("s_name")), F.to_json(F.array("s_name", "n_name", "r_name"))).alias("identity"))


_WIDE = "w AS (SELECT doc_id, source AS identity, lang, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) >= 80) AS gold FROM documents)"


@query(f"""WITH {_WIDE}, u AS (SELECT *, 'first' AS category, 'What opens it?' AS base FROM w WHERE lang = 'en' AND len(gold) > 0 UNION ALL SELECT *, 'other', 'What else?' FROM w WHERE lang <> 'en' AND len(gold) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(doc_id || '|0'), doc_id) AS n FROM u)
SELECT category, doc_id, identity || ': ' || base AS question, base AS base_question, gold FROM r WHERE n <= 15 AND identity <> ''""")
def q03_question_set(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    wide = table(spark, d, "documents").select("doc_id", F.col("source").alias("identity"), F.when(F.col("lang") == "en", lines).alias("first"), F.when(F.col("lang") != "en", lines).alias("other"))
    return Q.question_set(wide, {"first": "What opens it?", "other": "What else?"})


@query("""WITH p AS (SELECT item_id AS place, text FROM benchmark), q AS (SELECT vec_id AS passage, 'Question ' || vec_id AS question FROM embeddings)
SELECT question, question AS base_question, place::VARCHAR AS doc_id, [text] AS gold FROM q JOIN p ON passage = place""")
def q04_curated_set(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("place"), F.col("item_id").cast("string").alias("doc_id"), F.lit(None).cast("int").alias("page"), "text")
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage"), F.concat(F.lit("Question "), F.col("vec_id").cast("string")).alias("question"))
    return Q.curated_set(asked, passages).select("question", "base_question", "doc_id", "gold")


_PROSE = rf"""
NOT regexp_matches(lower(text), '{T.BOILERPLATE}')
AND (length(text) - length(replace(text, '.', ''))) / length(text) <= 0.08 AND length(regexp_replace(text, '\P{{L}}', '', 'g')) / length(text) >= 0.65
AND len(ws) >= 60 AND len(list_filter(ws, lambda w: length(w) > 18 OR regexp_matches(w, '[0-9]') AND length(w) > 8)) / len(ws) <= 0.06"""


@query(rf"""WITH {D.FLAT}, c AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM flat WHERE length(text) BETWEEN 450 AND 1200)
SELECT doc_id, idx FROM c WHERE {_PROSE}""")
def u07_passage_candidates(spark: SparkSession, d: str) -> DataFrame:
    return Q.candidates(D.flat(spark, d), after_page=0).select("doc_id", "idx")


@query(rf"""WITH {D.FLAT}, c AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM flat WHERE length(text) BETWEEN 450 AND 1200)
SELECT doc_id, left(doc_id::VARCHAR, 80) AS title, 1 AS page, text FROM (SELECT * FROM c WHERE {_PROSE}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(idx || '|0'), idx) <= 2""")
def q05_sample_passages(spark: SparkSession, d: str) -> DataFrame:
    return Q.sample_passages(D.flat(spark, d), D.documents(spark, d), after_page=0)


@query(f"WITH {D.SPANS}, t AS (SELECT doc_id, arg_min(text, idx) AS t FROM tblocks WHERE type = 'heading' AND length(text) > 20 GROUP BY doc_id) SELECT doc_id, left(coalesce(t, doc_id::VARCHAR), 80) AS title FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN t USING (doc_id)")
def w08_titles(spark: SparkSession, d: str) -> DataFrame:
    return Q.titles(L.typed_blocks(D.line_spans(spark, d)), D.documents(spark, d))


@query("SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def a06_count_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Counts and distinct counts, the largest first."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources")).orderBy(F.desc("docs"), "lang")


@query("SELECT lang, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|7'), doc_id) <= 10")
def t04_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_per_group(table(spark, d, "documents"), "lang", "doc_id", 10, 7).select("lang", "doc_id", "source")


# ---- reuse


@query("SELECT doc_id, left(sha256(text), 32) AS content_hash FROM documents")
def c01_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return R.with_hash(table(spark, d, "documents"), "text").select("doc_id", "content_hash")


@query("WITH h AS (SELECT doc_id, left(sha256(text), 32) AS content_hash, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL) SELECT DISTINCT content_hash, chars FROM h")
def c04_get_or_compute(spark: SparkSession, d: str) -> DataFrame:
    """The first half by language is stored before, the rest is computed; each content once."""
    store, params = R.Store(spark, fresh_path(spark, "store")), R.hash_params(step="chars")
    docs = R.with_hash(table(spark, d, "documents").where("text is not null"), "text")
    chars = lambda rows: rows.select("content_hash", F.length("text").cast("long").alias("chars"))
    store.get_or_compute(docs.where("lang = 'en'"), "chars", params, chars)
    return store.get_or_compute(docs, "chars", params, chars)


@query("SELECT content_hash, chars FROM (SELECT DISTINCT left(sha256(text), 32) AS content_hash, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL) ORDER BY content_hash LIMIT 150")
def c06_resume_batches(spark: SparkSession, d: str) -> DataFrame:
    """What two runs of a hundred and of fifty contents have stored, the first ones by hash."""
    store, params = R.Store(spark, fresh_path(spark, "store")), R.hash_params(step="chars")
    docs = R.with_hash(table(spark, d, "documents").where("text is not null"), "text")
    chars = lambda rows: rows.select("content_hash", F.length("text").cast("long").alias("chars"))
    for most in (100, 50):
        store.next_batch(docs, "chars", params, chars, most)
    return store.get("chars", params)


@query(f"WITH {D.CHUNKS}, p AS ({ORACLES['r03_parse_state']}) SELECT (SELECT count(*) FROM p) AS docs, (SELECT count(*) FROM p WHERE parse_failed) AS failed, (SELECT coalesce(list(doc_id || ': ' || failure_reason ORDER BY doc_id::VARCHAR || ': ' || failure_reason), []) FROM p WHERE parse_failed) AS failures, count(*) AS chunks, 0::BIGINT AS degraded, 0::BIGINT AS expanded, 0::BIGINT AS enriched, sum(tokens)::BIGINT AS tokens FROM chunks WHERE strategy = 'fixed'")
def a05_index_report(spark: SparkSession, d: str) -> DataFrame:
    blocks = D.flat(spark, d)
    return R.index_report(B.parse_state(D.documents(spark, d), blocks), R.build_index(blocks, C.fixed))
