"""How the tables stand in for documents, layouts, questions and vectors, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import blocks as B
from passagework.operators import chunks as C
from passagework.operators import layout as L
from passagework.operators import metrics as M
from passagework.operators import search as S
from passagework.session import fresh_path, settle, table
from passagework.sources import files
from passagework.sources.html_blocks import html_blocks

SMALL_CHUNK, SMALL_CHILD, SMALL_PARENT, EVAL_PARENT = 64, 32, 96, 512


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page, text): each document is one page."""
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.lit(1).alias("page"), "text")


def flat(spark: SparkSession, d: str) -> DataFrame:
    return B.flat_blocks(documents(spark, d))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of the web pages."""
    return html_blocks(table(spark, d, "pages"))


def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A source is a document, its documents are pages, their lines are blocks."""
    docs = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "t")).where(~T.is_blank(F.col("t")))
    return docs.select("doc_id", "page", "pos", T.clean(F.col("t")).alias("text"), F.lit("paragraph").alias("type"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents, set 40 lines to a page; each ninth line is large, and each third word touches the next."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line"))
    ws = lines.select("doc_id", "li", F.posexplode(F.filter(F.split(T.clean(F.col("line")), " "), lambda w: w != "")).alias("j", "text"))
    size = F.when(F.col("li") % 9 == 0, 18.0).when(F.col("li") % 9 == 4, 14.0).otherwise(10.0)
    row = F.col("li") % 40
    top = F.lit(800.0) - row * 15.0 - F.when(row >= 20, 40.0).otherwise(0.0)
    left = F.col("j") * 100.0
    right = left + F.when(F.col("j") % 3 == 0, 100.0).otherwise(90.0)
    return ws.select("doc_id", (F.floor(F.col("li") / 40) + 1).cast("int").alias("page"), (F.col("li") * 100_000 + F.col("j")).cast("int").alias("seq"), size.alias("size"), left.alias("left"), (top - size).alias("bottom"), right.alias("right"), top.alias("top"), "text")


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page, seq, size, text): the documents' lines as spans, sized as in ``fragments``."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line")).where(~T.is_blank(F.col("line")))
    size = F.when(F.col("li") % 9 == 0, 18.0).when(F.col("li") % 9 == 4, 14.0).otherwise(10.0)
    return lines.select("doc_id", (F.floor(F.col("li") / 40) + 1).cast("int").alias("page"), F.col("li").alias("seq"), size.alias("size"), T.clean(F.col("line")).alias("text"))


REGIONS = ("title", "section_header", "text", "list_item", "page_header", "chart")


def layout_items(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, label, depth, text, pages): the documents' lines as a layout model would give them.

    Each seventh line has no place; of German documents every second line is a picture, without its text.
    """
    lines = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kinds = F.array(*map(F.lit, REGIONS))
    lost = (F.coalesce("lang", F.lit("")) == "de") & (F.col("n") % 2 == 1)
    page = (F.floor(F.col("n") / 40) + 1).cast("int")
    pages = F.when(F.col("n") % 7 == 3, F.array().cast("array<int>")).otherwise(F.array(page, page + 1))
    label = F.when(lost, "picture").otherwise(F.element_at(kinds, (F.col("n") % len(REGIONS) + 1).cast("int")))
    return lines.select("doc_id", "n", label.alias("label"), (F.col("n") % 3).alias("depth"), F.when(~lost, F.col("line")).alias("text"), pages.alias("pages"))


def plain_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null")
    return docs.select("doc_id", F.length(T.clean(F.col("text"))).cast("long").alias("plain_chars"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed(flat(spark, d))


def two_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Fixed chunks of the documents with and without overlap, with tokens."""
    blocks = flat(spark, d)
    chunks = C.fixed(blocks).unionByName(C.fixed(blocks, overlap_ratio=0.0))
    return chunks.withColumn("tokens", T.count_tokens(F.col("return_text")))


def all_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every strategy, with tokens and vectors: fixed ones of the flat text, the others of the typed lines."""
    typed = settle(L.typed_blocks(line_spans(spark, d)))  # two strategies read it
    chunks = C.fan_out(flat(spark, d), ["fixed", "fixed-no-overlap"]).unionByName(C.contextual_heading(typed)).unionByName(C.parent_doc(typed, C.CHILD, EVAL_PARENT))
    return chunks.withColumn("tokens", T.count_tokens(F.col("return_text"))).withColumn("embedding", S.hash_embedder()(F.col("embed_text")))


_STORES: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of all strategies (S05 to S07): written by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES or not files.exists(spark, _STORES[key] + "/_SUCCESS"):
        path = fresh_path(spark, "index")
        files.write_index(all_strategies(spark, d).withColumn("corpus", F.lit("documents")), path)
        _STORES[key] = path
    return files.read_index(spark, _STORES[key]).where("corpus = 'documents'")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(qid, query, embedding): every benchmark passage asks for itself."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return items.withColumn("embedding", S.hash_embedder()(F.col("query")))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, gold_ord, doc_id, text): halves of the passage by words, each to be found in any document."""
    ws = F.split(T.clean(F.translate("text", "\n", " ")), " ")
    half = F.floor(F.size("ws") / 2).cast("int")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), ws.alias("ws"))
    first, rest = F.array_join(F.slice("ws", 1, half), " "), F.array_join(F.slice("ws", half + 1, F.size("ws")), " ")
    return items.select("qid", F.posexplode(F.array(first, rest)).alias("gold_ord", "text")).select("qid", "gold_ord", F.lit("").alias("doc_id"), "text")


def hits(spark: SparkSession, d: str, k: int = S.WIDE) -> DataFrame:
    """Ranked chunks of each strategy and question, with texts and tokens."""
    chunks = index(spark, d)
    found = S.topk(chunks, questions(spark, d), k)
    return S.with_chunks(found, chunks.select("strategy", "chunk_id", "doc_id", "return_text", "tokens"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every run: strategy by scoring by reranker (J09, X03, X04), from one search as deep as the deepest."""
    deep = settle(hits(spark, d, S.DEEPEST))
    asked = questions(spark, d).select("qid", "query")
    score = S.overlap_score(F.col("query"), F.col("return_text"))
    wide = S.rerank(deep.where(F.col("rank") < S.WIDE).join(asked, "qid"), score, S.K).drop("query")
    full = S.budgeted(deep)
    reordered = S.rerank(full.join(asked, "qid"), score, None).drop("query")
    named = [(S.no_rerank(deep, S.K), "k=10", "none"), (wide, "k=10", "overlap"), (full, "4000tok", "none"), (reordered, "4000tok", "overlap")]
    parts = [x.withColumn("scoring", F.lit(s)).withColumn("reranker", F.lit(r)) for x, s, r in named]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def results(spark: SparkSession, d: str) -> DataFrame:
    return M.query_results(runs(spark, d), gold(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("qid")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")


# ---- the same in DuckDB


def clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]+', ' ', 'g'), '^[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"


def normal(x: str) -> str:
    folded = f"translate({x}, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(160), '''''\"\"-- ')"
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({folded}, '-\s*\n\s*', '', 'g')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


TOKENS = r"'[ \t\n\f\r]*[^ \t\n\f\r]+'"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKENS})"


def n_toks(x: str) -> str:
    return f"coalesce(len({toks(x)}), 0)"


def words(x: str) -> str:
    return f"list_filter(string_split({normal(x)}, ' '), lambda w: w <> '')"


def bag(c: str, g: str) -> str:
    return f"(list_sum(list_transform(list_distinct({g}), lambda w: least(len(list_filter({g}, lambda x: x = w)), len(list_filter({c}, lambda x: x = w)))))::DOUBLE / len({g}))"


def covers(c: str, g: str) -> str:
    """Coverage of a list by another, as ``functions.text.coverage``."""
    step = f"greatest(1, len({g}) // 4)"
    slid = f"list_max(list_transform(range(0, len({c}) - len({g}) + 1, {step}), lambda s: {bag(f'list_slice({c}, s + 1, s + len({g}))', g)}))"
    return f"CASE WHEN len({c}) = 0 OR len({g}) = 0 THEN 0.0 WHEN len({c}) <= len({g}) THEN {bag(c, g)} ELSE {slid} END"


FLAT = rf"""
flat AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS idx, text FROM (
    SELECT doc_id, pos, {clean("piece")} AS text FROM (
      SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos
      FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n+') AS ps FROM documents WHERE doc_id IS NOT NULL)))
  WHERE text <> ''),
doctext AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM flat GROUP BY doc_id)"""


def fixed_cte(name: str, strategy: str, stride: int, texts: str = "doctext") -> str:
    return rf"""
{name} AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR || '::{strategy}::' || i AS chunk_id, i AS ord, text, '{strategy}' AS strategy FROM (
    SELECT doc_id, i, trim(array_to_string(list_slice(t, i * {stride} + 1, i * {stride} + 512), ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS text FROM (
      SELECT doc_id, t, unnest(range(greatest(0, ceil((len(t) - 512) / {stride}.0))::BIGINT + 1)) AS i FROM (SELECT doc_id, {toks("text")} AS t FROM {texts}) WHERE len(t) > 0))
  WHERE text <> '')"""


CHUNKS = f"{FLAT},{fixed_cte('fx', 'fixed', 448)},{fixed_cte('fn', 'fixed-no-overlap', 512)},\nchunks AS (SELECT *, {n_toks('text')} AS tokens FROM (SELECT * FROM fx UNION ALL SELECT * FROM fn))"


def embedded(name: str, rows: str, key: str, text: str) -> str:
    """Counts of hashed words: (key, d, n)."""
    return f"{name} AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS d, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({words(text)}) AS w FROM {rows}) GROUP BY ALL)"


ITEMS = rf"""
item0 AS (SELECT doc_id, lang, unnest(ls) AS line, unnest(range(len(ls)))::INT AS n FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL)),
items AS (
  SELECT doc_id, n, coalesce(lang, '') = 'de' AND n % 2 = 1 AS lost, {clean("line")} AS text, n % 3 AS depth, CASE WHEN n % 7 <> 3 THEN n // 40 + 1 END AS page,
    ['heading', 'heading', 'paragraph', 'list_item', 'footer', 'other'][n % 6 + 1] AS type FROM item0),
iblocks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS idx, type, text, page::INT AS page, CASE WHEN type = 'heading' THEN depth + 1 END::INT AS level
  FROM items WHERE NOT lost AND text <> '')"""

SPANS = rf"""
lines0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS li FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
spans AS (
  SELECT doc_id, (li // 40 + 1)::INT AS page, li::INT AS seq, CASE WHEN li % 9 = 0 THEN 18.0 WHEN li % 9 = 4 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, text
  FROM (SELECT doc_id, li, {clean("line")} AS text FROM lines0) WHERE text <> ''),
sums AS (SELECT doc_id, size, sum(length(text)) AS chars, min(li0) AS first_at FROM (SELECT *, page * 1000000 + seq AS li0 FROM spans) GROUP BY ALL),
body AS (SELECT doc_id, size AS body FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first_at) = 1),
levels AS (
  SELECT doc_id, size, level FROM (
    SELECT s.doc_id, s.size, dense_rank() OVER (PARTITION BY s.doc_id ORDER BY s.size DESC)::INT AS level FROM (SELECT DISTINCT doc_id, size FROM spans) s JOIN body USING (doc_id) WHERE s.size >= body * 1.15)
  WHERE level <= 4),
typed AS (
  SELECT s.doc_id, (row_number() OVER (PARTITION BY s.doc_id ORDER BY page, seq) - 1)::INT AS idx, page, text, level,
    level IS NOT NULL AND length(text) <= 120 AND NOT regexp_matches(lower(text), '{T.LINKS}')
      AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2 AND length(regexp_replace(text, '\P{{L}}', '', 'g')) >= 3
      AND length(regexp_replace(text, '\P{{L}}', '', 'g')) / length(text) >= 0.4 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text) >= 0.5 AS heading
  FROM spans s LEFT JOIN levels USING (doc_id, size)),
tblocks AS (SELECT doc_id, idx, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS type, text, page, CASE WHEN heading THEN level END AS level FROM typed)"""

ENDS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def structural(name: str, blocks: str, limit: int, parent: int | None = None) -> str:
    """CTEs of contextual-heading chunks, or (with ``parent``) of parent-doc ones; needs WITH RECURSIVE.

    ``name`` is (doc_id, chunk_id, ord, raw_text, text, return_text, path, strategy, degraded).
    """
    n = name
    strategy = "parent-doc" if parent else "contextual-heading"
    # sections begin at headings; without parents a document is one
    section = "sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY idx)" if parent else "0"
    back = f"""CASE WHEN {n_toks("whole")} <= {parent} THEN whole ELSE trim(array_to_string(list_slice({toks("whole")}, start + 1, start + {parent}), ''), {ENDS}) END""" if parent else "body"
    embed = "body" if parent else "CASE WHEN path <> '' THEN path || chr(10) || chr(10) || body ELSE body END"
    return rf"""
{n}_b AS (SELECT doc_id, idx, text, {section} AS sec FROM {blocks} WHERE type <> 'footer'),
{n}_t AS (SELECT *, {toks("text")} AS t FROM {n}_b),
{n}_i AS (SELECT *, unnest(range(greatest(1, ceil(len(t) / {limit}.0)::BIGINT))) AS i FROM {n}_t),
{n}_c AS (
  SELECT doc_id, sec, idx, i, CASE WHEN len(t) <= {limit} THEN text ELSE trim(array_to_string(list_slice(t, i * {limit} + 1, i * {limit} + {limit}), ''), {ENDS}) END AS text,
    CASE WHEN len(t) <= {limit} THEN len(t) ELSE least({limit}, len(t) - i * {limit}) END AS n FROM {n}_i),
{n}_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY idx, i) AS r FROM {n}_c WHERE text <> ''),
{n}_p AS (
  SELECT doc_id, sec, r, idx, text, n, 0 AS run, n AS used FROM {n}_n WHERE r = 1
  UNION ALL SELECT x.doc_id, x.sec, x.r, x.idx, x.text, x.n, CASE WHEN p.used + x.n > {limit} THEN p.run + 1 ELSE p.run END, CASE WHEN p.used + x.n > {limit} THEN x.n ELSE p.used + x.n END
  FROM {n}_p p JOIN {n}_n x ON x.doc_id = p.doc_id AND x.sec = p.sec AND x.r = p.r + 1),
{n}_r AS (SELECT doc_id, sec, run, trim(string_agg(text, chr(10) || chr(10) ORDER BY r), {ENDS}) AS body, min(idx) AS first FROM {n}_p GROUP BY ALL),
{n}_s AS (SELECT doc_id, sec, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS whole, min(idx) AS head FROM {n}_b GROUP BY ALL),
{n}_x AS (SELECT r.*, whole, {"head" if parent else "first"} AS spot FROM {n}_r r JOIN {n}_s USING (doc_id, sec) WHERE body <> ''),
{n}_h AS (SELECT doc_id, idx, text, level FROM {blocks} WHERE type = 'heading'),
{n}_q AS (
  SELECT x.doc_id, x.spot, string_agg(h.text, ' > ' ORDER BY h.idx) AS path, list(h.text ORDER BY h.idx) AS heading_path FROM (SELECT DISTINCT doc_id, spot FROM {n}_x) x JOIN {n}_h h ON h.doc_id = x.doc_id AND h.idx < x.spot
  WHERE NOT EXISTS (SELECT 1 FROM {n}_h g WHERE g.doc_id = x.doc_id AND g.idx > h.idx AND g.idx < x.spot AND g.level <= h.level) GROUP BY ALL),
{n}_d AS (SELECT doc_id, NOT bool_or(type = 'heading') AS degraded FROM {blocks} GROUP BY doc_id),
{n}_f AS (SELECT *, strpos(whole, body) AS found FROM {n}_x),
{n}_m AS (SELECT *, CASE WHEN found > 0 THEN greatest(0, {n_toks("left(whole, found - 1)")} - greatest(0, ({parent or 0} - {n_toks("body")}) // 2)) ELSE 0 END AS start FROM {n}_f),
{n} AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR || '::{strategy}::' || ord AS chunk_id, ord, body AS raw_text, {embed} AS text, {back} AS return_text, path, heading_path, '{strategy}' AS strategy, degraded
  FROM (SELECT m.*, coalesce(path, '') AS path, coalesce(heading_path, []) AS heading_path, {"row_number() OVER (PARTITION BY m.doc_id ORDER BY sec, run) - 1" if parent else "run"} AS ord FROM {n}_m m LEFT JOIN {n}_q q ON q.doc_id = m.doc_id AND q.spot = m.spot) JOIN {n}_d USING (doc_id))"""


HITS = f"""{FLAT},{fixed_cte('fx', 'fixed', 448)},{fixed_cte('fn', 'fixed-no-overlap', 512)},
{SPANS},{structural("ch", "tblocks", 512)},{structural("pd", "tblocks", 128, 512)},
chunks AS (
  SELECT *, {n_toks('return_text')} AS tokens FROM (
    SELECT strategy, chunk_id, doc_id, text, text AS return_text, '' AS path FROM fx UNION ALL SELECT strategy, chunk_id, doc_id, text, text, '' FROM fn
    UNION ALL SELECT strategy, chunk_id, doc_id, text, return_text, path FROM ch UNION ALL SELECT strategy, chunk_id, doc_id, text, return_text, path FROM pd)),
{embedded("ce", "chunks", "strategy, chunk_id", "text")},
{embedded("qe", "(SELECT item_id AS qid, text FROM benchmark)", "qid", "text")},
cm AS (SELECT strategy, chunk_id, sum(n * n) AS m FROM ce GROUP BY ALL),
qm AS (SELECT qid, sum(n * n) AS m FROM qe GROUP BY ALL),
dots AS (SELECT strategy, chunk_id, qid, sum(ce.n * qe.n) AS p FROM ce JOIN qe USING (d) GROUP BY ALL),
scored AS (
  SELECT c.strategy, c.chunk_id, q.qid, coalesce(p / sqrt(qm.m * cm.m), 0.0) AS score
  FROM chunks c CROSS JOIN (SELECT item_id AS qid FROM benchmark) q LEFT JOIN dots USING (strategy, chunk_id, qid) LEFT JOIN cm USING (strategy, chunk_id) LEFT JOIN qm USING (qid)),
deep AS (
  SELECT s.*, c.doc_id, c.return_text, c.tokens, c.path FROM (
    SELECT *, (row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM scored QUALIFY rank < 200) s
  JOIN chunks c USING (strategy, chunk_id))"""

BUDGETED = """
once AS (SELECT * FROM deep QUALIFY row_number() OVER (PARTITION BY strategy, qid, return_text ORDER BY rank) = 1),
used AS (
  SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS pos FROM once
  WINDOW w AS (PARTITION BY strategy, qid ORDER BY rank ROWS UNBOUNDED PRECEDING)),
budgeted AS (SELECT strategy, qid, chunk_id, doc_id, score, rank, return_text, tokens FROM used WHERE pos = 1 OR used <= 4000 AND used - tokens < 4000)"""

RUNS = f"""{HITS},{BUDGETED},
asked AS (SELECT item_id AS qid, {words("text")} AS qw FROM benchmark),
pairs AS (SELECT strategy, qid, chunk_id, {bag("cw", "qw")} AS s FROM (
  SELECT h.strategy, h.qid, h.chunk_id, qw, {words("return_text")} AS cw FROM (SELECT * FROM deep WHERE rank < 50 UNION ALL SELECT * FROM deep SEMI JOIN budgeted USING (strategy, qid, chunk_id) WHERE rank >= 50) h JOIN asked USING (qid))),
wide AS (
  SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, s AS score, (row_number() OVER (PARTITION BY strategy, qid ORDER BY s DESC, rank) - 1)::INT AS rank
  FROM (SELECT * FROM deep WHERE rank < 50) JOIN pairs USING (strategy, qid, chunk_id) QUALIFY row_number() OVER (PARTITION BY strategy, qid ORDER BY s DESC, rank) <= 10),
reordered AS (
  SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, s AS score, (row_number() OVER (PARTITION BY strategy, qid ORDER BY s DESC, rank) - 1)::INT AS rank
  FROM budgeted JOIN pairs USING (strategy, qid, chunk_id)),
runs AS (
  SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, score, rank, 'k=10' AS scoring, 'none' AS reranker FROM deep WHERE rank < 10
  UNION ALL SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, score, rank, 'k=10', 'overlap' FROM wide
  UNION ALL SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, score, rank, '4000tok', 'none' FROM budgeted
  UNION ALL SELECT strategy, qid, chunk_id, doc_id, return_text, tokens, score, rank, '4000tok', 'overlap' FROM reordered)"""

GOLD = r"""
halves AS (SELECT item_id AS qid, string_split(trim(regexp_replace(replace(text, chr(10), ' '), '[ \t]+', ' ', 'g')), ' ') AS ws FROM benchmark),
gold AS (
  SELECT qid, 0 AS gold_ord, array_to_string(list_slice(ws, 1, len(ws) // 2), ' ') AS text FROM halves
  UNION ALL SELECT qid, 1, array_to_string(list_slice(ws, len(ws) // 2 + 1, len(ws)), ' ') FROM halves)"""

RESULTS = f"""{RUNS},{GOLD},
gw AS (SELECT qid, gold_ord, {words("text")} AS g FROM gold),
texts AS (SELECT qid, return_text, {words("return_text")} AS c FROM (SELECT DISTINCT qid, return_text FROM runs)),
met AS (SELECT qid, gold_ord, return_text FROM texts JOIN gw USING (qid) WHERE {covers("c", "g")} >= 0.5),
firsts AS (SELECT strategy, scoring, reranker, qid, gold_ord, min(rank) AS rank FROM runs JOIN met USING (qid, return_text) GROUP BY ALL),
ranks AS (SELECT strategy, scoring, reranker, qid, list(rank ORDER BY rank) AS relevant_ranks FROM firsts GROUP BY ALL),
got AS (SELECT strategy, scoring, reranker, qid, sum(n)::BIGINT AS retrieved, sum(tokens)::BIGINT AS tokens_returned FROM (
  SELECT strategy, scoring, reranker, qid, return_text, max(tokens) AS tokens, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL),
results AS (
  SELECT k.strategy, k.scoring, k.reranker, b.item_id AS qid, coalesce(relevant_ranks, []) AS relevant_ranks, coalesce(retrieved, 0) AS retrieved, coalesce(tokens_returned, 0) AS tokens_returned, 2::BIGINT AS gold_count
  FROM benchmark b CROSS JOIN (SELECT DISTINCT strategy, scoring, reranker FROM runs) k
  LEFT JOIN got ON got.qid = b.item_id AND got.strategy = k.strategy AND got.scoring = k.scoring AND got.reranker = k.reranker
  LEFT JOIN ranks ON ranks.qid = b.item_id AND ranks.strategy = k.strategy AND ranks.scoring = k.scoring AND ranks.reranker = k.reranker),
scores AS (
  SELECT *, least(1.0, len(list_filter(relevant_ranks, lambda r: r < 1)) / gold_count) AS recall_at_1,
    least(1.0, len(list_filter(relevant_ranks, lambda r: r < 5)) / gold_count) AS recall_at_5,
    least(1.0, len(list_filter(relevant_ranks, lambda r: r < 10)) / gold_count) AS recall_at_10,
    coalesce(list_sum(list_transform(list_filter(relevant_ranks, lambda r: r < 10), lambda r: 1 / log2(r + 2.0))), 0) / (1 + 1 / log2(3.0)) AS ndcg_at_10,
    coalesce(1.0::DOUBLE / (list_min(relevant_ranks) + 1), 0) AS rr
  FROM results)"""

HTML = rf"""
marked AS (
  SELECT page_id::VARCHAR AS doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
    '(?i)<(h1|h2|h3|h4|p|li|nav|footer)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:h1|h2|h3|h4|p|li|nav|footer)>', chr(1) || 'x' || chr(2), 'g'), chr(1)) AS ps FROM pages),
parts AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM marked),
tagged AS (
  SELECT doc_id, pos, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE 'x' END AS tag,
    CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END AS body FROM parts),
texts0 AS (SELECT doc_id, pos, tag, {clean("replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&amp;', '&')")} AS text FROM tagged),
blocks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS idx,
    CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' WHEN tag IN ('nav', 'footer') THEN 'footer' ELSE 'other' END AS type,
    text, NULL::INT AS page, CASE WHEN tag LIKE 'h%' THEN substr(tag, 2, 1)::INT END AS level
  FROM texts0 WHERE text <> '')"""
