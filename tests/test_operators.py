"""Reference operators on literal fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vectors as V
from passagework.operators import blocks as B
from passagework.operators import chunks as C
from passagework.operators import enrich as E
from passagework.operators import layout as L
from passagework.operators import metrics as M
from passagework.operators import questions as Q
from passagework.operators import reuse as R
from passagework.operators import search as S
from passagework.functions.tokenizers import BytePairs, Words, _encoding
from passagework.sources import files
from passagework.sources.corpora import Corpora
from passagework.streaming.ingest import ingest

BLOCK = "doc_id string, idx int, type string, text string, page int, level int"
GOLD = "Each tenant shall vacate the premises within sixty days of such notice."


def make_blocks(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, i, t, x, p, n) for i, (t, x, p, n) in enumerate(rows)], BLOCK)


def fragments(spark, *rows):
    schema = "doc_id string, page int, seq int, size double, left double, bottom double, right double, top double, text string"
    return spark.createDataFrame([("d", 1, i, float(s), float(a), float(b), float(a + 10 * len(t)), float(b + s), t) for i, (s, a, b, t) in enumerate(rows)], schema)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(16, 0, 700, "Bureau Technical Report 70012"), (16, 290, 700, "-"), (16, 300, 700, "55A")], ["Bureau Technical Report 70012-55A"]),
        ([(10, 0, 700, "Ada North"), (10, 200, 700, "Ben South")], ["Ada North Ben South"]),
        ([(10, 0, 700, "first line"), (10, 0, 600, "far below")], ["first line", "far below"]),
        ([(10, 0, 700, "The quick brown fox"), (10, 0, 688, "jumps over the lazy dog")], ["The quick brown fox jumps over the lazy dog"]),
        ([(16, 0, 700, "1. INTRODUCTION"), (10, 0, 685, "This document describes")], ["1. INTRODUCTION", "This document describes"]),
        ([(10, 0, 100, "last"), (10, 0, 700, "first"), (10, 0, 400, "middle")], ["first", "middle", "last"]),
        ([], []),
    ],
)
def test_layout(spark, rows, want):
    out = L.paragraphs(L.lines(fragments(spark, *rows))).orderBy("page", "seq")
    assert [r.text for r in out.collect()] == want


def test_heading_looks(spark):
    no = ["_" * 55, "-", "...", "A", "word " * 40, "see https://a.b/c for more", "mail@example"]
    yes = ["1. INTRODUCTION", "The Common Meaning of Large Clusters", "8. TERMINATION"]
    rows = spark.createDataFrame([(x,) for x in no + yes], "t string").select("t", T.looks_like_heading(F.col("t")).alias("h")).collect()
    assert {r.t for r in rows if r.h} == set(yes)


def test_sizes_and_types(spark):
    spans = spark.createDataFrame([("d", 1, 0, 20.0, "A Title Here"), ("d", 1, 1, 14.0, "Section one"), ("d", 1, 2, 10.0, "x" * 50), ("d", 1, 3, 20.0, "..."), ("e", 1, 0, 9.0, "ab"), ("e", 1, 1, 8.0, "cd")], "doc_id string, page int, seq int, size double, text string")
    assert {r.doc_id: r.body for r in L.body_size(spans).collect()} == {"d": 10.0, "e": 9.0}
    got = L.typed_blocks(spans).where("doc_id = 'd'").orderBy("idx").collect()
    assert [(r.type, r.level) for r in got] == [("heading", 1), ("heading", 2), ("paragraph", None), ("paragraph", None)]


def test_fallback_keeps_short_documents_flat(spark):
    found = make_blocks(spark, ("paragraph", "ab", 1, None))
    flat = make_blocks(spark, ("paragraph", "whole text", 1, None))
    plain = spark.createDataFrame([("d", 10)], "doc_id string, plain_chars long")
    assert [r.text for r in L.with_fallback(found, flat, plain).collect()] == ["whole text"]


def paths(spark, *rows):
    df = make_blocks(spark, *[(t, x, None, n) for t, x, n in rows])
    got = {r.idx: list(r.heading_path) for r in B.heading_paths(df).collect()}
    for i in got:  # the fold gives the same
        assert B.path_before([(n, x) for t, x, n in rows[:i] if t == "heading"]) == got[i]
    return got


def test_heading_paths(spark):
    got = paths(spark, ("heading", "Agreement", 1), ("heading", "Termination", 2), ("paragraph", "x", None), ("heading", "Payment", 2), ("paragraph", "y", None))
    assert got[4] == ["Agreement", "Payment"] and got[2] == got[3] == ["Agreement", "Termination"]
    assert paths(spark, ("heading", "A", 1), ("heading", "B", 2), ("heading", "C", 3), ("heading", "D", 3), ("paragraph", "p", None))[4] == ["A", "B", "D"]
    assert B.path_before([(None, "Outer"), (None, "Inner")]) == ["Outer", "Inner"]


def test_furniture(spark):
    rows = [("paragraph", f"Page {p} of 6", p, None) for p in range(1, 7)] + [("heading", "Only once", 2, 1), ("paragraph", "long " * 40, 1, None)]
    df = make_blocks(spark, *rows)
    out = B.mark_furniture(df, spark.createDataFrame([("d", 6)], "doc_id string, page_count int"))
    assert out.where("type = 'footer'").count() == 6
    assert B.mark_furniture(df, spark.createDataFrame([("d", 4)], "doc_id string, page_count int")).where("type = 'footer'").count() == 0


def test_flat_and_state(spark):
    pages = spark.createDataFrame([("a", 1, "one\n \n\ntwo\xa0 x "), ("b", 1, " \n"), ("c", 1, None)], "doc_id string, page int, text string")
    flat = B.flat_blocks(pages)
    assert [(r.doc_id, r.idx, r.text) for r in flat.orderBy("idx").collect()] == [("a", 0, "one"), ("a", 1, "two x")]
    assert {r.doc_id: r.parse_failed for r in B.parse_state(pages, flat).collect()} == {"a": False, "b": True, "c": True}
    assert B.document_text(flat).collect()[0].text == "one\n\ntwo x"


STRUCTURED = [
    ("heading", "Master Agreement", 1, 1), ("heading", "Termination", 1, 2), ("paragraph", "Either party may terminate. " * 8, 1, None),
    ("heading", "Payment", 2, 2), ("paragraph", "Invoices are net thirty. " * 8, 2, None),
]


def test_fixed_windows(spark):
    for n, want in ((0, 0), (1, 1), (512, 1), (513, 2), (960, 2), (961, 3)):
        df = make_blocks(spark, ("paragraph", " ".join("w" for _ in range(n)), None, None))
        assert C.fixed(df).count() == want, n
    flat = make_blocks(spark, *[("paragraph", f"Paragraph {i}. " * 20, None, None) for i in range(6)])
    plain, over = C.fixed(flat, 64, 0.0), C.fixed(flat, 64, 0.5)
    rows = plain.collect()
    assert over.count() > len(rows) > 1 and {r.strategy for r in rows} == {"fixed-no-overlap"}
    assert all(r.embed_text == r.raw_text == r.return_text for r in rows) and len({r.chunk_id for r in rows}) == len(rows)
    for bad in ((0, 0.1), (64, 1.0), (64, -0.1)):
        with pytest.raises(ValueError, match="chunk_tokens|overlap_ratio"):
            C.fixed(flat, *bad)


def test_structural_chunks(spark):
    df = make_blocks(spark, *STRUCTURED)
    ch = C.contextual_heading(df, 40).orderBy("ord").collect()
    assert ch[-1].heading_path == ["Master Agreement", "Payment"] and ch[-1].embed_text.startswith("Master Agreement > Payment\n\nInvoices")
    assert ch[-1].return_text == ch[-1].raw_text and not ch[0].degraded and (ch[-1].page_start, ch[-1].page_end) == (2, 2)
    pd = C.parent_doc(df, 16).collect()
    assert any(len(r.return_text) > len(r.embed_text) and r.embed_text == r.raw_text for r in pd)
    assert len({r.return_text for r in pd}) < len({r.embed_text for r in pd})
    flat = C.contextual_heading(make_blocks(spark, ("paragraph", "a b c", None, None)), 64).collect()
    assert flat[0].degraded and flat[0].degraded_reason and flat[0].embed_text == "a b c"
    assert C.fan_out(df.limit(0)).count() == 0


def test_bounded_parent_against_loop():
    words = [f"w{i}" for i in range(300)]
    section = " ".join(words)
    assert C.bounded(section, "w5 w6", 400) == section
    assert C.bounded(section, "absent", 50) == " ".join(words[:50])
    assert C.bounded(section, " ".join(words[100:110]), 50) == " ".join(words[80:130])
    assert E.window_around(section, " ".join(words[100:110]), 50) == " ".join(words[75:125])


def test_complete_chunks(spark):
    schema = "raw_text string, embed_text string, return_text string, degraded boolean, degraded_reason string"
    r = C.with_flags(C.complete(spark.createDataFrame([("hello", "", None, False, "")], schema))).collect()[0]
    assert r.embed_text == r.return_text == "hello" and not r.is_expanded and not r.is_enriched
    with pytest.raises(Exception, match="needs a reason"):
        C.complete(spark.createDataFrame([("hello", "", None, True, "")], schema)).collect()


def test_topk(spark):
    chunks = spark.createDataFrame([("s", "c0", [1.0, 0.0]), ("s", "c1", [0.0, 1.0]), ("s", "c2", [0.9, 0.1]), ("s", "c3", None), ("s", "c4", [0.0, 0.0])], "strategy string, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0])], "qid int, embedding array<float>")
    for most in (S.QUERY_BYTES, 0):  # in tasks and by a cross join
        got = S.topk(chunks, asked, 50, most_bytes=most).orderBy("rank").collect()
        assert [r.chunk_id for r in got] == ["c0", "c2", "c1", "c4"] and [r["rank"] for r in got] == [0, 1, 2, 3] and got[3].score == 0
    assert S.topk(chunks.limit(0), asked).count() == 0 == S.topk(chunks, asked.limit(0)).count()
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(V.normalise(F.col("v")).alias("v")).collect() == [([0.6, 0.8],), ([0.0, 0.0],)]


def budget(spark, sizes, b=1000, same=False):
    rows = [("s", 1, f"c{i}", 0 if same else i, i, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "strategy string, qid int, chunk_id string, return_text string, rank int, tokens int")
    return [r["rank"] for r in S.budgeted(df, b).orderBy("rank").collect()]


def test_budget(spark):
    assert budget(spark, [600, 500, 300]) == [0] and budget(spark, [1500, 10]) == [0] and budget(spark, [400, 600, 0]) == [0, 1]
    assert budget(spark, [400] * 20) == [0, 1] and budget(spark, [100] * 10, same=True) == [0]


def test_rerank(spark):
    hits = spark.createDataFrame([("s", 1, f"c{i}", i, 1.0) for i in range(5)], "strategy string, qid int, chunk_id string, rank int, score double")
    got = S.rerank(hits, F.col("rank").cast("double"), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"], r.score) for r in got] == [("c4", 0, 4.0), ("c3", 1, 3.0), ("c2", 2, 2.0)]
    assert [r.chunk_id for r in S.rerank(hits, F.lit(1.0), 2).orderBy("rank").collect()] == ["c0", "c1"]
    assert S.no_rerank(hits, 3).count() == 3 and S.rerank(hits.limit(0), F.lit(1.0)).count() == 0


def test_cost(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", None)], "strategy string, embed_text string")
    assert {r.strategy: (r.texts, r.tokens) for r in S.cost(df, "text-embedding-3-small").collect()} == {"a": (1, 3), "b": (1, 0), "TOTAL": (2, 3)}
    assert S.cost(df, "unknown").agg(F.sum("usd")).first()[0] == 0


@pytest.mark.parametrize(
    ("chunk", "gold", "low", "high"),
    [
        (GOLD, GOLD, 1, 1), ("pad " * 100 + GOLD + " pad" * 100, GOLD, 0.5, 1), ("Invoices are net thirty. " * 10, GOLD, 0, 0.49), ("Each tenant shall vacate", GOLD, 4 / 12, 4 / 12),
        (GOLD.upper().replace(" ", "  "), GOLD, 1, 1), (GOLD.replace("premises", "prem-\nises"), GOLD, 1, 1), ("", GOLD, 0, 0), (GOLD, "", 0, 0), (None, GOLD, 0, 0),
    ],
)
def test_coverage(spark, chunk, gold, low, high):
    df = spark.createDataFrame([(chunk, gold)], "c string, g string")
    jvm = T.coverage(T.words(F.coalesce("c", F.lit(""))), T.words(F.col("g")))
    a, b = df.select(M.coverage(F.col("c"), F.col("g")), jvm).first()
    assert low <= a <= high and a == pytest.approx(b)


def test_normalise(spark):
    rows = spark.createDataFrame([("Hello,  World!",), ("hello world",), ("“it’s”",), ("termina-\ntion",)], "t string").select(T.normalise(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["hello world", "hello world", "it s", "termination"]


def test_metrics(spark):
    schema = "strategy string, scoring string, reranker string, qid int, relevant_ranks array<int>, retrieved long, tokens_returned long, gold_count long"
    rows = [("s", "k", "n", 1, [0, 0], 2, 500, 2), ("s", "k", "n", 2, [1], 2, 100, 1), ("s", "k", "n", 3, [], 0, 0, 1), ("s", "k", "n", 4, [], 0, 0, 0)]
    got = {r.qid: r for r in M.per_query(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].ndcg_at_10 == pytest.approx(2 / (1 + 1 / math.log2(3))) and got[1].recall_at_1 == 1
    assert (got[2].rr, got[2].recall_at_1, got[2].recall_at_5) == (0.5, 0, 1) and got[3].rr == got[3].ndcg_at_10 == got[4].ndcg_at_10 == 0
    one = M.summary(spark.createDataFrame(rows, schema)).first()
    assert one.queries == 4 and one.median_tokens == 50 and one.ndcg_per_1k_tokens == pytest.approx(one.ndcg_at_10 / 0.05)


def test_query_results(spark):
    hits = spark.createDataFrame([("s", "k", "n", 1, "a", "unrelated words here", 0, 3), ("s", "k", "n", 1, "a", GOLD, 1, 11), ("s", "k", "n", 1, "b", GOLD, 2, 11)], "strategy string, scoring string, reranker string, qid int, doc_id string, return_text string, rank int, tokens long")
    gold = spark.createDataFrame([(1, 0, "", GOLD), (1, 1, "b", GOLD), (1, 2, "c", GOLD)], "qid int, gold_ord int, doc_id string, text string")
    r = M.query_results(hits, gold, gold.select("qid").distinct()).first()
    assert (r.relevant_ranks, r.retrieved, r.tokens_returned, r.gold_count) == ([1, 2], 3, 14, 3)


def test_questions(spark):
    rows = spark.createDataFrame([("T", ["Acme Corporation", "Inc", "Widget Company", "Third Company"]), ("", ["Acme Corporation"]), ("T", []), (None, [])], "t string, p array<string>")
    assert [r[0] for r in rows.select(Q.identity(F.col("t"), F.col("p"))).collect()] == ["T between Acme Corporation and Widget Company", "Acme Corporation", "T", ""]
    wide = spark.createDataFrame([(i, "" if i == 0 else "id", ["x" * 90], ["short"]) for i in range(30)], "doc_id int, identity string, a array<string>, b array<string>")
    got = Q.question_set(wide, {"a": "What?", "b": "Who?"}).collect()
    assert 14 <= len(got) <= 15 and {r.category for r in got} == {"a"}
    cells = spark.createDataFrame([("['a', 'b']",), ("plain",), (None,), ("[1, ",)], "c string").select(files.literal_list(F.col("c"))).collect()
    assert [r[0] for r in cells] == [["a", "b"], [], [], []]
    cells = spark.createDataFrame([("['Deed', 'x']", "['A B Company', ' ', 'MA', 'C D Limited']"), ("no list", None)], "t string, p string")
    assert [r[0] for r in cells.select(Q.identity_of_cells(F.col("t"), F.col("p"))).collect()] == ["Deed between A B Company and C D Limited", ""]


def test_enrich(spark):
    chunks = spark.createDataFrame([("d", "c1", "raw", "raw", "raw", "fixed"), ("d", "c2", "raw", "raw", "raw", "fixed")], "doc_id string, chunk_id string, raw_text string, embed_text string, return_text string, strategy string")
    docs = spark.createDataFrame([("d", "a raw text")], "doc_id string, text string")

    def client(window, chunk):
        if "text" not in window:
            raise OSError("no")
        return "About\nit"

    out = E.with_line(E.blurbs(chunks, docs, client)).collect()
    assert all(r.embed_text == "About it\n\nraw" and r.raw_text == r.return_text == "raw" and r.strategy == "contextual-llm" for r in out)
    same = E.with_line(E.blurbs(chunks, docs.limit(0), client)).collect()
    assert all(r.embed_text == "raw" and r.strategy == "fixed" for r in same)
    assert E.estimate(chunks, docs, 2).first().tokens_in == 6
    assert E.missing(chunks, chunks.where("chunk_id = 'c1'")).count() == 1


def test_spend_guard(tmp_path):
    g = R.SpendGuard(str(tmp_path / "l.json"), 1, 2)
    g.check(0.5)
    with pytest.raises(E.BudgetError, match="than a run may cost"):
        g.check(5)
    for _ in range(2):
        g.record(0.9, 100)
        g.commit()
    assert g.history()["runs"] == 2 and g.history()["total_usd"] == 1.8
    with pytest.raises(E.BudgetError, match="than is left"):
        g.check(0.9)
    g.record(0.6, 1)
    with pytest.raises(E.BudgetError, match="ends here"):
        g.record(0.6, 1)
    (tmp_path / "l.json").write_text("not json")
    with pytest.raises(E.BudgetError, match="unreadable"):
        g.check(0.1)


def test_store(spark, tmp_path):
    rows = R.with_hash(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), "text")
    store, seen = R.Store(spark, f"file://{tmp_path}"), []

    def compute(df):
        seen.append(df.count())
        return df.select("content_hash", F.length("text").alias("n"))

    key = R.hash_params(a=1, b=2)
    assert key == R.hash_params(b=2, a=1) != R.hash_params(a=1, b=3)
    assert store.hit_rate(rows, "s", key) == 0
    assert store.get_or_compute(rows, "s", key, compute).count() == 2 == store.get_or_compute(rows, "s", key, compute).count()
    assert seen == [2, 0] and store.hit_rate(rows, "s", key) == 1 and store.get("s", "other") is None


def test_store_drops_what_is_broken_and_goes_on_in_batches(spark, tmp_path):
    rows = R.with_hash(spark.createDataFrame([(f"text {i}",) for i in range(9)] + [("text 1",)], "text string"), "text")
    store, compute = R.Store(spark, f"file://{tmp_path}"), lambda df: df.select("content_hash", F.length("text").alias("n"))
    assert store.size_bytes() == 0 and store.next_batch(rows, "s", "p", compute, 0) == (9, 9)
    assert store.next_batch(rows, "s", "p", compute, 4) == (9, 5) and store.next_batch(rows, "s", "p", compute, 0) == (5, 5)
    assert store.next_batch(rows, "s", "p", compute, 50) == (5, 0) and store.get("s", "p").count() == 9 and store.size_bytes() > 0
    file = max(tmp_path.rglob("*.parquet"), key=lambda f: f.stat().st_mtime)
    held = file.read_bytes()
    file.write_bytes(held[: len(held) // 2])
    for crc in tmp_path.rglob(".*.crc"):
        crc.unlink()
    assert store.get("s", "p").count() < 9 and store.remove_corrupt("s", "p") <= 1 and not file.exists()
    assert store.get_or_compute(rows, "s", "p", compute).count() == 9 and R.Store(spark, f"file://{tmp_path}", enabled=False).get("s", "p") is None


def test_workers_and_progress(spark, monkeypatch):
    assert R.worker_count(6, 8, 8) == 1 and R.worker_count(1.5, 8, 64) == 7 and R.worker_count() >= 1
    monkeypatch.setenv("PASSAGEWORK_WORKERS", "3")
    assert R.worker_count(6, 8, 8) == 3
    assert R.progress_line(0, 10, 5) == "0 of 10 (0 %), time unknown" and R.progress_line(4, 10, 8) == "4 of 10 (40 %), 12 s left"
    assert R.running_tasks(spark) == (0, 0)


def test_corpora_by_name(spark):
    made = Corpora(spark)
    for name in ("a", "b"):
        made.add(name, f"place of {name}", lambda s, place: make_blocks(s, ("paragraph", place, 1, None)))
    assert {(r.corpus, r.text) for r in made.blocks().collect()} == {("a", "place of a"), ("b", "place of b")} and made.blocks("b").count() == 1
    with pytest.raises(ValueError, match="no corpus c; there are a, b"):
        made.blocks("c")
    with pytest.raises(ValueError, match="already"):
        made.add("a", "", None)


def test_byte_pairs_cut_as_the_library_does(spark):
    plug = BytePairs(spark)
    enc = _encoding(plug.sent.value, plug.pattern)
    texts = ["some words, here; 12 of them\n\n and more " * 9, "é👍", "", None, "   "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(plug.count(F.col("t")), plug.windows(F.col("t"), 10, 7), Words().windows(F.col("t"), 10, 7)).collect()
    for t, r in zip(texts, got, strict=True):
        ids = enc.encode_ordinary(t or "")
        want, at = [], 0
        while ids:
            want.append(enc.decode(ids[at : at + 10]).strip())
            at += 7
            if at >= len(ids) or at - 7 + 10 >= len(ids):
                break
        assert r[0] == len(ids) and r[1] == want
    assert got[0][2][0] == " ".join("some words, here; 12 of them and more some words,".split()).replace("them and", "them\n\n and") and got[2][2] is None
    blocks = make_blocks(spark, ("paragraph", texts[0], 1, None))
    assert C.fixed(blocks, 10, tokenizer=plug).count() == len(plug_windows(enc, texts[0].strip(), 10, 9))


def plug_windows(enc, text, size, stride):
    n = len(enc.encode_ordinary(text))
    return range(1 + max(0, -(-(n - size) // stride)))


def test_layout_model_blocks(spark):
    items = spark.createDataFrame([("d", 0, "Section_Header", 1, " Head ", [3, 4]), ("d", 1, "text", 0, None, [3]), ("d", 2, "odd", 0, "x" * 60, []), ("e", 0, None, 0, "y", None)], "doc_id string, n int, label string, depth int, text string, pages array<int>")
    blocks = L.model_blocks(items)
    got = [tuple(r) for r in blocks.orderBy("doc_id", "idx").collect()]
    assert got == [("d", 0, "heading", "Head", 3, 2), ("d", 1, "other", "x" * 60, None, None), ("e", 0, "other", "y", None, None)]
    plain = spark.createDataFrame([("d", 100), ("e", 1), ("f", 10)], "doc_id string, plain_chars long")
    state = {r.doc_id: (r.parse_failed, r.failure_reason) for r in L.model_state(blocks, plain).collect()}
    assert state == {"d": (True, "only 64 % of the text is in the layout's blocks (64 of 100 characters)"), "e": (False, ""), "f": (True, "the layout has no text")}


def test_vectors_and_chunks_must_match(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, has_vector int")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    assert {(r.chunk_id, r.has_vector, r.embedding[0]) for r in S.aligned(chunks, vectors).collect()} == {("a", 1, 1.0), ("b", 2, 2.0)}
    for x, y, message in ((chunks, vectors.limit(1), "chunk without a vector"), (chunks.limit(1), vectors, "vector without a chunk")):
        with pytest.raises(Exception, match=message):
            S.aligned(x, y).collect()


def test_fragments_of_files(spark):
    def parser(path, content):
        part = {"page": 1, "size": 1.0, "scale": -12.04, "left": 0.0, "bottom": 0.0, "right": 9.0, "top": 12.0}
        return 2, [part | {"text": t} for t in content.decode().split("|")]

    rows = spark.createDataFrame([("/x/a.pdf", b"one| |  two  words"), ("/x/b.pdf", b" "), ("/x/c.pdf", b"\xff")], "path string, content binary")
    got = [(r.doc_id, r.seq, r.size, r.text, r.failure_reason and r.failure_reason[:12]) for r in files.decode_fragments(rows, parser).orderBy("doc_id", "seq").collect()]
    assert got == [("a", 0, 12.0, "one", None), ("a", 2, 12.0, "two words", None), ("b", None, None, None, "no extractab"), ("c", None, None, None, "UnicodeDecod")]


def test_files(spark, tmp_path):
    for name, data in (("b.PDF", b"%PDF-x"), ("a.pdf", b"bad"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)

    def parser(path, content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("broken")
        return 1, [{"type": "paragraph", "text": "hello", "page": 1}]

    found = files.scan_binary(spark, f"file://{tmp_path}")
    got = {r.doc_id: (r.text, r.failure_reason) for r in files.decode(found, parser).collect()}
    assert got == {"b": ("hello", None), "a": (None, "ValueError: broken")}
    assert [r.path[-5:] for r in files.scan_binary(spark, f"file://{tmp_path}", limit=1).collect()] == ["a.pdf"]
    assert found.where(files.has_magic(F.col("content"))).count() == 1


def test_client_batches(spark):
    rows = spark.createDataFrame([(i, " " if i == 3 else f"t{i}") for i in range(10)], "i int, embed_text string").coalesce(1)
    out = S.embed_in_batches(rows, lambda texts: [[float(len(texts)), float(t == " ")] for t in texts], batch=4).orderBy("i").collect()
    assert [r.embedding[0] for r in out] == [4.0] * 8 + [2.0] * 2 and out[3].embedding[1] == 1


def test_chunker_plug_ins(spark):
    blocks = make_blocks(spark, ("heading", "Head", 1, 1), ("paragraph", "one two three four", 1, None))
    out = C.fan_out(blocks, {"short": lambda b: C.fixed(b, 2, 0.0), "whole": C.contextual_heading})
    assert sorted((r.strategy, r.raw_text) for r in out.collect()) == [("short", "Head\n\none"), ("short", "four"), ("short", "two three"), ("whole", "Head\n\none two three four")]
    failed = make_blocks(spark, ("paragraph", "x", 1, None)).limit(0)
    assert C.fan_out(failed).count() == 0


def test_model_embedder(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "", None, "abc"])], "i int, t string").coalesce(1)
    embed = S.model_embedder(lambda: lambda texts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts]), batch=3)
    got = [np.round(r[0], 6).tolist() for r in rows.orderBy("i").select(embed(F.col("t"))).collect()]
    assert got == [[0.6, 0.8], [0, 0], [0, 0], [0.6, 0.8]] or np.allclose(got, [[0.6, 0.8], [0, 0], [0, 0], [0.6, 0.8]])


def test_stream_takes_new_files_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for n in range(2):
        spark.createDataFrame([(n, "x")], "i int, t string").write.mode("append").parquet(src)
        ingest(spark, src, "i int, t string", out, ck, lambda df: df.withColumn("n", F.length("t"))).awaitTermination()
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == [0, 1]


def test_json_reader(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"q": "a"}, {"q": "b"}]))
    assert files.read_json(spark, f"file://{tmp_path}/q.json", "q string").count() == 2
