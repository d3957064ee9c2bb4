"""What a task holds doesn't grow with the table; and results that only large tables bring up."""

import random
import re
import tracemalloc
from contextlib import contextmanager

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.tokenizers import _parts
from passagework.operators import blocks as B
from passagework.operators import chunks as C
from passagework.operators import layout as L
from passagework.operators import search as S
from passagework.plans import registry
from passagework.sources import files


@contextmanager
def conf(spark, **values):
    old = {k: spark.conf.get(k) for k in (x.replace("__", ".") for x in values)}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain_lines(rows):
    """The fold of a page, fragment by fragment."""
    held = []
    for _, _, size, left, bottom, right, top, text in sorted(rows, key=lambda r: (-r[6], r[3], r[1])):
        centre = (bottom + top) / 2
        if held and abs(centre - held[-1][1]) <= max(size, held[-1][0]) * 0.5:
            line = held[-1]
            line[3] += (" " if left - line[2] > size * 0.25 else "") + text
            line[0], line[2] = max(size, line[0]), max(right, line[2])
        else:
            held.append([size, centre, right, text])
    return [(i, size, centre, text) for i, (size, centre, _, text) in enumerate(held)]


def test_lines_hold_no_page(spark):
    rng, rows = random.Random(3), {}
    for page in range(1, 8):
        rows[page] = []
        for seq in range(60):
            size, left, bottom = rng.choice([8.0, 8.0, 12.0]), rng.choice([0.0, 30.0, 55.0, 90.0]), rng.randrange(0, 60, 3) * 1.0
            rows[page].append((page, seq, size, left, bottom, left + rng.choice([20.0, 30.0, 70.0]), bottom + size, f"w{seq}"))
    found = spark.createDataFrame([("d", *r) for p in rows.values() for r in p], "doc_id string, page int, seq int, size double, left double, bottom double, right double, top double, text string")
    out = L.lines(found)
    assert "collect_list" not in plan(out)
    for batch in ("7", "10000"):  # lines go on over batches
        with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=batch):
            got = sorted(map(tuple, L.lines(found).collect()))
        assert got == sorted(("d", p, *r) for p in rows for r in plain_lines(rows[p]))


def test_search_holds_few_scores(spark, tmp_path):
    rng = np.random.default_rng(1)
    many, vectors = rng.normal(size=(20_000, 16)), rng.normal(size=(4_000, 16))
    tracemalloc.start()
    best = S._Best(many, 5)
    for a in range(0, len(vectors), 2_000):
        best.add(np.arange(a, a + 2_000).astype(object), vectors[a : a + 2_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all scores of a block at once were 320 MB, three times over
    score = (many[:50] @ vectors.T) / np.sqrt((many[:50] ** 2).sum(1)[:, None] * (vectors**2).sum(1))
    got = {(i, n) for rows, names, _ in best.found() for i, n in zip(rows, names, strict=True) if i < 50}
    assert got == {(i, n) for i in range(50) for n in np.argsort(-score[i])[:5]}


def test_copies_of_vectors_tie(spark, tmp_path):
    """Copies under shifted keys, in blocks of any size, are in the order of their keys, as in SQL."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 19)).astype(np.float32).tolist()
    rows = [(i + 1000 * c, v) for c in range(7) for i, v in enumerate(base)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((q, v, r) for q, v, r, _ in con.execute("SELECT qid, vec_id, rank, score FROM (" + registry.ORACLES["v03_topk_embeddings"] + ")").fetchall())
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="37"):
        v = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
        for most in (S.QUERY_BYTES, 0):
            found = S.topk(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), v.select(F.col("vec_id").alias("qid"), "embedding"), by=(), most_bytes=most)
            assert sorted((r.qid, r.chunk_id, r["rank"]) for r in found.collect()) == want


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, -1e-7, 1e-7, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES["v01_normalise"](spark, str(tmp_path)).first().unit
    assert repr(got) == repr(con.execute(registry.ORACLES["v01_normalise"]).fetchall()[0][1]) == "[1.0, -0.0, 0.0, 0.0]"


def test_structural_chunks_hold_no_table(spark):
    """Documents come block by block, over batches of any size; their chunks are those of one document at a time."""
    rng, rows = random.Random(5), []
    for doc in range(9):
        for i in range(40):
            kind = rng.choice(["heading", "paragraph", "paragraph", "footer"])
            rows.append((doc, i, kind, " ".join(f"{doc}w{rng.randrange(9)}" for _ in range(rng.choice([1, 4, 30]))), i // 7, rng.randrange(1, 4) if kind == "heading" else None))
    schema = "doc_id long, idx int, type string, text string, page int, level int"
    for make in (lambda b: C.contextual_heading(b, 16), lambda b: C.parent_doc(b, 8, 24)):
        blocks = spark.createDataFrame(rows, schema).repartition(5)
        assert "collect_list" not in plan(make(blocks))
        with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
            got = sorted(map(str, make(blocks).collect()))
        alone = [str(r) for doc in (0, 4, 8) for r in make(spark.createDataFrame([x for x in rows if x[0] == doc], schema)).collect()]
        assert sorted(x for x in got if x.startswith(("Row(doc_id='0'", "Row(doc_id='4'", "Row(doc_id='8'"))) == sorted(alone)
        paths = {r.idx: r.heading_path for r in B.heading_paths(spark.createDataFrame([x for x in rows if x[0] == 4], schema)).collect()}
        assert all(C._paths([dict(zip(("type", "text", "page", "level"), x[2:], strict=True)) for x in rows if x[0] == 4])(i) == paths[i] for i in paths)


def test_a_section_is_read_once(monkeypatch):
    """The windows of a long section's children need its tokens once."""
    words = [f"w{i}" for i in range(3000)]
    whole, found = C.Section("  ".join(words)), []
    monkeypatch.setattr(C, "_TOKEN", type("Counted", (), {"findall": lambda self, x: found.append(len(x)) or re.findall(T.TOKEN, x)})())
    for a in range(0, 3000, 30):
        child = "  ".join(words[a : a + 30])
        begin = max(0, a - 35)
        assert whole.bounded(child, 100) == "  ".join(words[begin : begin + 100])
    assert sum(found) < 2 * len(whole.text)


def test_hits_bring_their_texts_without_a_shuffle_of_the_index(spark):
    hits = spark.createDataFrame([("s", "c1", 1, 0)], "strategy string, chunk_id string, qid int, rank int")
    chunks = spark.createDataFrame([("s", "c1", "text"), ("s", "c2", "other")], "strategy string, chunk_id string, return_text string")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        out = S.with_chunks(hits, chunks)
        assert [r.return_text for r in out.collect()] == ["text"]
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_embedder_takes_texts_not_words(spark):
    """Words go over as one text, and are counted as before; blank and null texts have zero vectors."""
    texts = ["One two, TWO-\nfold", "", None, "  ", "x_1 İstanbul"] * 300
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").coalesce(1)
    made = rows.select("i", T.words(F.col("t")).alias("w"), S.hash_embedder(8)(F.col("t")).alias("v"))
    assert "filter(" not in plan(rows.select(S.hash_embedder(8)(F.col("t"))))
    for r in made.collect():
        want = [0.0] * 8
        for w in r.w or ():
            want[S._dimension(w, 8)] += 1
        assert r.v == want


def test_fragments_go_out_in_parts(spark):
    """A file of many fragments isn't one batch; texts are cleaned as elsewhere, and a value that doesn't fit fails its file alone."""

    def parse(path, content):
        texts = ["a", "b  c", " d\t\te ", " \t", "f​g"] * (5_000 if "long" in path else 1)
        return 3, [{"page": "one" if "odd" in path else 1, "size": 2.04, "scale": -5.0, "left": 0.0, "bottom": 0.0, "right": 1.0, "top": 1.0, "text": t} for t in texts]

    found = spark.createDataFrame([("/f/long.pdf", b""), ("/f/odd.pdf", b""), ("/f/short.pdf", b"")], "path string, content binary").coalesce(1)
    out = files.decode_fragments(found, parse)
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")
    assert max(r.n for r in sizes.collect()) <= files.FRAGMENT_ROWS and "Arrow" in plan(out)
    assert out.where("doc_id = 'long'").count() == 20_000
    assert [(r.seq, r.size, r.text) for r in out.where("doc_id = 'short'").orderBy("seq").collect()] == [(0, 10.2, "a"), (1, 10.2, "b c"), (2, 10.2, "d e"), (4, 10.2, "f​g")]
    assert out.where("failure_reason is not null").first().doc_id == "odd"


def test_tokenizer_gives_results_in_parts(spark):
    seen = [len(x) for x in _parts(iter([pd.Series(["a"] * 1000), pd.Series([], dtype="object")]))]
    assert max(seen) <= 256 and sum(seen) == 1000
