"""Training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import base64
import itertools
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import bond, bpe, common, entry, jpeg, langid, licenses, media, packing, quality_mil, simhash, suffix_index, zip_warc
from passagework.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).coalesce(1)


# ---- 1 quality classifier


def test_mil_learns_and_handles_odd_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality_mil.train(docs, even)
    rows = quality_mil.score(docs, model).join(odd, "doc_id").where("score is not null").collect()
    right = {q: [r.keep == bool(q) for r in rows if r.quality == q] for q in (0, 1)}
    assert np.mean(right[1]) > 0.95 and np.mean(right[0]) > 0.7, {q: np.mean(x) for q, x in right.items()}
    odd_rows = docs_of(spark, None, "", " \n", "word", "word", "long text " * 30000)
    got = {r.doc_id: r for r in quality_mil.score(odd_rows, model).collect()}
    assert [got[i].score is None and not got[i].keep for i in range(3)] == [True] * 3
    assert got[3].score == got[4].score and got[5].passages == -(-300000 // quality_mil.PASSAGE)
    assert quality_mil.score(odd_rows.limit(0), model).count() == 0
    nothing = quality_mil.train(docs, labels.limit(0))
    assert quality_mil.keep_good(odd_rows, nothing).count() == 3
    wide = odd_rows.withColumn("score", F.lit(1)).withColumn("keep", F.lit(None).cast("string"))
    assert quality_mil.keep_good(wide, nothing).columns == wide.columns


def test_mil_passages_cover_texts():
    starts, ends, row = quality_mil.cut_passages(np.array([0, 0, 5, 5 + 2500]))
    assert row.tolist() == [1, 2, 2, 2] and (ends - starts).tolist() == [5, 1024, 1024, 452]


def test_mil_forward_and_gradient_equal_plain_loops():
    rng = np.random.default_rng(9)
    w = {k: rng.normal(size=v) * 0.5 for k, v in (("E", (7, 4)), ("be", 4), ("V", (4, 3)), ("U", (4, 3)), ("w", 3), ("c", 4), ("b", 1))}
    counts = np.array([1, 3, 2])
    x, y, weight, at = rng.normal(size=(6, 7)), np.array([1.0, 0.0, 1.0]), np.array([0.3, 0.5, 0.2]), np.array([0, 1, 4])

    def forward(w):
        scores, attention = [], []
        for begin, n in zip(at, counts, strict=True):
            hs = [np.tanh(x[i] @ w["E"] + w["be"]) for i in range(begin, begin + n)]
            e = [sum(w["w"][g] * np.tanh(h @ w["V"][:, g]) / (1 + np.exp(-(h @ w["U"][:, g]))) for g in range(3)) for h in hs]
            a = [np.exp(v) / sum(map(np.exp, e)) for v in e]
            attention += a
            scores.append(1 / (1 + np.exp(-(sum(p * h for p, h in zip(a, hs, strict=True)) @ w["c"] + w["b"][0]))))
        return np.array(scores), np.array(attention)

    def loss(w):
        p = forward(w)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    got, z = quality_mil.attend(w, np.tanh(x @ w["E"] + w["be"]), at, counts)[:2]
    assert np.allclose(got, forward(w)[1]) and np.allclose(1 / (1 + np.exp(-(z @ w["c"] + w["b"][0]))), forward(w)[0])
    g = quality_mil.gradient(w, x, at, counts, y, weight)
    for k in w:
        for spot in np.ndindex(w[k].shape):
            up, down = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
            up[k][spot] += 1e-5
            down[k][spot] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[k][spot]) < 1e-7, (k, spot)


# ---- 2 packing


def naive_place(demand, limits):
    left, out, number = list(range(len(demand))), {}, 0
    while left:
        room, nth = list(limits), 0
        while True:
            fits = [i for i in left if all(d <= r for d, r in zip(demand[i], room, strict=True))]
            if not fits:
                break
            pick = max(fits, key=lambda i: (round(sum(d / m * r / m for d, r, m in zip(demand[i], room, limits, strict=True)), 12), -i))
            out[pick] = number, nth
            room = [r - d for r, d in zip(room, demand[pick], strict=True)]
            left.remove(pick)
            nth += 1
        number += 1
    return out


def test_packing_against_loop():
    rng = random.Random(1)
    for n in (0, 1, 40):
        demand = [(rng.randint(0, 8), rng.randint(1, 3), rng.randint(0, 4)) for _ in range(n)]
        pack, position = packing.place(np.array(demand, np.int64).reshape(-1, 3), np.array([16, 6, 8]))
        assert {i: (pack[i], position[i]) for i in range(n)} == naive_place(demand, [16, 6, 8])


def test_packing_rows(spark):
    rows = spark.createDataFrame([(1, 5000, 3, 10), (2, 0, 1, 0), (2, 7, 1, 7), (None, 5, 1, 1), (3, None, 1, None)], "example_id long, tokens long, segments long, loss_tokens long")
    got = packing.pack(rows).collect()
    assert sorted({r.example_id for r in got}) == [1, 2, 3] and sum(r.tokens for r in got if r.example_id == 1) == 5000
    used = {}
    for r in got:
        used.setdefault(r.pack_id, []).append((r.tokens, r.segments, r.loss_tokens))
    assert all(sum(x) <= m for p in used.values() for x, m in zip(zip(*p, strict=True), packing.LIMITS.values(), strict=True))
    assert packing.pack(rows.limit(0)).count() == 0
    turns = table(spark, SF, "conversations")
    out = entry.op2_vector_packing(spark, SF).groupBy("conv_id").agg(F.sum("segments").alias("n"))
    assert out.exceptAll(turns.groupBy("conv_id").agg(F.count("*").alias("n"))).count() == 0


def test_long_examples_are_cut_along_their_turns(spark):
    limits = list(packing.LIMITS.values())
    assert packing.cut([(4000, 0), (4000, 4000)], limits) == [(4096, 2, 96), (3072, 1, 3072), (832, 1, 832)]
    assert packing.cut([(1, 0)] * 40, limits) == [(32, 32, 0), (8, 8, 0)]
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "assistant"]), "word " * rng.choice([0, 3, 900, 3500, 9000])) for c in range(12) for t in range(rng.choice([1, 3, 40]))]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    enc = packing.encoder(packing.vocabulary())
    flags = {c: [] for c in range(12)}  # a (turn, bears loss) for each token
    for c, t, role, text in sorted(turns, key=lambda x: x[:2]):
        flags[c] += [(t, role == "assistant")] * len(enc.encode_ordinary(text))
    got = packing.pack(packing.conversations_demand(df)).orderBy("example_id", "piece").collect()
    ends, used = dict.fromkeys(flags, 0), {}
    for r in got:
        own = flags[r.example_id][r.start_token : r.end_token]
        assert r.start_token == ends[r.example_id] and len(own) == r.tokens and sum(f for _, f in own) == r.loss_tokens
        assert max(1, len({t for t, _ in own})) <= r.segments
        ends[r.example_id] = r.end_token
        used.setdefault(r.pack_id, []).append((r.tokens, r.segments, r.loss_tokens))
    assert all(ends[c] == len(flags[c]) for c in flags) and any(r.piece > 1 for r in got)
    assert all(sum(x) <= m for p in used.values() for x, m in zip(zip(*p, strict=True), limits, strict=True))
    long = packing.pack(packing.documents_demand(docs_of(spark, "word " * 9000))).collect()
    assert len(long) > 2 and all(r.segments == 1 for r in long)


# ---- 3 byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read()


def test_perfect_hash_is_minimal():
    keys = np.unique(common.mix64(np.arange(20_000, dtype=np.uint64)))
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert len(bpe.PerfectHash(keys[:0]).slots(keys)) == len(keys)


def test_bpe_equals_library(spark, vocabulary):
    import regex
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + ["", "a" * 5000, "\x1c a \x85  b\xa0", " \n\n x", "'s 'll don't", "👍🏽é́", "ab" * 3000, "<|endoftext|>"]
    ids, off = bpe.encode_texts(vocabulary, regex.compile(bpe.PATTERN).findall, texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == library.encode_ordinary(t)
    long = "word  other\n " * 1000
    assert "".join(bpe.parts(long, 100)) == long and len(list(bpe.parts(long, 100))) > 50
    a, _ = bpe.encode_texts(vocabulary, lambda t: regex.findall(bpe.PATTERN, t), list(bpe.parts(long, 100)))
    assert a.tolist() == library.encode_ordinary(long)


def test_bpe_round_trip(spark, vocabulary):
    df = docs_of(spark, "some text", None, "", "é👍 x\r\n", "some text").withColumn("ids", F.lit(1)).select("doc_id", "text", "ids")
    out = bpe.encode(df, vocabulary)
    assert out.columns == ["doc_id", "ids", "_ids", "exact"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1]._ids is None and rows[1].exact is None and rows[2]._ids == [] and all(rows[i].exact for i in (0, 2, 3, 4))
    back = bpe.decode(out.drop("ids"), vocabulary, "_ids").orderBy("doc_id").collect()
    assert [r.text for r in back] == ["some text", None, "", "é👍 x\r\n", "some text"]
    odd = spark.createDataFrame([([1, None],), ([10**6],), ([-1],), (None,)], "ids array<int>")
    assert [r.text for r in bpe.decode(odd, vocabulary).collect()] == [None] * 4
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    assert entry.op3_byte_bpe(spark, SF).where("not exact").count() == 0


# ---- 4 language id


def test_language_accuracy_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").where("language is not null").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.9
    odd = docs_of(spark, None, "", "\t", "the of and " * 9, "the of and " * 9)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].language for i in range(3)] == [None] * 3 and got[3].language == got[4].language == "en"
    assert langid.keep_identified(odd, langid.train(docs.limit(0))).count() == 2 and langid.identify(odd.limit(0), model).count() == 0


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    model = langid.fit(windows, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"], epochs=1)
    pooled = model.pooled(windows)
    for n, window in enumerate(windows):
        emb = [model.w["emb"][b] for b in window]
        for k, width in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                own = model.w[f"f{width}"][: width * langid.DEPTH, f]
                best = max(sum(float(emb[p + j] @ own[j * langid.DEPTH : (j + 1) * langid.DEPTH]) for j in range(width)) for p in range(langid.PLACES))
                assert abs(max(0, best + model.w["bias"][k * langid.FILTERS + f]) - pooled[n, k * langid.FILTERS + f]) < 1e-4


def test_mislabelled_texts_go_and_others_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.where("doc_id % 2 = 1 and length(text) > 300 and lang is not null").limit(60).collect()]
    wrong = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    junk = "<div> $$ 12 :: http www >> " * 4
    cases = [(d, t, x) for d, t, x in rows] + [(d + 10**6, t, wrong.get(x, "en")) for d, t, x in rows] + [(d + 2 * 10**6, (t + " ") * (3000 // len(t) + 1) + junk, wrong.get(x, "en")) for d, t, x in rows]
    df = spark.createDataFrame(cases, "doc_id long, text string, lang string")
    kept = [r.doc_id for r in langid.keep_identified(df, model).select("doc_id").collect()]
    share = [sum(d // 10**6 == k for d in kept) / len(rows) for k in range(3)]
    assert share[0] >= 0.97 and share[1] <= 0.1 and share[2] <= 0.1, share
    bare = df.drop("lang").withColumn("language", F.lit(1))
    assert langid.keep_identified(bare, model).count() >= 0.97 * 3 * len(rows) and langid.train(bare).languages == []


# ---- 5 SimHash


@pytest.mark.parametrize("parts", [4, 3, 2])
def test_covering_masks(parts):
    masks = [(a & (1 << 64) - 1) | (b & (1 << 64) - 1) << 64 for a, b in simhash.masks(parts=parts)]
    assert len(masks) == {4: 124, 3: 317, 2: 2046}[parts]
    rng = random.Random(2)
    for _ in range(1000):
        diff = sum(1 << p for p in rng.sample(range(128), simhash.RADIUS))
        assert any(not diff & m for m in masks)


def test_keys_grow_with_the_number_of_nodes():
    assert [simhash.best_parts(n) for n in (0, 10**6, 10**8, 10**10)] == [4, 4, 3, 2]


def test_simhash_fingerprints_and_groups(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300)]
    near = " ".join(base[:5] + ["changed"] + base[6:])
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300))
    texts = [" ".join(base), near, other, None, "", "...", " ".join(base).upper(), *[near + f" tail{i}" for i in range(30)]]
    df = docs_of(spark, *texts).union(docs_of(spark, " ".join(base)))
    got = {r.doc_id: (r.group_id, r.keep) for r in simhash.mark(df).collect()}
    assert got[0] == (0, True) and got[1] == (0, False) and got[6] == (0, False) and all(got[i][0] == 0 for i in range(7, 37))
    assert all(got[i] == (i, True) for i in (2, 3, 4, 5))
    assert simhash.keep_one(df).where("doc_id = 0").count() == 2 and simhash.mark(df.limit(0)).count() == 0


def test_simhash_groups_lie_between_brute_force_closures(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id is not null")
    prints = {r.doc_id: r.a & (1 << 64) - 1 | (r.b & (1 << 64) - 1) << 64 for r in simhash.fingerprint(docs).collect()}

    def joined(most):
        root = {d: d for d in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, apart in pairs:
            if apart <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        return {d: find(d) for d in prints}

    pairs = [(a, b, (prints[a] ^ prints[b]).bit_count()) for a, b in itertools.combinations(sorted(prints), 2)]
    within, beyond = joined(simhash.RADIUS), joined(simhash.ACCEPT)
    for parts in (4, 3):
        monkeypatch.setattr(simhash, "best_parts", lambda n, radius, parts=parts: parts)
        got = {r.doc_id: r.group_id for r in simhash.mark(docs).collect()}
        assert all(got[d] == got[within[d]] for d in prints)  # every pair within the radius is together
        assert all(beyond[got[d]] == beyond[d] for d in prints)  # none is together but by a chain of accepted pairs
        assert len(set(within.values())) < len(prints)


def test_texts_that_differ_in_short_words_stay_apart(spark):
    texts = ["report " + " ".join(map(str, range(a, a + 80))) for a in (101, 301, 901)]
    texts += ["final score of the league: " + " ".join(f"{x}:{x * y % 7}" for x in range(1, 60)) for y in (2, 3)]
    texts += [texts[0], texts[0].replace(" 150 ", " 15 ").upper()]
    df = docs_of(spark, *texts)
    got = {r.doc_id: r.group_id for r in simhash.mark(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0, 6: 0}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1, 2, 3, 4]


# ---- 6 licenses


def test_license_alignment_and_scan(spark):
    full = licenses.TEMPLATES["MIT"]
    a, b = licenses.tokens("start " + full + " end"), licenses.tokens(full)
    pairs = licenses.align(a, b)
    assert [p for _, p in pairs] == list(range(len(b))) and all(a[i] == b[j] for i, j in pairs)
    changed = full.replace("free of charge", "at no cost").replace("sublicense", "relicense")
    docs = docs_of(spark, "x " * 5000 + changed + " y" * 5000 + " " + full, None, "", "nothing of this kind", "All rights reserved.", "All rights reserved.")
    got = licenses.scan(docs).collect()
    mit = sorted((r.first_word, round(r.coverage, 2)) for r in got if r.license == "MIT")
    assert len(mit) == 2 and mit[0][1] < 1 == mit[1][1] and {r.doc_id for r in got if r.license == "all-rights-reserved"} == {4, 5}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_equals_unfiltered(spark):
    docs = table(spark, SF, "documents")
    words = {n: w for n, w in ((n, licenses.tokens(t)) for n, t in licenses.TEMPLATES.items()) if len(w) < 82}
    every = {n: set(w) for n, w in words.items()}  # each word of a template sets windows
    got = {}
    for r in licenses.scan(docs, {n: licenses.TEMPLATES[n] for n in words}).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.matched))
    for r in docs.collect():
        want = {(f[0], f[2]) for f in licenses.scan_text(r.text or "", words, every)}
        assert got.get(r.doc_id, set()) == want


def plain_align(a, b):
    """Patience alignment word by word, by recursion and a quadratic search for the longest increasing chain."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return [*plain_align(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    better = lambda c: (len(c), -c[-1][1])  # noqa: E731 - of equally long chains the one that ends first in the template
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    chains = []
    for n, (_, j) in enumerate(pairs):
        chains.append(max([c for c in chains if c[-1][1] < j], key=better, default=[]) + [pairs[n]])
    if not chains:
        return []
    chain = max(chains, key=better)
    out, ends = [], [(-1, -1), *chain, (len(a), len(b))]
    for (i, j), (k, m) in itertools.pairwise(ends):
        out += [(i + 1 + p, j + 1 + q) for p, q in plain_align(a[i + 1 : k], b[j + 1 : m])] + ([(k, m)] if k < len(a) or m < len(b) else [])
    return out


def test_alignment_against_plain_recursion():
    rng = random.Random(4)
    for size in (3, 8, 30):
        for _ in range(150):
            a, b = ([rng.choice("abcdefghijklmnopqrstuvwxyz"[:size]) for _ in range(rng.randint(0, 14))] for _ in range(2))
            assert licenses.align(a, b) == plain_align(a, b)


# ---- 7 suffix arrays


def naive_repeats(rows, least):
    seen, out = {}, []
    for doc, text in rows:
        ws, hit = text.split(), []
        for p in range(len(ws) - least + 1):
            gram = " ".join(ws[p : p + least])
            if gram in seen:
                hit.append(p)
            seen.setdefault(gram, (doc, p))
        for p in hit:
            if out and out[-1][0] == doc and p <= out[-1][2]:
                out[-1][2] = p + least
            else:
                out.append([doc, p, p + least])
    return {tuple(x) for x in out}


def test_repeats_against_loop(spark):
    rng = random.Random(5)
    passages = [" ".join(rng.choices("abcdefghij", k=14)) for _ in range(4)]
    texts = [" ".join(rng.choice([rng.choice(passages), " ".join(rng.choices("klmnop", k=5))]) for _ in range(8)) for _ in range(30)]
    texts += ["", "short", "a a a a a a a a a a a a a a a a a a a a a a", "\n ".join(texts[0].split())]
    df = docs_of(spark, *texts)
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_index.repeats(df, 10).collect()}
    assert got == naive_repeats(list(enumerate(texts)), 10) and got
    cut = suffix_index.cut_repeats(df.union(spark.createDataFrame([(None, texts[0], "en", "s", 1), (99, None, "en", "s", 1)], DOCS)), 10)
    assert cut.columns == df.columns and cut.where("doc_id is null").count() == 1 and cut.where("doc_id = 99").count() == 1
    assert cut.where("n_chars <> length(text) and doc_id is not null").count() == 0
    assert suffix_index.repeats(df.limit(0)).count() == 0


def test_twin_rows_are_no_repeats_wherever_a_batch_ends(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(6)]
    texts[4] = texts[1][:40] + texts[4]  # 20 words
    want = naive_repeats(list(enumerate(texts)), 10)
    df = docs_of(spark, *texts)
    df = df.union(df).repartition(2)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for windows, rows in ((suffix_index.SLICE, 10_000), (3, 10_000), (suffix_index.SLICE, 1), (1, 1)):
        monkeypatch.setattr(suffix_index, "SLICE", windows)
        spark.conf.set(size, rows)
        try:
            got = [(r.doc_id, r.start_word, r.end_word) for r in suffix_index.repeats(df, 10).collect()]
            kept = {(r.doc_id, r.text) for r in suffix_index.cut_repeats(df, 10).collect()}
        finally:
            spark.conf.unset(size)
        assert sorted(got) == sorted(want) and len(want) == 1, (windows, rows)
        assert {x for x in kept if x[0] != 4} == {(i, t) for i, t in enumerate(texts) if i != 4}
    family = suffix_index.IndexFamily(2)
    window = np.array([1, 2], np.uint32)
    assert [family.add(window, np.array([0]), np.array([i])).tolist() for i in (5, 5, 6, 5)] == [[False], [False], [True], [False]]


def test_levels_are_suffix_arrays_and_grow_geometrically():
    family, seen, rng = suffix_index.IndexFamily(5), {}, np.random.default_rng(1)
    for n in range(40):
        sizes = rng.integers(5, 40, 6)
        starts = np.cumsum(sizes) - sizes
        text = rng.integers(0, 4, sizes.sum()).astype(np.uint32)
        text[starts[0] : starts[0] + 5] = text[starts[1] : starts[1] + 5]
        owners = np.arange(6) + 6 * n << 32
        want = []
        for a, size, owner in zip(starts, sizes, owners, strict=True):
            for i in range(size - 4):
                want.append(seen.setdefault(text[a + i : a + i + 5].tobytes(), owner + i) != owner + i)
        assert family.add(text, starts, owners).tolist() == want
        assert all(len(a) >= 2 * len(b) for a, b in itertools.pairwise(family.levels))
    assert sum(map(len, family.levels)) == len(seen)
    for level in family.levels:
        spelt = [level.text[i : i + 5].tolist() for i in level.order]
        assert level.order.dtype == np.int32 and all(a < b for a, b in itertools.pairwise(spelt))
        for x, owner in zip(spelt, level.owner(level.order), strict=True):
            assert seen[np.array(x, np.uint32).tobytes()] == owner
    big = suffix_index.IndexFamily(50)
    big.add(np.arange(20_000, dtype=np.uint32), np.array([0]), np.array([0]))
    (level,) = big.levels
    assert level.text.nbytes + level.order.nbytes + level.starts.nbytes + level.owners.nbytes <= 12 * 20_000


def test_keys_spread_over_shards_give_the_same(spark):
    rng = random.Random(11)
    hot = " ".join(rng.choices("abcdefghijklmnop", k=25))
    texts = [" ".join([*rng.choices("qrstuvwxyz", k=rng.randint(0, 9)), hot, *rng.choices("qrstuvwxyz", k=rng.randint(0, 9))]) for _ in range(40)]
    texts += [" ".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(5)] + [hot + " " + hot]
    df = docs_of(spark, *texts)
    df = df.union(df.where("doc_id < 3")).repartition(3)
    got = [(r.doc_id, r.start_word, r.end_word) for r in suffix_index.repeats(df, 10, hot=5, sample=1).collect()]
    assert suffix_index._hot(df.select("doc_id", "text"), 10, 5, 1).count() > 0
    assert sorted(got) == sorted(naive_repeats(list(enumerate(texts)), 10)) and got


def test_cut_texts_equal_a_plain_cut(spark):
    rng = random.Random(12)
    passages = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(3)]
    texts = ["  ".join(rng.choice([rng.choice(passages), "é" + " ".join(rng.choices("klmnop", k=4))]) for _ in range(7)) + "\n" for _ in range(25)]
    texts += [passages[0], "", "  "]
    want = {}
    spans = naive_repeats(list(enumerate(texts)), 10)
    for i, text in enumerate(texts):
        left, at, pieces = 0, [m.span() for m in re.finditer(r"[^ \t\n\f\r]+", text)], []
        own = sorted((a, b) for d, a, b in spans if d == i)
        for a, b in own:
            pieces.append(text[left : at[a][0]])
            left = at[b - 1][1]
        done = "".join(pieces) + text[left:]
        if not own or done.strip():
            want[i] = done
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_index.cut_repeats(docs_of(spark, *texts), 10).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and len(got) < len(texts)


# ---- 8 ZIP and WARC


def test_zip_is_a_zip(tmp_path):
    for zip64 in (False, True):
        path = str(tmp_path / f"{zip64}.zip")
        box = zip_warc.Zip(zip_warc.create_file(path), zip64)
        for name, data in (("a", b"x" * 10), ("archive/é", b"")):
            box.begin(name)
            box.add(data)
            box.end()
        box.close()
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.read("a") == b"x" * 10
        with zip_warc.open_file(path) as f:
            members = zip_warc.zip_members(f)
            assert [(m[0], m[1], m[3]) for m in members] == [("a", True, 10), ("archive/é", True, 0)] and f.read_at(10, members[0][2]) == b"x" * 10


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, ""), (3, "http://a/3", None), (3, "http://a/3", "again"), (None, "u", "x" * 3_000_000), (4, "http://a/{x} {", "y"), (5, " http://a\r\nX: 1\t%0a", "z"), (6, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("package", F.lit("clash"))
    packages = zip_warc.write_packages(pages)
    got = zip_warc.records(packages).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.key and int(r.key), r.url, r.body) for r in got), key=key) == sorted(rows, key=key)
    assert all(r.status == 200 and r.digest_ok and r.error is None for r in got)
    assert zip_warc.records(zip_warc.write_packages(pages.limit(0))).count() == 0


def test_warc_without_index_and_broken(spark, tmp_path):
    records = [zip_warc.record_bytes(f"u{i}", i, f"body {i}") for i in range(5)]
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(records))
        z.writestr("archive/b.warc", b"".join(map(zip_warc.plain, records)))
        z.writestr("archive/packed.warc", b"".join(map(zip_warc.plain, records)), zipfile.ZIP_DEFLATED)
        z.writestr("indexes/i.cdxj", "no json here\n")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    (tmp_path / "empty.zip").write_bytes(b"")
    names = spark.createDataFrame([(str(tmp_path / n),) for n in ("plain.zip", "bad.zip", "empty.zip", "absent.zip")] + [(None,)], "package string")
    listed = zip_warc.directory(names).collect()
    assert sum(r.error is not None for r in listed) == 3 and [r.stored for r in listed if r.member == "archive/packed.warc"] == [False]
    got = zip_warc.records(names).collect()
    assert sorted(int(r.key) for r in got) == sorted([*range(5)] * 2) and all(r.body == f"body {r.key}" for r in got)
    assert zip_warc.parse_record(b"junk")["error"] and zip_warc.parse_record(zip_warc.plain(records[0])[:-30])["error"]


def test_warc_keys_corrupt_members_and_thin_indexes(spark, tmp_path):
    pages = spark.createDataFrame([("k 1", "u", "b"), ("\n", "v", "c")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.url, r.html) for r in zip_warc.read_back(pages).collect()) == [("\n", "v", "c"), ("k 1", "u", "b")]
    records = [zip_warc.record_bytes(f"u{i}", i, f"body {i} " * 50) for i in range(6)]
    hurt = records[2][:12] + bytes(255 - b for b in records[2][12:])
    ends = [0, *itertools.accumulate(map(len, records))]
    line = "u %d " + '{"offset": "%d", "length": "%d", "filename": "%s"}'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("archive/hurt.warc.gz", b"".join([*records[:2], hurt, *records[3:]]))
        z.writestr("archive/x/data.warc.gz", b"".join(records))  # two members of one base name
        z.writestr("archive/y/data.warc.gz", b"".join(records))
        told = [line % (n, ends[n], len(records[n]), "x/data.warc.gz") for n in (1, 4)] + [line % (9, 10**9, 5, "x/data.warc.gz"), "u 1 {", "u {{ {", "u 1 [1]", ""]
        z.writestr("indexes/i.cdxj", "\n".join(told))
        z.writestr("indexes/j.cdxj.gz", b"\x1f\x8b junk")
    got = zip_warc.records(spark.createDataFrame([(str(tmp_path / "a.zip"),)], "package string")).collect()
    fine = sorted(int(r.key) for r in got if r.error is None)
    assert fine == sorted([0, 1, 3, 4, 5] + [*range(6)] * 2) and len([r for r in got if r.error]) == 1 and all(r.body == f"body {r.key} " * 50 for r in got if not r.error)


# ---- 9 AVI


def picture(h, w, n, rng):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([128 + 60 * np.sin(x / 7 + i) + 50 * np.cos(y / 5) + rng.normal(0, 5, (h, w)) for i in range(n)]).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize(("factors", "restart", "tables"), [(((1, 1),), 0, True), (((1, 1),), 5, False), (((2, 2), (1, 1), (1, 1)), 0, False), (((2, 1), (1, 1), (1, 1)), 3, True)])
def test_jpeg_round_trip(factors, restart, tables):
    rng = np.random.default_rng(0)
    h, v = factors[0]
    planes = [picture(50, 70, 3, rng)] + [picture(-(-50 // v), -(-70 // h), 3, rng) for _ in factors[1:]]
    for i, frame in enumerate(jpeg.decode_frames(jpeg.encode_frames(planes, factors, 95, restart, tables))):
        for got, want in zip(frame, planes, strict=True):
            assert got.shape == want[i].shape and np.abs(got.astype(int) - want[i]).mean() < 2.5
    assert all(sum(t[:16]) == len(t) - 16 == len(set(t[16:])) for t in jpeg.STANDARD.values())


def test_broken_frames_stay_alone():
    good = jpeg.encode_frames([picture(24, 32, 3, np.random.default_rng(1))])
    progressive = good[0].replace(b"\xff\xc0", b"\xff\xc2", 1)
    out = jpeg.decode_frames([good[0], good[1][:-40], b"", progressive, good[2]])
    assert [isinstance(x, str) for x in out] == [False, True, True, True, False]


@pytest.mark.parametrize("index", ["idx1", "absolute", "opendml", "none"])
def test_avi_indexes(index):
    frames = [b"abc", b"", b"defg"]
    data = media.write_avi(frames, 8, 8, 25, 2, index)
    seconds, places = media.parse_avi(data)
    assert seconds == 0.08 and [data[a:b] for a, b in places] == frames
    with pytest.raises(ValueError, match="AVI"):
        media.parse_avi(b"RIFF")


def test_clips(spark):
    film = media.films([b"x" * 3])[0]  # 4 scenes
    _, places = media.parse_avi(film)
    frames = [film[a:b] for a, b in places]
    hurt = [*frames[:2], b"", b"junk", *frames[4:]]
    rows = [(1, film), (1, film), (2, None), (3, b""), (4, media.write_avi([], 8, 8)), (5, media.write_avi(hurt, 32, 24)), (6, media.write_avi(frames[:1], 32, 24))]
    got = media.clips(spark.createDataFrame(rows, "page_id long, media binary").coalesce(1)).collect()
    want = [0, *itertools.accumulate(media.scenes(3))]
    one = [r for r in got if r.page_id == 1]
    assert len(one) == 8 and sorted((r.start_frame, r.end_frame) for r in one)[::2] == list(itertools.pairwise(want)) and one[1].start_s == want[1] / 10
    assert [r.start_frame for r in got if r.page_id == 5] == want[:-1] and sum(r.bad_frames for r in got if r.page_id == 5) == 1
    assert [bool(r.error) for r in got if r.page_id in (3, 4)] == [True, True] and [r.end_frame for r in got if r.page_id == 6] == [1]
    assert not [r for r in got if r.page_id == 2] and media.clips(spark.createDataFrame([], "page_id long, media binary")).count() == 0


def test_films_vary_and_large_frames_are_decoded_in_small_groups(spark, monkeypatch):
    texts = [b"x" * n for n in (3, 12, 20, 60, 64, 4095, 4096, 30_001)]
    made = media.films(texts)
    for text, film in zip(texts, made, strict=True):
        seconds, places = media.parse_avi(film)
        assert seconds == 0.1 and len(places) == sum(media.scenes(len(text)))
    assert len(media.scenes(30_001)) > len(media.scenes(3))
    want = [[0, *itertools.accumulate(media.scenes(len(t)))][:-1] for t in texts]
    parsed = [[film[a:b] for a, b in media.parse_avi(film)[1]] for film in made]
    assert [starts for starts, _ in media.find_clips(parsed)] == want
    monkeypatch.setattr(media, "PIXELS", 5000)
    flat = [f for v in parsed for f in v]
    sizes = [b - a for a, b in media.groups(flat)]
    assert sum(sizes) == len(flat) and max(sizes) == 5000 // (32 * 24) and min(sizes) >= 1
    assert [starts for starts, _ in media.find_clips(parsed)] == want


@pytest.mark.parametrize("text", [b"79019675", b"708341395", b"8572506773278"])
def test_light_that_moves_in_steps_is_no_cut(text):
    film = media.films([text])[0]
    frames = [film[a:b] for a, b in media.parse_avi(film)[1]]
    assert media.find_clips([frames])[0][0] == [0, *itertools.accumulate(media.scenes(len(text)))][:-1]


@pytest.mark.parametrize("quality", [25, 50, 75])
def test_steps_of_light_follow_the_quantiser(quality, monkeypatch):
    levels = np.r_[[100] * 6, np.arange(100, 112), [112] * 6, [160] * 6, [160, 154, 148, 142]]  # light rises slowly once, then a cut, then a fade
    coded = jpeg.encode_frames([np.broadcast_to(levels[:, None, None], (len(levels), 16, 16)).astype(np.uint8)], quality=quality)
    assert media.find_clips([coded[:30]])[0][0] == [0, 24]
    holes = [*coded[:3], b"", *coded[4:23], b"junk", b"", *coded[25:30]]  # the cut's own frame is missing: the next one is the first to differ
    want = media.find_clips([holes, [b"", *coded[24:30]], holes])
    assert want == [([0, 25], [1, 0]), ([0], [0]), ([0, 25], [1, 0])]
    monkeypatch.setattr(media, "PIXELS", 256)
    assert media.find_clips([holes, [b"", *coded[24:30]], holes]) == want


# ---- 10 exact top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)).astype(np.float32) * np.linspace(3, 0.1, 20).astype(np.float32)
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[1].tolist()), (900, None), (901, [1.0]), (902, [float("nan")] * 20), (903, [None] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (64, 4096):
        got = {}
        for r in bond.topk(df, 7, block=block).collect():
            got.setdefault(r.id, {})[r["rank"]] = r.neighbor_id
        d = ((x[:, None, :].astype(np.float64) - x[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        for i in range(300):
            want = np.lexsort((np.arange(300), d[i]))[:7]
            assert [got[i][n] for n in range(1, 8)] == want.tolist()
    assert bond.topk(df.limit(0)).count() == 0 and bond.topk(df.where("vec_id in (1, 2)"), 7).count() == 2


def test_topk_of_some_among_all_by_length(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:03}", rng.normal(size=3 + i % 3).round(1).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "name string, `v.x` array<double>").withColumns({"id": F.lit(1), "dims": F.lit(2), "g": F.lit("x")})
    got = {}
    for r in bond.topk(df, 4, "name", "v.x", 16, "substring(id, -1) = '0'").collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbor_id, round(r.distance, 9))
    assert set(got) == {n for n, _ in rows if n[-1] == "0"}
    for name, v in rows:
        if name in got:
            others = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 12), n) for n, w in rows if len(w) == len(v) and n != name)
            assert [got[name][i] for i in range(1, 5)] == [(n, round(d**0.5, 9)) for d, n in others[:4]]


def test_bounds_leave_few_candidates():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32)) * 3
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3).T
    i, _, _ = bond.nearest(x[:, :100], x, 10, np.full(100, np.inf), np.arange(100))
    assert len(i) < 100 * 4000 / 50  # what is left for double precision; the exact ten are among it


# ---- queries and pipeline


def test_queries_equal_sql(spark):
    from test_queries import TABLES, same

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in entry.ORACLES:
        same(spark, con, entry.QUERIES, entry.ORACLES, name)


def closure(prints, most):
    """The smallest key that each reaches by steps of at most ``most`` places."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_pipeline_equals_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    text_of = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    model = quality_mil.train(docs, table(spark, SF, "labels"))
    good = stages["quality classifier"](spark, docs, SF).cache()
    assert set(text_of(good)) == {d for d, t in text_of(docs).items() if quality_mil.judge(model, pa.array([t], pa.string()))[3][0]} and good.count() < docs.count()
    clear = stages["language id"](spark, good, SF).cache()
    network, want = langid.train(good), set()
    for r in good.collect():
        _, prob, blank = langid.judge(network, pa.array([r.text], pa.string()))
        own = network.languages.index(r.lang) if r.lang in network.languages else -1
        if not blank[0] and prob.max() >= 0.4 and (own < 0 or prob[0, own] >= 0.05):
            want.add(r.doc_id)
    assert set(text_of(clear)) == want
    one = stages["near duplicates"](spark, clear, SF).cache()
    prints = {r.doc_id: r.a & (1 << 64) - 1 | (r.b & (1 << 64) - 1) << 64 for r in simhash.fingerprint(clear).collect()}
    kept, within, beyond = set(text_of(one)), closure(prints, simhash.RADIUS), closure(prints, simhash.ACCEPT)
    gone = set(text_of(clear)) - kept
    assert gone and all(within[d] == d for d in kept if d in prints)  # a smaller one within the radius would stand for it
    assert all(any(k < d and beyond[k] == beyond[d] for k in kept) for d in gone)
    cut = stages["suffix-array dedup"](spark, one, SF).cache()
    texts = sorted(text_of(one).items())
    spans, want = naive_repeats([(d, t or "") for d, t in texts], 50), {}
    for d, t in texts:
        at, left, pieces = [m.span() for m in re.finditer(r"[^ \t\n\f\r]+", t)], 0, []
        for a, b in sorted((a, b) for x, a, b in spans if x == d):
            pieces.append(t[left : at[a][0]])
            left = at[b - 1][1]
        done = "".join(pieces) + t[left:]
        if done.strip() or not pieces:
            want[d] = done
    assert text_of(cut) == want and spans
    enc, held = packing.encoder(packing.vocabulary()), {}
    rows = stages["packing"](spark, cut, SF).collect()
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start_token, r.end_token))
    sizes = {d: len(enc.encode_ordinary(t)) for d, t in want.items()}
    assert {d: sorted(x)[-1][1] for d, x in held.items()} == sizes
    assert all(sorted(x)[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(sorted(x))) for x in held.values())
    limits = list((packing.LIMITS | {"loss_tokens": 4096}).values())
    order = sorted(rows, key=lambda r: (r.doc_id, r.piece))
    place = naive_place([(r.tokens, r.segments, r.loss_tokens) for r in order], limits)  # one group
    assert [(r.pack_id, r.position) for r in order] == [place[i] for i in range(len(order))]
    ran = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.piece, r.end_token) for r in ran.collect()} == {(r.doc_id, r.piece, r.end_token) for r in rows}


def test_stages_take_odd_rows(spark):
    base = table(spark, SF, "documents")
    plain = base.where("doc_id < 40 and text is not null and lang = 'en'").select("doc_id", "text", "lang", "source", "n_chars")
    good = plain.limit(8).collect()
    long = " ".join(f"{w}{i}" for i, w in enumerate((good[0].text + " ").split() * 400))
    rows = [tuple(r) for r in good] + [tuple(good[1])] * 2 + [(None, good[2].text, None, None, None), (5000, None, "en", "s", 1), (5001, "", None, "s", 0), (5002, " \n", "xx", None, None), (5003, long, None, "s", None), (5004, good[3].text, None, "s", -1), (5005, "...", "en", "s", 3)]
    extra = {c: F.lit(n) for n, c in enumerate(("tokens", "spans", "y", "group_id", "score", "keep", "language", "key", "salt", "n", "t", "node", "features"))}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        got[name] = out.select("doc_id", "text", "n_chars").collect()
    count = lambda name, d: sum(r.doc_id == d for r in got[name])
    twins = rows[1][0]
    for name in ("quality classifier", "language id"):
        assert [count(name, d) for d in (5000, 5001, 5002)] == [0, 0, 0] and count(name, twins) in (0, 3), name
    assert count("language id", None) == 1
    near = "near duplicates"
    assert [count(near, d) for d in (None, 5000, 5001, 5002, 5003)] == [1] * 5 and count(near, 5004) == 0 and count(near, twins) == 3
    cut = {r.doc_id: r for r in got["suffix-array dedup"]}
    assert cut[None].text == rows[2][1] and cut[5000].text is None and cut[5001].text == "" and cut[5003].text == long and count("suffix-array dedup", twins) == 3
    assert 5004 not in cut or len(cut[5004].text) < len(rows[3][1]) or len(rows[3][1].split()) < 50
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packs} == {r[0] for r in rows} - {None} and {r.tokens for r in packs if r.doc_id in (5000, 5001)} == {0}
    enc = packing.encoder(packing.vocabulary())
    assert sum(r.tokens for r in packs if r.doc_id == twins) == 3 * len(enc.encode_ordinary(rows[1][1]))
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in entry.QUERIES] == [f"op{i}" for i in range(1, 11)]
