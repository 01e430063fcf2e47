"""Operators against brute force on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pageloom.llm import components, cover_tree, decontamination, html_extract, licenses, line_dedup, mixing, ngram_join, pfor, token_counts, token_output, tokenizing, toxicity, wordhash

SPACE = " \t\n\x0b\x0c\r"
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE.replace("word30 ", "other ")), (3, BASE.upper()), (4, None), (5, ""), (6, "two words"), (7, "Two  Words"),
    (8, "A long line here\n\nA LONG line here \nshort\nß É ñ line of text"), (9, "a long line here\nkeep me whole please"), (None, "no id at all in this row"),
    (10, "x " * 3000), (11, " \t \n"), (12, BASE + "\n" + " ".join(f"tail{i}" for i in range(200))),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n": F.lit(1), "h": F.lit("clash"), "source": F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"), "lang": F.lit(None).cast("string")})


def key(line):
    return line.strip(SPACE).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))


def test_line_dedup(docs):
    first, want = {}, {}
    for i, t in sorted((r for r in TEXTS if r[0] is not None), key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        want[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    got = line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    assert dict(line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs)).filter("doc_id = 9").collect())[9] == "keep me whole please"


def test_line_dedup_over_many_partitions(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one common line\nown line number "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = line_dedup.kept_digests(df, line_dedup.keep_bitmaps(df)).groupBy("n_dropped").count().collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.n_dropped: r["count"] for r in got} == {0: 1, 1: 399}


def test_token_counts(docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    odd = docs.unionByName(docs.limit(0)).union(docs.filter("doc_id = 6").withColumn("text", F.lit("a  b \n c<|endoftext|> d'll it's x.")).withColumn("doc_id", F.lit(99).cast("long")))
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False)) for r in odd.collect()}
    for _ in range(2):  # the second time all counts come from the cache
        got = token_counts.token_counts(odd, path, cache)
        assert {r.doc_id: r.n_tokens for r in got.collect()} == want
    stored = odd.sparkSession.read.parquet(cache)
    assert stored.count() == len({r.text or "" for r in odd.collect()})
    stored.limit(3).write.mode("append").parquet(cache)  # a digest that stands there twice
    clash = odd.withColumns({"n_tokens": F.lit(-1), "n_bytes": F.lit("x")})
    got = token_counts.token_counts(clash, path, cache)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want and got.count() == odd.count() and len(got.columns) == len(set(got.columns))


def test_encoder_against_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = "<|ENDOFTEXT|> <|StartOfText|>x\u03a3<|ENDOFTEXT|> it's' x''s y'S'T don't,,, end<|endoftext|> <|startoftext|>! a_b_ __ \u00e9. \u00c9\u00c0!? \u017ft, \u0130x, \u03a3. \u0391\u03a3, UPPER \u00df# 12, 3.5% a1$ --"
    texts = ["", " ", odd, "a\u2026, b\u0301, \u00e9! rock'n'roll'", "x" * 5000 + "!" * 300, *odd.split()]
    r = np.random.default_rng(9)
    alphabet = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startofText|>", "<|", "|>", " ", "\n", "a", "Word", "\u0130", "\u03a3", "'s", "!", "\u00e9", "12"]
    texts += ["".join(r.choice(alphabet, r.integers(1, 12))) for _ in range(1500)]
    encoder = tokenizing.Encoder(path)
    want = [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    monkeypatch.setattr(tokenizing, "REMEMBERED", 3)  # it forgets between calls
    assert [encoder.encode([t])[0] for t in texts] == want


def test_token_output(docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(path), 0, {}
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_output.write_token_ids(docs, str(tmp_path / "ids"), path, chunk_ids=50)
    got = token_output.read_digests(docs.sparkSession, str(tmp_path / "ids")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


@pytest.mark.parametrize("ids", [[], [7], [5] * 300, list(range(1000)), [0, 2**32 - 1] * 100])
def test_pfor_round_trip(ids):
    x = np.array(ids, np.uint32)
    data = pfor.encode(x)
    assert np.array_equal(pfor.decode(data), x)
    assert np.array_equal(pfor.decode(data, 1, 2), x[128:256])


def shingles(t, k=5):
    w = [x.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups_by_force(rows):
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_ngram_groups(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs).collect()}
    assert got.pop(None) == (3, None)
    assert got == groups_by_force([r for r in TEXTS if r[0] is not None])


def test_ngram_copy_behind_a_row_without_id(spark):
    rows = [(None, BASE), (2, BASE), (3, BASE.replace("word30 ", "other "))]
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 2: 2, 3: 2}


def test_ngram_groups_of_many_edits(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = [f"w{x}" for x in range(40 + 10 * (i % 3))]
        for at in r.integers(0, len(words), r.integers(0, 6)):
            words[at] = f"edit{r.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_groups(df).collect()} == groups_by_force(rows)


def test_components_in_parts(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 140), (140, 120), (200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    for size in (1000, 8):
        got = {r.node: r.component for r in components.components(df, size).collect()}
        assert {k: v for k, v in got.items() if k != 200} == {**dict.fromkeys(range(61), 0), 100: 100, 120: 100, 140: 100}


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    rows = [(i, int(i % 2), (base[i % 40] + r.normal(scale=0.05, size=8)).tolist()) for i in range(400)]
    rows += [(1000, 1, rows[1][2]), (1001, None, rows[1][2]), (1002, 1, None), (1003, 1, [0.0] * 8), (1004, 1, [float("nan")] * 8), (1005, 1, [None] * 8), (1006, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in cover_tree.near_vectors(df, 0.98, leaf=64).collect()}
    ok = [(i, lab, np.array(e, np.float32).astype(float)) for i, lab, e in rows if i <= 1000]
    low, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    pairs = [(a[0], b[0]) for a in ok for b in ok if a[0] != b[0] and a[1] == b[1] and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= 0.98]
    for a, _ in pairs:
        n[a] += 1
    for _ in range(400):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if all(low[a] == low[b] for a, b in pairs):
            break
    assert got == {i: (n[i], low[i], low[i] == i) for i in n}


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi"
    w = item.split()
    reordered = " ".join(w[8:]).title() + ". And then, " + " ".join(w[:8]) + "!"
    docs = spark.createDataFrame([(1, "before " + item), (2, reordered), (3, " ".join(w[:5])), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    for block in (1 << 20, 8):
        got = {(r.doc_id, r.item_id): (r.covered_words, r.n_tiles) for r in decontamination.leaks(docs, items, block_bytes=block).collect()}
        assert got == {(1, 7): (16, 1), (2, 7): (16, 2), (None, 7): (16, 1)}


def test_tile_against_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = (r.integers(0, 4, r.integers(1, 30)).astype(np.uint64) for _ in range(2))
        marked_a, marked_b, want = np.zeros(len(a), bool), np.zeros(len(b), bool), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            marked_a[i : i + n] = marked_b[j : j + n] = True
            want += n
        assert sum(t[2] for t in decontamination.tile(a, b, 3)) == want


def test_toxicity(spark):
    r = np.random.default_rng(2)
    plain = [f"plain{i}" for i in range(300)]
    rows, labels = [(9000, None), (9001, "")], []
    for i in range(600):
        bad = i % 6 == 0
        words = list(r.choice(plain, 40)) + (list(r.choice(["nastyone", "vilething"], 2)) if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)) if i % 7 else (i, None, None))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known, ["quality", "toxic"])
    got = {x.doc_id: x.p_toxic >= 0.5 for x in toxicity.score(docs, chain).collect()}
    assert {i for i, t in got.items() if t} == set(range(0, 600, 6))
    assert toxicity.without(docs, chain, "toxic").count() == 502
    empty = toxicity.train(docs, known.limit(0), ["quality", "toxic"])
    assert toxicity.score(docs.limit(5), empty).filter("p_toxic > 0.5").count() == 0


def test_mixing_deviation(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").otherwise(None).alias("source"))
    plan = mixing.schedule(df, period=100, block_docs=8).select("source", "block", "epoch", "slot").distinct().collect()
    assert len({p.slot for p in plan}) == len(plan)
    shares = {r.source: r.share / 100 for r in mixing.target_weights(df.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n")), 100).collect()}
    seen = dict.fromkeys(shares, 0)
    for t, p in enumerate(sorted(plan, key=lambda p: p.slot)):
        seen[p.source] += 1
        assert all(abs(seen[s] - shares[s] * (t + 1)) < 1 for s in shares)
    assert mixing.schedule(df).select("doc_id").distinct().count() == 6000
    assert mixing.schedule(df.limit(0)).count() == 0


def test_mixing_of_many_sources(spark):
    """More sources than slots of the shortest period, one of them with a third of the rows."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(1500)))).alias("source"))
    sizes = df.groupBy("source").agg(F.count("*").alias("n"))
    assert sizes.count() > mixing.PERIOD
    rows = mixing.schedule(df, block_docs=4).collect()
    assert {r.doc_id for r in rows} == set(range(n))
    assert len({r.slot for r in rows}) == len({(r.source, r.block, r.epoch) for r in rows})
    period = mixing.whole_period(sizes.count())
    shares = {r.source: r.share for r in mixing.target_weights(sizes, period).collect()}
    assert sum(shares.values()) == period and min(shares.values()) > 0
    weight = {r.source: r.n**mixing.ALPHA for r in sizes.collect()}
    assert abs(shares["hot"] / period / (weight["hot"] / sum(weight.values())) - 1) < 1 / mixing.SLOTS_EACH
    seen = dict.fromkeys(shares, 0)
    for t, (_, s) in enumerate(sorted({(r.slot, r.source) for r in rows})):
        seen[s] += 1
        assert abs(seen[s] - shares[s] / period * (t + 1)) < 1


def test_packed_ids_are_in_the_order_of_the_mix(spark):
    import corpus_pipeline

    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 120, "a").otherwise("b").alias("source"))
    mix = corpus_pipeline.mixed(spark, df, "")
    want = [r.doc_id for r in mixing.schedule(df).sort("slot", "place").collect()]
    assert want != sorted(want)
    got = corpus_pipeline.packed_ids(spark, mix, "").sort("start").collect()
    assert [r.doc_id for r in got] == want


def test_licences(spark):
    rows = [(1, "src/a/one.c", "x = 1\nReleased under the MIT License."), (2, "src/a/b/two.c", "none here"), (3, "src/three.c", None), (4, None, ""), (5, "src/a/b/five.c", "// Licensed under the Apache License, Version 2.0.\nlicence plates are metal")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("n", F.lit(0))
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in licenses.licences(df).collect()}
    assert got[1][:2] == ("MIT", "own") and got[5][:2] == ("Apache-2.0", "own")
    assert got[2] == ("Apache-2.0", "inherited", "src/a/b") and got[3][1] == got[4][1] == "none"


def test_html_blocks():
    page = '<title>t</title><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four<script>var x="</p>";</script></article><p>cut <a hre'
    assert [b[0] for b in html_extract.blocks(page)] == ["Menu", "A & B", "one two three", "four", "cut"]


def test_html_held_out(spark):
    net, pages = html_extract.trained(), html_extract.labelled_pages(150, 12345)
    right = [(p == (y > 0)).all() for p, (_, y) in zip(net.label([x for x, _ in pages]), pages, strict=True)]
    assert np.mean(right) > 0.95
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<nav><a>x</a></nav><article><p>Some text of this page.</p></article>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {1: "", 2: "", 3: "Some text of this page."}


def test_word_hashes_are_those_of_each_word_alone():
    import pyarrow as pa

    col = pa.array(["The cat", None, "", "the  CAT\tsat", "é"])
    words, bounds = wordhash.hash_words(col)
    assert list(np.diff(bounds)) == [2, 0, 0, 3, 1]
    assert words[0] == words[2] and words[1] == words[3] and len(set(words.tolist())) == 4


@pytest.mark.parametrize("op", ["line", "count", "ids", "ngram", "vectors", "leaks", "licence"])
def test_empty_tables(spark, op):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, path string")
    vec = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    items = spark.createDataFrame([], "item_id long, text string")
    out = {
        "line": lambda: line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs)),
        "count": lambda: token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "ids": lambda: token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json")),
        "ngram": lambda: ngram_join.ngram_groups(docs),
        "vectors": lambda: cover_tree.near_vectors(vec),
        "leaks": lambda: decontamination.leaks(docs, items),
        "licence": lambda: licenses.licences(docs),
    }[op]()
    assert out.count() == 0
