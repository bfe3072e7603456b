"""Every operator on nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import bpe, common, decontam, html_cut, knn_join, langid, secrets, sharding, simhash, toxicity, warc
from causeway.llm.common import fresh_dir

LONG = "word " * 60_000 + "end"
TEXTS = [(1, "The quick brown fox jumps over the lazy dog again and again", "en"), (2, "", "en"), (3, None, None), (4, "The quick brown fox jumps over the lazy dog again and again", "en"), (4, "The quick brown fox jumps over the lazy dog again and again", "en"), (None, "le chat est sur la table et le chien dort", "fr"), (6, LONG, "en"), (7, "!!! 123 ...", "fr"), (8, "é" * 5000, "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("digest", "score", "slot", "ids", "fp4", "lang_pred", "item_id", "path", "content", "label", "node", "u", "_text2")})


def test_sharding(docs):
    out = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert out.count() == len(TEXTS) and set(docs.columns) <= set(out.columns) and out.columns.count("slot") == 1
    assert out.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharding.place(docs.limit(0), "doc_id", ["a"]).count() == 0


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    t = sharding.lookup_table(names, 10_007)
    share = np.bincount(t)
    assert share.max() - share.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 10_007)
    moved = (np.array(names, dtype=object)[t] != np.array(names, dtype=object)[fewer]) & (t != 9)
    assert moved.mean() < 0.05
    assert np.bincount(sharding.lookup_table(["a", "b"], 1009, {"a": 3}))[0] == pytest.approx(1009 * 0.75, abs=4)
    for bad in (dict(shards=[]), dict(shards=["a", "a"]), dict(shards=["a"], slots=100)):
        with pytest.raises(ValueError):
            sharding.lookup_table(**bad)
    # brute force of the rule, slot by slot
    taken, at, left = {}, {n: 0 for n in names}, 101
    off = {n: sharding._number(n, b"offset") % 101 for n in names}
    step = {n: sharding._number(n, b"step") % 100 + 1 for n in names}
    while left:
        for n in names:
            if left:
                pref = [(off[n] + j * step[n]) % 101 for j in range(101)]
                taken[next(s for s in pref if s not in taken)] = n
                left -= 1
    assert [names[i] for i in sharding.lookup_table(names, 101)] == [taken[i] for i in range(101)]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", b"x" * 200), (2, None, b"x" * 200), (3, "u", None), (4, "u", b""), (5, "u", b"short"), (6, "u", b"short"), (7, "u", bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, b"x" * 200)]
    df = spark.createDataFrame(rows, "record_id long, uri string, payload binary").withColumns({c: F.lit("x") for c in ("digest", "refers_to", "first_id", "n")}).drop("first_id", "n")
    at = fresh_dir(spark, "t")
    planned = warc.plan_records(df)
    kinds = {(r["record_id"]): (r["record_type"], r["refers_to"]) for r in planned.collect()}
    assert kinds[1] == ("response", None) and kinds[2] == ("revisit", 1) and kinds[5] == kinds[6] == ("response", None)
    warc.write_archives(planned, f"{at}/a", 400_000)
    assert len(warc.size_classes(785, 400_000)) == 2  # both hold records here
    warc.store(warc.read_archives(spark, f"{at}/a"), f"{at}/s")
    got = warc.reconstruct(spark, f"{at}/s").collect()
    assert len(got) == len(rows) and spark.read.parquet(f"{at}/s/payloads").count() == 4
    by = {r["record_id"].split(":")[-1].rstrip(">"): r for r in got}
    assert bytes(by["7"]["payload"]) == rows[6][2] and bytes(by["2"]["payload"]) == rows[0][2]
    assert bytes(by["7"]["record"]) == bytes(by["7"]["header"]) + rows[6][2] + b"\r\n\r\n" and b"%0D%0AX: y" in bytes(by["1"]["header"])
    forged = warc.read_archives(spark, f"{at}/a").withColumn("verified", F.lit(False))
    with pytest.raises(Exception, match="digest differs"):
        warc.store(forged, f"{at}/bad")


def test_warc_files_are_bounded_by_bytes():
    for largest in (0, 100, 64_000, 64_001, 3_000_000, 500_000_000):
        classes = warc.size_classes(largest)
        assert classes[0][0] == 0 and classes[-1][1] >= largest and all(b[0] == a[1] + 1 for a, b in zip(classes, classes[1:], strict=False))
        assert all(most == 1 or most * high <= warc.FILE_BYTES for _, high, most in classes) and classes[0][2] == warc.RECORDS_A_FILE


def test_warc_empty(spark):
    at = fresh_dir(spark, "t")
    warc.write_archives(warc.plan_records(spark.createDataFrame([], "record_id long, uri string, payload binary")), f"{at}/a")
    warc.store(warc.read_archives(spark, f"{at}/a"), f"{at}/s")
    assert warc.reconstruct(spark, f"{at}/s").count() == 0


def test_secrets_ledger(spark):
    v = lambda rows: spark.createDataFrame(rows, "path long, content string")
    at = fresh_dir(spark, "ledger")
    first = secrets.scan(v([(1, 'x token = "abcdef1"'), (2, 'x token = "abcdef1"'), (3, None), (None, "😀 secret=token: abcdefgh" + "AKIA" + "A" * 16)]), at)
    assert sorted((r["kind"], r["start"], r["end"]) for r in first.collect()) == [("access", 24, 44), ("assign", 2, 18)]
    scans = spark.read.parquet(f"{at}/scans").count()
    secrets.scan(v([(9, 'x token = "abcdef1"'), (8, "deadbeef" * 4)]), at)
    assert spark.read.parquet(f"{at}/scans").count() == scans + 3  # one unseen blob under three rules
    more = (*secrets.RULES, secrets.Rule("email", r"[a-z]+@[a-z]+", 0, 5, "@"))
    got = secrets.scan(v([(9, 'x token = "abcdef1"'), (7, "joe@example")]), at, more)
    assert got.filter("kind = 'email'").count() == 1 and secrets.scan(v([]), at).count() == 3


def test_redact(spark, docs):
    df = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("a password: hunter22 b " + "0123456789abcdef" * 2)).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert out[1]["text"] == "a [secret] b [secret]" and out[1]["n_chars"] == 21 and out[3]["text"] is None and out[6]["text"] == LONG
    assert secrets.redact(df).count() == len(TEXTS)


def test_simhash_edges(docs):
    out = simhash.near_components(simhash.fingerprints(docs.select("doc_id", "text", "u")).withColumnRenamed("fp4", "fp")).collect()
    assert len(out) == len(TEXTS)
    comp = {(r["doc_id"]): r["component_id"] for r in out}
    assert comp[4] == 1 and comp[2] == comp[3] == 2 and comp[None] is None
    assert simhash.near_components(simhash.fingerprints(docs.limit(0).select("doc_id", "text")).withColumnRenamed("fp4", "fp")).count() == 0


@pytest.mark.parametrize("most", [2, 32_768])
def test_links_span_what_brute_force_finds(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_IN_RUN", most)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        x = b
        for _ in range(40):  # chains and crowds
            x = (x if rng.random() < 0.5 else b) ^ np.uint64(sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 5), replace=False)))
            fps.add(int(x))
    fps = sorted(f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {frozenset((r["u"], r["v"])) for r in simhash.links(df).collect()}

    def groups(pairs):
        p = {f: f for f in fps}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            p[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in out.values()}

    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert all((a ^ b).bit_count() <= 4 for a, b in map(tuple, got)) and groups(map(tuple, got)) == groups(want)


def test_drop_near_duplicates(spark, docs):
    words = [f"w{i}" for i in range(120)]
    near = words[:60] + ["other"] + words[61:]
    df = docs.unionByName(spark.createDataFrame([(50, " ".join(words), "en"), (51, " ".join(near), "en"), (52, " ".join(words[:60] + words[:40:-1]), "en")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    out = simhash.drop_near_duplicates(df)
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=str) == sorted([1, 2, None, 6, 7, 8, 50, 52], key=str) and out.columns == df.columns
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_langid_edges(spark, docs):
    train = docs.select("text", "lang")
    model = langid.fit(train)
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert out[2]["lang_pred"] == out[3]["lang_pred"] == out[7]["lang_pred"] == "und" and out[1]["lang_pred"] == "en" and out[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_langid_profiles_against_brute_force(docs):
    from collections import Counter

    text = "Ab ab, éa b2c  ab"
    want: Counter = Counter()
    for w in ["ab", "ab", "éa", "b", "c", "ab"]:
        p = f" {w} "
        want.update(w)
        want.update(p[i : i + 2] for i in range(len(p) - 1))
        want.update(p[i : i + 3] for i in range(len(p) - 2))
    keys, ns = langid.counted(text)
    spell = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    assert {spell(int(k)): int(n) for k, n in zip(keys, ns, strict=True)} == dict(want)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = m.score(docs)
    assert out.count() == len(TEXTS) and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.fit(docs.limit(0).select("doc_id", "text"), labels.limit(0)).score(docs).filter("score <> 0").count() == 0
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an idiot! a st*pid 1d10t, i d i o t", toxicity.Odds({})), strict=True))
    assert f["list_count"] == 1 and f["near_second_person"] == 1 and f["obfuscated_hits"] == 3 and f["exclamations"] > 0


def test_toxicity_learns(spark):
    rows = [(i, f"some text number {i} " + ("you idiot moron" if i % 4 == 0 else "with kind words"), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).score(df.select("doc_id", "text", "toxic"))
    assert out.filter("predicted <> toxic").count() == 0


def test_toxicity_learns_inflected_words_of_small_groups(spark):
    """A stem that marks 4 % of the rows only, each inflection of it in a few; neighbours of the stem are clean."""
    def text(i):
        ending = "abcdefghijklmnopqrstuvwxyz"[i % 26] + "eioua"[i % 5]
        return f"number {i % 89} and some plain words " + (f"vragu{ending} stands here" if i % 25 == 0 else "you moron" if i % 10 == 1 else f"vrago{ending} is kind")

    rows = [(i, text(i), int(i % 25 == 0 or i % 10 == 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    new = spark.createDataFrame([(1, "here stands vraguzz again"), (2, "vragozz again"), (3, None), (4, "A MORON, you are!")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).score(new).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}
    kept = toxicity.drop_toxic(df.select("doc_id", "text", F.lit("x").alias("source")), df.select("doc_id", "toxic"))
    assert kept.columns == ["doc_id", "text", "source"] and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, y in rows if not y]


def test_learned_terms_do_not_depend_on_tasks(spark):
    import math

    rows = [(i, f"w{'abcdefgh'[i % 8]}zz " + ("qqbad qqbadly " if i % 4 == 0 else "fine words"), float(i % 4 == 0), i % toxicity.PARTS) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double, part long")
    one, many = toxicity.learned_terms(df.coalesce(1)), toxicity.learned_terms(df.repartition(7, "doc_id"))
    assert one == many and len(one) == toxicity.PARTS + 1
    assert one[-1]["qqbad"] == pytest.approx(math.log(40.5 / 41) - math.log(0.5 / 121) - toxicity.ERRORS * math.sqrt(1 / 40.5 + 2)) and "fin" not in one[-1]
    assert toxicity.Odds(one[-1])["qqbadder"] == one[-1]["qqbad"] and toxicity.Odds(one[-1])["fine"] == 0


def test_bpe_edges(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    t = Tokenizer.from_file(path)
    odd = ["  a\x1cb c d ", "İstanbul ΑΣ. é ́x", "Hello<|endoftext|>World's 12a!", "a\x85b\x0bc﻿d​e \x00z", "　x  y"]
    df = docs.unionByName(spark.createDataFrame([(100 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    for most in (4, bpe.HEAD_WORDS):
        for r in bpe.decode(bpe.encode(df, path, most=most), path).collect():
            want = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == t.decode(want, skip_special_tokens=False)
    one = {r["doc_id"]: r for r in bpe.round_trips(df, path).collect()}
    assert one[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and bpe.encode(df.limit(0), path).count() == 0


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>a<p>b &amp; c&nbsp; d", "x"), (4, "<article>" + "<p>para graph.</p>" * 3000 + "</article>", "x"), (5, '<div "<<<a href="' * 200, "x")], "page_id long, html string, text string")
    out = {r["page_id"]: r for r in html_cut.extract(df).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[1]["n_chars"] == 0 and out[3]["text"] == "a b & c d" and out[4]["text"].count("para") == 3000


def test_knn_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [-1.0, -1.0]), (2, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = knn_join.integer_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn_join.top_k(df, F.col("id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536)] and got[3:6] == [(50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)] and len(got) == 9
    assert knn_join.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("blocks", [(4096, 16384), (3, 7)])
def test_knn_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(knn_join, "DATA_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in (-1, 0, 1)])
    v = np.floor(x * 256).astype(int)
    df = knn_join.integer_vectors(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn_join.top_k(df, F.col("id") % 9 == 0).collect()}
    for q in range(0, 180, 9):
        best = sorted(((-int(v[q] @ v[s]), s) for s in range(180) if s != q))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(s, -p) for p, s in best]


@pytest.mark.parametrize(("blocks", "most"), [((4096, 16384), 0.5), ((40, 300), 0.1)])
def test_knn_leaves_out_far_clusters(spark, monkeypatch, blocks, most):
    """Clusters far apart: queries stand in two of forty. The share of (vector, group of queries) pairs that travel is well below one, and results are exact."""
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(knn_join, "DATA_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = np.repeat(centre, 50, axis=0) + rng.normal(scale=0.01, size=(2000, 16))
    v = np.floor(x * 256).astype(int)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    df = knn_join.integer_vectors(spark.createDataFrame(rows, "id long, embedding array<double>")).select("id", "v")
    ask = F.col("id") < 100
    norm2 = float((v.astype(float) ** 2).sum(1).max())
    queries, data = knn_join.spread(df.select("id", "v", ask.alias("query")), 5, knn_join.PIVOTS, "<i4", norm2)
    groups = queries.select(F.shiftright("block", 20).alias("g")).distinct().count()
    assert queries.select("id").distinct().count() == 100 and data.count() <= most * groups * len(x)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn_join.top_k(df, ask).collect()}
    for q in range(100):
        best = sorted(((-int(v[q] @ v[s]), s) for s in range(len(x)) if s != q))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(s, -p) for p, s in best]


def test_knn_repeated_queries(spark):
    """A query of a dozen equal rows, beside its true neighbours; an id of two vectors."""
    rows = [(0, [1.0, 0.0])] * 12 + [(i, [1.0 - i / 100, i / 50]) for i in range(1, 9)] + [(50, [0.0, 1.0]), (50, [0.0, -1.0])]
    df = knn_join.integer_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"))
    got = knn_join.top_k(df, F.col("id") % 50 == 0, 5).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0] == [(i, i) for i in range(1, 6)]
    assert sorted(r["rank"] for r in got if r["query_id"] == 50) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and {r["vec_id"] for r in got if r["query_id"] == 50} <= set(range(9))


def test_decontam_edges(spark, docs):
    items = spark.createDataFrame([(1, "Which animal leaps above one sleepy hound?\nThe quick brown fox jumps over the lazy dog again"), (2, None), (3, ""), (None, "x"), (4, "zz " * 700 + "yy")], "item_id long, text string")
    df = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit(LONG), F.lit(" which animal leaps above one sleepy hound? The quick brown fox jumps over the lazy dog, again. "), F.lit(LONG))).otherwise(F.col("text")))
    got = decontam.leaks(df, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(7, 1)]
    assert decontam.leaks(df, items, most=1).count() == 1 and decontam.leaks(df, items.limit(0)).count() == 0
    kept = decontam.decontaminate(df, items)
    assert kept.count() == len(TEXTS) - 1 and kept.columns == df.columns


def test_html_boilerplate_by_name_and_place():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar"><header><a href=/>Site</a><p>The best site of all sites in the world.</p></header><nav>Menu <a>a</a></nav>
    <div class="cookiebar">We use cookies to improve your experience on this site. Please accept them.</div><div id="main"><div class="post"><h1>My Title</h1>
    <p>First paragraph of the text, with <a href=x>a link</a> in it, and more words.</p><div class="share">Share this</div><p>Short.</p><ul><li>One item of the list</li><li>Another item</li></ul>
    <div class="adbox">Buy now our great product for little money!</div><p>Last paragraph &amp; the end of the story, as it is told here.</p></div></div>
    <aside class="x"><p>A long sidebar paragraph that tells about other things in many words.</p></aside><form><p>Subscribe to our newsletter</p><textarea>abc</textarea></form>
    <ol class="commentlist"><li><article><p>I think this is a great article and I like it very much.</p></article></li></ol><footer>(c) 2020 Somebody. All rights reserved.</footer></body></html>"""
    assert html_cut.main_text(page) == "My Title First paragraph of the text, with a link in it, and more words. Short. One item of the list Another item Last paragraph & the end of the story, as it is told here."


def _near_groups(texts, similarity=0.8):
    """The smallest position of each text's group, by comparing all pairs."""
    sets = [set(simhash.shingle_hashes(t.encode(), simhash.NEAR_WORDS).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def _kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}


@pytest.mark.parametrize(("pairs", "long"), [(64, 64), (0, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, pairs, long):
    """Short and long texts with words changed anywhere; a crowd of hundreds around one text, whose members differ from each other; repeated lines; texts that differ in case only."""
    monkeypatch.setattr(simhash, "PAIRS_A_MEMBER", pairs)
    monkeypatch.setattr(simhash, "LONG_RUN", long)
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(10**9)}"
    texts = []
    for n in (13, 24, 60, 400):
        for _ in range(40):
            x = [word() for _ in range(n)]
            y = list(x)
            for at in rng.integers(0, n, rng.integers(1, 2 + n // 100)):
                y[-1 if rng.random() < 0.5 else at] = word()
            texts += [" ".join(x), " ".join(y)]
    base = [word() for _ in range(120)]
    for _ in range(300):
        x = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            x[at] = word()
        texts.append(" ".join(x))
    body = " ".join(word() for _ in range(400))
    texts += [body + (" " + " ".join(word() for _ in range(8))) * 20 for _ in range(2)]
    texts += ["One two three four five six", "one two  three four five SIX", "one TWO three four five six"]
    want = {i for i, g in enumerate(_near_groups(texts)) if i == g}
    assert _kept(spark, texts) == want


def test_repeated_lines_do_not_part_near_duplicates():
    rng = np.random.default_rng(4)
    body = " ".join(f"w{x}" for x in rng.integers(10**9, size=400))
    a, b = (simhash.shingle_set((body + (" " + " ".join(f"w{x}" for x in rng.integers(10**9, size=8))) * 20).encode(), 5) for _ in range(2))
    assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    none = np.empty(0, dtype=np.uint64)
    assert np.intersect1d(simhash.prefix(a, none, 0.8), simhash.prefix(b, none, 0.8)).size


@pytest.mark.parametrize("n", [13, 24, 400])
def test_no_pair_at_the_similarity_is_missed(n):
    rng = np.random.default_rng(n)
    none, met = np.empty(0, dtype=np.uint64), 0
    for _ in range(500):
        x = [f"w{i}" for i in rng.integers(10**9, size=n)]
        y = list(x)
        for at in rng.integers(0, n, 1 + n // 60):
            y[-1 if n < 30 else at] = "other"
        a, b = (simhash.shingle_set(" ".join(w).encode(), 5) for w in (x, y))
        if (both := len(np.intersect1d(a, b))) >= 0.8 * (len(a) + len(b) - both):
            met += 1
            assert np.intersect1d(simhash.prefix(a, a[::3], 0.8), simhash.prefix(b, a[::3], 0.8)).size
            for to in (32, min(len(simhash.parities(s)) for s in (a, b))):
                x, y = (simhash.folded(simhash.parities(s), to) for s in (a, b))
                assert len(x) == len(y) == to and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9 + 1e-9
    assert met > 100


@pytest.mark.parametrize("most", [3, 32_768])
def test_crowds_of_one_fingerprint_end(spark, monkeypatch, most):
    """Hundreds of texts of a template in one number each, in runs beyond the bound: the fingerprints of many are equal."""
    monkeypatch.setattr(simhash, "MOST_IN_RUN", most)
    monkeypatch.setattr(simhash, "BROADCAST_TEXTS", most)
    body = " ".join(f"w{i}" for i in range(400)).split()
    texts = [" ".join([*body[: 100 + i % 7], f"n{i}", *body[100 + i % 7 :]]) for i in range(60)] + ["something else that has nothing to do with it"]
    assert _kept(spark, texts) == {0, 60}


def test_many_texts_of_one_set(spark):
    texts = [f"a{' ' * (i + 1)}b c d e f g" for i in range(3000)]
    assert _kept(spark, texts) == {0}


def test_decontam_long_items(spark):
    passage = " ".join(f"p{i}" for i in range(260))
    items = spark.createDataFrame([(1, passage + "\nthe river"), (2, " ".join(f"q{i}" for i in range(257)))], "item_id long, text string")
    half = " ".join(f"p{i}" for i in range(100))
    texts = ["we walked along the river", "q256 and q255 q256", f"x {passage} y the river z", f"{passage} without it", f"{half} the river", "x " + " ".join(f"q{i}" for i in range(257))]
    got = decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(2, 1), (5, 2)]
    for n in (257, 300, 700):
        cut = decontam.entries_of(" ".join(f"p{i}" for i in range(n)) + "\nthe river")
        assert {w for e in cut for w in e[0]} == {b"p%d" % i for i in range(n)} and {len(e[0]) for e in cut} == {decontam.PIECE_WORDS} and all(e[2] == b"the river".split() for e in cut)


def test_html_drops_no_article():
    story = "First sentence of the story, as it is told here. Second sentence of it, with some more words."
    article = f"<article><p>{story}</p></article>"
    for before in ('<svg class="i"/>', "<svg><path d='x'></svg>", "<div><button>Go</div>", "<div><select><option>a<option>b</div>", "<div><canvas></div>", "<button/>", "<div><textarea>abc</div>", "<template><div>x</template>", "<button><p>Go</p></button>"):
        assert html_cut.main_text(f"<body>{before}{article}</body>") == story, before
    assert html_cut.main_text(f"<body><article><p>{story} <math><mi>x</mi></math> <object data=x>as told</object></p></article></body>") == f"{story} x as told"
    asp = f'<body><form id="aspnetForm"><input type="hidden" name="s"><input name="q"><nav>Menu</nav>%s</form></body>'
    assert html_cut.main_text(asp % article) == html_cut.main_text(asp % f"<div><p>{story}</p></div>") == story
    assert html_cut.main_text(f'<body>{article}<form><p>Give us your name and address, please.</p><input name="a"></form></body>') == story
    assert html_cut.main_text('<body><form><p>User name</p><input name="a"><p>Password</p><input name="b"><p>Please log in.</p></form></body>') == ""


STORY = "The council met on Monday evening to talk about the new bridge, and most of its members were in favour of it. They will vote next week."
ARTICLE = f"<article><p>{STORY}</p><p>{STORY}</p></article>"


@pytest.mark.parametrize(("page", "times"), [
    (f"<body><button>Go{ARTICLE}</body>", 2), (f"<body><select><option>a{ARTICLE}</body>", 2), (f"<body><form><select><option>a<p>{STORY}</p></form></body>", 1), (f'<body><article class="post share-enabled"><p>{STORY}</p></article></body>', 1),
    (f'<body><nav>Menu</nav><div class="widget-area-main">{ARTICLE}</div></body>', 2), (f'<body><nav><a href=x>Home</a></nav><div id="page-widget"><p>{STORY}</p><p>{STORY}</p></div></body>', 2), (f'<article><p>{STORY}</p><section class="legal-history"><p>{STORY}</p></section></article>', 2),
    (f'<body>{ARTICLE}<div class="comments"><article><p>{STORY}</p></article><p>{STORY * 6}</p></div></body>', 2), (f'<article><p>{STORY}</p><section class="comments-area"><p>{STORY * 4}</p></section></article>', 1), (f'<article><p>{STORY}</p><div class="ad-slot-top"><p>{STORY}</p></div></article>', 1),
    (f'<body><nav>Menu</nav><div class="comments"><p>{STORY}</p></div><div class="ad"><p>{STORY}</p></div></body>', 0), (f'<body><div class="related-posts"><p>{STORY}</p></div>{ARTICLE}</body>', 2), (f"<body><noscript><p>{STORY}</p></noscript><svg><text>{STORY}</text></svg>{ARTICLE}</body>", 2),
])
def test_html_names_are_evidence_and_controls_end(page, times):
    assert html_cut.main_text(page) == " ".join([STORY] * times)


def test_html_cut_overrules_single_blocks():
    """A short line amid paragraphs and a plain line amid links: by itself each would get the other label."""
    page = f"<body><div><p>{STORY}</p><p>{STORY}</p><div>Part two</div><p>{STORY}</p><p>{STORY}</p></div><div><a href=a>One</a></div><div><a href=b>Two</a></div><div>More of this here</div><div><a href=c>Three</a></div></body>"
    alone = [z > 0 for z in html_cut.odds(html_cut.blocks_of(page))]
    assert alone == [True, True, False, True, True, False, False, True, False]
    assert html_cut.main_text(page) == " ".join([STORY, STORY, "Part two", STORY, STORY])


def test_bpe_leaves_nothing_in_the_workers(spark):
    """Python workers are kept from stage to stage: the stages after bpe must not carry its vocabulary and tables."""

    def held(batches):
        import functools
        import gc

        for _ in batches:
            found = [type(o).__name__ for o in gc.get_objects() if type(o).__module__ == bpe.__name__]
            found += [f"cached by {o.__name__}" for o in gc.get_objects() if isinstance(o, functools._lru_cache_wrapper) and o.__module__ == bpe.__name__ and o.cache_info().currsize]
            yield pa.RecordBatch.from_pydict({"held": pa.array(sorted(set(found)), pa.string())})

    docs = spark.createDataFrame([(i, f"word{i} and some other words") for i in range(200)], "doc_id long, text string")
    for out in (bpe.round_trips(docs, bpe.vocabulary()), bpe.decode(bpe.encode(docs, bpe.vocabulary()), bpe.vocabulary())):
        assert {r["n_tokens"] > 0 for r in out.collect()} == {True}
        for _ in range(3):
            assert spark.range(0, 16, 1, 8).mapInArrow(held, "held string").collect() == []


def test_workers_give_memory_back():
    """A task starts without what the largest one before it took; a block that stays above must not hold it."""
    from pathlib import Path

    def mb():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon")) / 1024

    took = [np.ones(12_500) for _ in range(2_000)]  # 200 MB in blocks that the heap holds
    stays = took[1::50]
    full = mb()
    del took
    next(common.slices(iter([pa.RecordBatch.from_pydict({"text": pa.array(["a"])})]), "text"))
    assert len(stays) == 40 and mb() < full - 150


CLASHES = ("_own", "_text", "_digest", "_found", "_html", "_part", "_p", "_x", "_raw", "_tree", "_score", "_score_", "score", "predicted", "f_capitals", "row", "part", "label", "digest", "node", "ids", "found", "first_id", "_id", "stays", "group")


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves come through with their own values."""
    texts = ["the quick brown fox jumps over the lazy dog once more", "the quick brown fox jumps over the lazy dog once more", "password=hunter22222 and some other words that stand here", None, "", "you are all quite welcome to come here today"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in CLASHES})
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "What is the capital of France? Paris.")], "item_id long, text string")
    kept = {"toxicity": toxicity.drop_toxic(docs, labels), "near": simhash.drop_near_duplicates(docs), "leaks": decontam.decontaminate(docs, items), "secrets": secrets.redact(docs), "bpe": bpe.tokenized(docs.drop("ids"), bpe.vocabulary())}
    for name, out in kept.items():
        rows = out.collect()
        assert rows and out.columns.count("_own") == 1, name
        for r in rows:
            assert all(r[c] == f"{c} {r['doc_id']}" for c in CLASHES if c != "ids"), (name, r)
    assert {r["doc_id"] for r in kept["near"].collect()} == {0, 2, 3, 5}
    scored = toxicity.fit(docs, labels).score(docs)
    assert scored.filter("_score = concat('_score ', doc_id) AND f_capitals = concat('f_capitals ', doc_id)").count() == 6
    assert langid.predict(docs, langid.fit(docs)).filter("_text = concat('_text ', doc_id)").count() == 6 and simhash.fingerprints(docs).filter("_text = concat('_text ', doc_id)").count() == 6
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumn("html", F.lit("<p>x</p>"))
    assert html_cut.extract(pages.drop("text", "n_chars")).filter("_html = concat('_html ', page_id)").count() == 6


def test_masked_words_of_long_code_are_looked_up_once():
    import time

    terms = {f"w{i:05d}x$": 3.0 for i in range(20_000)} | {"plonker$": 3.0}
    odds = toxicity.Odds({k.replace("0", "o").replace("1", "i").replace("2", "z").replace("3", "e").replace("4", "h").replace("5", "s").replace("6", "g").replace("7", "t").replace("8", "b").replace("9", "q"): v for k, v in terms.items()})
    began = time.time()
    toxicity.features("x = a*b + c*d; " * 70_000, odds)
    assert time.time() - began < 5
    brute = lambda m: any(len(w) == len(m) and all(a in ("*", b) for a, b in zip(m, w, strict=True)) for w in [*toxicity.INSULTS, *(t[:-1] for t in odds.terms)])
    for m in ("pl*nker", "p*****r", "id**t", "idi*t", "a*b", "w*****x", "wooooox", "x*y"):
        assert odds.hides(m) == brute(m), m


def test_warc_field_inside_a_url_is_no_field(spark, tmp_path):
    urls = ["http://a/?WARC-Refers-To: <urn:causeway:record:77>", "http://a/\r\nWARC-Refers-To: <urn:causeway:record:78>\r\n", "http://a/\u2028WARC-Refers-To: <urn:causeway:record:79>", "http://a/"]
    spark.createDataFrame([(i, u, "h" * 200 if i > 1 else f"{i}" * 200) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.op1_warc(spark, str(tmp_path)).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("revisit", 2)}
