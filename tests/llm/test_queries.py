"""The contract queries on the smallest tables, against plain Python."""

import hashlib
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from causeway.llm.queries import QUERIES

A = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_all_thirteen_are_there():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))


def test_op1(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in QUERIES["op1_warc"](spark, sf).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"] or "", p["page_id"])
    for p in pages:
        data = (p["html"] or "").encode()
        again = len(data) >= 100 and first[p["html"] or ""] != p["page_id"]
        r = got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[p["html"] or ""] if again else None)


def test_op3(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op3_secret_scans"](spark, sf).collect()}
    for d in table(spark, sf, "documents"):
        t, found = d["text"] or "", []
        found += [(m.start(), 0, "assign", m.end()) for m in A.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got[d["doc_id"]]["spans"] == spans and got[d["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_op9(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op9_html"](spark, sf).collect()}
    for p in table(spark, sf, "pages"):
        blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", p["html"], re.S)[1])
        want = " ".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in blocks) if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_op5_and_op7_hold_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = QUERIES["op5_langid"](spark, sf).join(docs, "doc_id").filter("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    tox = QUERIES["op7_toxicity"](spark, sf)
    assert tox.count() == docs.count() and tox.filter("predicted <> CAST(score >= 0.7 AS INT)").count() == 0


def test_op2_finds_every_verbatim_item(spark, sf):
    from causeway.llm.decontam import words_of

    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontam"](spark, sf).collect()}
    items = [(i["item_id"], b" ".join(words_of(i["text"]))) for i in table(spark, sf, "benchmark")]
    want = {(d["doc_id"], i) for d in table(spark, sf, "documents") for text in [b" ".join(words_of(d["text"] or ""))] for i, t in items if t in text}
    assert want <= got and len(got) <= len(want) + 2


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < docs.count() and out.filter("n_tokens <> size(ids)").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secret_scan", "bpe"]


def test_wand_against_brute_force(spark, sf):
    import random
    from collections import defaultdict

    from causeway.llm import decontam

    ix = decontam.indexes(spark.read.parquet(f"{sf}/benchmark.parquet"))[0]
    random.seed(4)
    words = list(ix.terms)
    for bound in (0.05, 0.2, 0.6):
        ix.threshold = bound
        for _ in range(60):
            terms = {ix.terms[w] for w in random.sample(words, min(len(words), random.randint(1, 80)))}
            score = defaultdict(float)
            for t in terms:
                for i, w in zip(*ix.lists[t][:2], strict=True):
                    score[i] += w
            assert sorted(i for i, _ in ix.retrieve(terms)) == sorted(i for i, s in score.items() if s >= bound - 1e-9)


def test_minimum_cut_against_brute_force():
    import itertools
    import random

    from causeway.llm.html_cut import minimum_cut

    random.seed(3)
    for _ in range(200):
        n = random.randint(1, 8)
        s, t = ([random.random() * 3 for _ in range(n)] for _ in "st")
        e = {(i, j): random.random() * 1.5 for i in range(n) for j in range(i + 1, n) if random.random() < 0.5}
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(c for (i, j), c in e.items() if x[i] != x[j])  # noqa: B023, E731
        assert cost(minimum_cut(s, t, e)) == pytest.approx(min(cost(x) for x in itertools.product([0, 1], repeat=n)))
