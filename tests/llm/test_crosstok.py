"""Cross-tokenizer alignment against a plain version: whole texts encoded at once, all pairs of offsets compared."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.llm import crosstok
from causeway.llm.queries import QUERIES

PATHS = crosstok.tokenizers()
PARTS = ["a", "Bc", " ", "  ", "\n", "\t", "\x1c", "é", "日本", "▁", "😀", "<|endoftext|>", "</s>", "<0x41>", "\x00", "\u00a0", "\u3000", "'s", "123", "--", ";\r", " \r", "ab" * 800, "the lazy dog", "tionne"]


def plain(texts):
    p, told, holding = crosstok.Pair(*PATHS), [], Counter()
    for t in texts:
        told.append(None)
        if not t:
            continue
        a, b = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)
        sides = [[tokens[i] for i in ids] for tokens, ids in ((p.a_bytes, a), (p.b_bytes, b))]
        if any(b"".join(s) != f" {t}".encode() for s in sides):
            continue
        ends = []
        for s in sides:
            at, own = 0, []
            for x in s:
                at += len(x)
                own.append(at)
            ends.append(own)
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        told[-1] = (len(a), len(b), groups, links)
        holding.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in holding.items():
        best[x] = max(best[x], n)
    for r in told:
        if r is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            na, nb, groups, links = r
            written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            yield (na, nb, len(groups), sum(links.values()), sum(k for p, k in links.items() if holding[p] == best[p[0]]), sum(k * holding[p] for p, k in links.items()), hashlib.sha256(written.encode()).hexdigest())


def test_query_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *r) for d, r in zip(docs, plain([d["text"] for d in docs]), strict=True))
    assert sorted(tuple(r) for r in QUERIES["op11_crosstok"](spark, sf).collect()) == want


@pytest.fixture(scope="module")
def odd():
    random.seed(11)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 9))) for _ in range(300)] + [None, "", "same words again", "same words again", "word " * 20_000]


@pytest.mark.parametrize("most", [crosstok.HEAD_PAIRS, 60, 0])
def test_odd_texts_with_and_without_a_tail(spark, odd, most):
    """Broken white space, strings of special tokens, bytes that only one side knows, repeats; all pairs broadcast, some, none."""
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, row string").withColumns({c: F.lit("x") for c in ("a", "b", "times", "pairs", "more", "id", "pair", "best", "n_a")}).repartition(3)
    got = crosstok.align(df, *PATHS, most=most)
    assert set(df.columns) - {"text"} <= set(got.columns) and got.columns.count("n_a") == 1
    rows = {r["doc_id"]: tuple(r[c] for c in crosstok.FIELDS) for r in got.collect()}
    assert [rows[i] for i in range(len(odd))] == list(plain(odd))


def test_empty_table_and_small_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert crosstok.align(df.limit(0), *PATHS).collect() == []
    monkeypatch.setattr(crosstok, "OWN_CHUNKS", 20)
    monkeypatch.setattr(crosstok, "KEPT_CHUNKS", 8)
    texts = [" ".join(f"w{random.randint(0, 60)}" for _ in range(15)) for _ in range(50)]
    chunks = crosstok.ChunkTable(crosstok.Pair(*PATHS))
    for t, want in zip(texts, plain(texts), strict=True):  # the table forgets words all the time
        sums, digest, _, times = chunks.told(chunks.rows([t])[0])
        assert (*sums, digest) == (*want[:4], want[6]) and times.sum() == want[3] and len(chunks) < 60


def test_large_groups_are_counted_not_expanded(monkeypatch):
    p = crosstok.Pair(*PATHS)
    monkeypatch.setattr(crosstok, "BIG", 3)
    small = crosstok.Aligned(p, ["tionthreeaux", "日本語日本語", "x"])
    monkeypatch.setattr(crosstok, "BIG", 10**9)
    large = crosstok.Aligned(p, ["tionthreeaux", "日本語日本語", "x"])
    assert small.pairs.tolist() == large.pairs.tolist() and small.times.tolist() == large.times.tolist() and small.text == large.text


def test_pieces_across_spaces_are_refused():
    with pytest.raises(ValueError):
        crosstok.Pair.check(None, ["a", "a▁b"])
